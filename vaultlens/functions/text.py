"""Text expressions shared by the operators; all of them run in the JVM.

White space is that of Python's str.isspace: ASCII and Unicode blanks, line
breaks, no-break spaces and the four information separators. The same class
is valid in Java's regular expressions and in RE2, so that queries and their
SQL counterparts agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
LINK = r"\[\[([^\]]+)\]\]"
#: What ends a line for Python's splitlines, besides CRLF.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rstrip(c: Column | str) -> Column:
    """Without white space at the end; a run is tried from its start only, so long runs within a text cost no more."""
    return F.regexp_replace(col(c), f"(?<!{WS}){WS}++$", "")


def strip(c: Column | str) -> Column:
    """Without surrounding white space, as str.strip()."""
    return F.regexp_replace(col(c), f"^{WS}++|(?<!{WS}){WS}++$", "")


def collapse(c: Column | str) -> Column:
    """Each run of white space as one blank, none around the text."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~col(c).rlike(NOT_WS), F.lit(True))


def word_count(c: Column | str) -> Column:
    """Runs of text without white space; 0 for null."""
    return F.coalesce(F.regexp_count(col(c), F.lit(f"{NOT_WS}+")), F.lit(0))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(f"{NOT_WS}+"), F.lit(0))


def paragraphs(c: Column | str) -> Column:
    """Non-blank paragraphs between blank lines, without surrounding white space."""
    parts = F.split(col(c), rf"\n{WS}*\n")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def h1_title(c: Column | str, otherwise: Column | str) -> Column:
    """Text of the first line that starts with '# ', else another title."""
    found = F.regexp_extract(col(c), rf"(?:^|{LINE_BREAK})# ([^\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]*)", 1)
    hit = col(c).rlike(rf"(?:^|{LINE_BREAK})# ")
    return F.when(hit, strip(found)).otherwise(col(otherwise))


def links_raw(c: Column | str) -> Column:
    """Inner text of every wikilink, in order, stripped."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(LINK), F.lit(1)), strip)


def link_target(c: Column | str) -> Column:
    """A link's text without alias and heading, stripped."""
    return strip(F.regexp_extract(col(c), r"^[^|#]*", 0))


def links_normalised(c: Column | str) -> Column:
    """Different link targets; links that name none are left out."""
    found = F.regexp_extract_all(col(c), F.lit(LINK), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, link_target), lambda t: t != ""))


def title_key(c: Column | str) -> Column:
    """The form in which titles are compared."""
    return F.lower(collapse(c))


def target_key(c: Column | str) -> Column:
    """The form in which link targets are compared with titles."""
    return title_key(F.regexp_extract(col(c), r"^[^|#]*", 0))


def title_tokens(c: Column | str, min_len: int = 1, stop: list[str] | None = None) -> Column:
    """Different word tokens of a lowercased title."""
    t = F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0)))
    if min_len > 1:
        t = F.filter(t, lambda x: F.length(x) >= min_len)
    return F.array_except(t, F.array(*map(F.lit, stop))) if stop else t


def first_words(c: Column | str, n: int, mark: str = " [...]") -> Column:
    """The first n words joined by blanks, with a mark if there were more."""
    w = words(c)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(mark))).otherwise(col(c))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common values; 0 where both sets are empty or one is null."""
    a, b = col(a), col(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
