"""Splitting oversized items at natural boundaries (problem 5).

A hierarchy of separators: sections, paragraphs, sentences, words, characters.
A fenced code block has no sections, paragraphs and sentences, but lines.
Pieces are packed greedily: each runs to the last boundary of the highest
level that still lies within the limit and fills the piece far enough; only
where there is none, the next level is asked. A piece begins the wanted
overlap before the end of the one before it, so consecutive pieces share
exactly that many characters.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import text as T
from vaultlens.plans.runtime import counting_rows, read_table

#: Where a piece may end, from the highest level down; a match's end is the boundary.
SEPARATORS = (
    re.compile(r"\n(?=#{1,6} )|\n(?:---+|\*\*\*+|___+)[ \t]*\r?\n"),
    re.compile(r"\r?\n[^\S\n]*\r?\n\s*|\r?\n(?=[-*+] |\d+[.)] |\|)"),
    re.compile(r"[.!?。！？…][\"'”»)\]]*\s+|[。！？]|\r?\n"),
    re.compile(r"\s+"),
)
FENCE = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```[ \t]*$|\Z)", re.M | re.S)
LINE = re.compile(r"\r?\n")
#: A boundary serves if it fills at least this share of the limit; else a lower level is asked first.
MIN_FILL = 0.5


def boundaries(text: str) -> list[list[int]]:
    """Places where a text may be cut, rising, from the highest level down; the lines of code blocks are a level above words."""
    found = [[m.end() for m in s.finditer(text)] for s in SEPARATORS]
    code = [m.span() for m in FENCE.finditer(text)] if "```" in text else []
    if not code:
        return found
    starts = [a for a, _ in code]

    def inside(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k >= 0 and code[k][0] < at < code[k][1]

    lines = [m.end() for m in LINE.finditer(text) if inside(m.end())]
    return [*([e for e in of if not inside(e)] for of in found[:-1]), lines, found[-1]]


def cut_points(text: str | None, limit: int, overlap: int, min_fill: float = MIN_FILL) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, in code points; none for null or empty text.

    Every piece has at most limit characters and every piece but the first
    begins overlap characters before the end of the one before it. Where not
    even a word boundary is left, a piece ends at the limit.
    """
    if not text:
        return []
    if limit < 1:
        raise ValueError("limit must be positive")
    overlap = max(0, min(overlap, limit - 1))
    n = len(text)
    if n <= limit:
        return [(0, n)]
    ends = boundaries(text)

    def last(found: list[int], most: int) -> int:
        k = bisect_right(found, most)
        return found[k - 1] if k else -1

    out, start = [], 0
    while True:
        most = start + limit
        if most >= n:
            out.append((start, n))
            return out
        least = start + overlap + 1
        floors = (max(least, start + int(limit * min_fill)), least) if min_fill > 0 else (least,)
        end = most
        for floor in floors:
            hit = next((e for e in (last(x, most) for x in ends) if e >= floor), None)
            if hit is not None:
                end = hit
                break
        out.append((start, end))
        start = end - overlap


def split_items(items: DataFrame, *, min_fill: float = MIN_FILL) -> DataFrame:
    """Pieces of items: one row per item with the array pieces of (start, end, piece).

    items needs text, max_chars and overlap_chars and keeps its other columns.
    A null or empty text has no pieces, a text within the limit exactly one. A
    null limit leaves the text whole; a null overlap is 0. The work is one
    Arrow batch after another, without a shuffle.
    """

    @F.pandas_udf("array<struct<start:int,end:int,piece:string>>")
    def cut(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([
            [{"start": a, "end": b, "piece": t[a:b]} for a, b in cut_points(t, int(m), int(o), min_fill)] for t, m, o in zip(text, limit, overlap)
        ])

    limit = F.coalesce("max_chars", F.lit(2**31 - 1)).cast("int")
    return items.withColumn("pieces", cut("text", limit, F.coalesce("overlap_chars", F.lit(0)).cast("int")))


def limited_items(sections: DataFrame, plans: DataFrame, limits: DataFrame) -> DataFrame:
    """item_kind, item_id, text and the limits of its kind, of the counting rows."""
    s = counting_rows(sections.select("section_id", "paragraphs", "parsed_at"), "section_id", "parsed_at")
    kept = F.filter(F.transform("paragraphs", T.strip), lambda p: p.isNotNull() & (p != ""))
    s = s.select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_id"), F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).alias("text"))
    p = counting_rows(plans.select("plan_note_id", "body", "proposed_at"), "plan_note_id", "proposed_at")
    p = p.select(F.lit("plan").alias("item_kind"), F.col("plan_note_id").alias("item_id"), F.col("body").alias("text"))
    return s.unionByName(p).join(F.broadcast(limits), "item_kind")


def _items(spark, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    return split_items(limited_items(t("doc_sections"), t("plan_notes"), t("piece_limits")))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).where(F.size("pieces") > 1).select("item_kind", "item_id")


def reassembled(pieces: DataFrame) -> DataFrame:
    """item_kind, item_id, digest, fits and shared: the text that the pieces of an item make up again, whether all keep the limit and share the overlap.

    pieces has item_kind, item_id, pieces and the limits; an item's pieces are
    as long as its text, so each row is put together by itself.
    """
    after = F.slice("pieces", 2, F.greatest(F.lit(0), F.size("pieces") - 1))
    joints = F.zip_with(F.slice("pieces", 1, F.size(after)), after, lambda a, b: a["end"] - b["start"])
    rest = F.zip_with(after, joints, lambda x, n: F.substring(x["piece"], n + 1, F.length(x["piece"])))
    text = F.concat(F.get("pieces", F.lit(0))["piece"], F.array_join(rest, ""))
    wanted = F.greatest(F.lit(0), F.least(F.coalesce("overlap_chars", F.lit(0)), F.col("max_chars") - 1))
    within = F.forall("pieces", lambda x: (F.length(x["piece"]) <= F.col("max_chars")) & (F.length(x["piece"]) == x["end"] - x["start"]))
    return pieces.where(F.size("pieces") > 0).select("item_kind", "item_id", F.md5(text.cast("binary")).alias("digest"), within.alias("fits"), F.forall(joints, lambda n: n == wanted).alias("shared"))


def p5_whole(spark, sf_dir: str) -> DataFrame:
    """Whether the pieces of each item are within the limit, share the overlap and make up its text."""
    return reassembled(_items(spark, sf_dir))


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces: item_kind, item_id, piece_no, start, end, piece."""
    return _items(spark, sf_dir).select("item_kind", "item_id", F.posexplode("pieces").alias("piece_no", "p")).select("item_kind", "item_id", "piece_no", "p.*")
