"""Text cut off by field limits or in transfer (problem 9).

A text is read from its end, after the marks and footers that a source puts
behind the break. Of every text the corpus is asked first: a trie of its
vocabulary says whether the final token is an unknown proper prefix of known
words, and each source's lengths say where it cuts. What they leave open the
form decides: open structures (code, JSON, table row, link), and running words
without a full stop, where counts of words in final position say whether a
sentence can end there and whether a source is one of chat messages.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import compress

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.plans.runtime import materialize, read_table

#: Marks that stand for text left out, at the end of a text.
MARKS = re.compile(r"\s*(?:\[(?:\.\.\.|…)\]|\(continued\)?|\.\.\.+|…|\[(?:truncated|cut|clipped|more)\]|(?:read|see) more)\s*$", re.I)
CLOSERS = "\"'”“»«’)]*_`"
STOPS = ".!?。！？؟"
TOKEN = re.compile(r"[^\W_]+")
LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)]) +")
TAG_LINE = re.compile(r"\s*(?:#[^\s#]+\s*)+$")
SIGNATURE = re.compile(r"\s*(?:—|--|–) ?[^\W\d_][\w.' -]{0,40}$")
EMOJI = re.compile("[\u200d\ufe0f\U0001f000-\U0001ffff\u2600-\u27bf]")
#: A line of a label and a path to a numbered page.
REFERENCE = re.compile(r"\s*[^\W\d_]+: ?\S+/\S+/\d+$")
#: A line that begins an object or a list of objects; '[[' begins a link.
JSON_START = re.compile(r'(?:^|\n)[ \t]*(?:\{(?=\s*(?:"|\}|$))|\[(?=\s*(?:\{|$)))')
#: A footer ends this share of a source's texts, so a source has at most twenty.
FOOTER_SHARE = 0.05


def strip_end(text: str, footers: tuple[str, ...] = ()) -> tuple[str, bool]:
    """Text without what the source put behind it; whether a mark of omission stood there."""
    text, marked = text.rstrip(), False
    while True:
        for f in footers:
            if text.endswith("\n" + f) and text[: -len(f)].strip():
                text = text[: -len(f)].rstrip()
                if text.endswith("\n--"):
                    text = text[:-3].rstrip()
                break
        else:
            tail = text[-64:]  # longer than any mark
            if (m := MARKS.search(tail)) and (rest := text[: len(text) - len(tail) + m.start()].rstrip()):
                text, marked = rest, True
                continue
            return text, marked


def _json_end(text: str, at: int) -> int | None:
    """Where the JSON that begins at a bracket ends; None if it breaks off."""
    try:
        return json.JSONDecoder().raw_decode(text, at)[1]
    except (ValueError, RecursionError):
        depth = quoted = 0
        skip = False
        for k in range(at, len(text)):
            c = text[k]
            if skip:
                skip = False
            elif c == "\\":
                skip = bool(quoted)
            elif c == '"':
                quoted ^= 1
            elif not quoted:
                depth += (c in "{[") - (c in "}]")
                if depth == 0 and c in "}]":
                    return k + 1
        return None


def _json_open(text: str) -> bool | None:
    """Whether the last JSON that a line of the text begins breaks off; None if none begins."""
    start = JSON_START.search(text)
    if not start:
        return None
    while start:
        end = _json_end(text, start.end() - 1)
        if end is None:
            return True
        start = JSON_START.search(text, end)
    return False


def ending(text: str | None, footers: tuple[str, ...] = ()) -> tuple[str, str, str]:
    """How a text ends: (state, last token, token before it).

    state is 'none' (null or blank), 'whole', 'cut', or what the corpus must
    decide: 'item' (a list item, tag line, heading or signature, whole unless
    its last token is broken) or 'line' (running words without a full stop).
    """
    if text is None or not text.strip():
        return "none", "", ""
    return _ending(*strip_end(text, footers))


def _ending(body: str, marked: bool) -> tuple[str, str, str]:
    if "�" == body[-1]:
        return "cut", "", ""
    opened = _json_open(body)
    if opened:
        return "cut", "", ""
    fences = [x for x in body.split("\n") if x.lstrip().startswith("```")]
    if len(fences) % 2:
        return "cut", "", ""
    if re.search(r"```\s*$", body) and fences:
        return "whole", "", ""
    if body.rfind("[[") > body.rfind("]]") and "\n" not in body[body.rfind("[[") :]:
        return "cut", "", ""
    last = body.rsplit("\n", 1)[-1].rstrip("\r")
    plain = last.rstrip()
    while plain and EMOJI.match(plain[-1]):
        plain = plain[:-1].rstrip()
    emoji = plain != last.rstrip()
    if last.lstrip().startswith("|"):
        rows = []
        for x in reversed(body.split("\n")):
            if not x.lstrip().startswith("|"):
                break
            rows.append(x.strip())
        full = last.rstrip().endswith("|") and (len(rows) == 1 or last.count("|") == rows[-1].count("|"))
        return ("whole" if full and len(rows) != 1 or full and last.count("|") > 2 else "cut"), "", ""
    if opened is False and re.search(r"[}\]]\s*$", body):
        return "whole", "", ""
    tokens = TOKEN.findall(plain)
    final, before = (tokens[-1] if tokens else ""), (tokens[-2] if len(tokens) > 1 else "")
    if not final or not plain:
        return ("cut" if plain.endswith(("[", "(", "{", ",")) else "whole"), "", ""
    if REFERENCE.match(last):
        return "whole", "", ""
    if TAG_LINE.match(last) or SIGNATURE.match(last) or re.match(r"\s*#{1,6} ", last):
        return ("cut" if marked else "item"), final, before
    core = plain.rstrip(CLOSERS)
    if plain.endswith("]]") or core and core[-1] in STOPS:
        if marked and not plain.endswith("]]"):
            return "whole", "", ""
        if LIST.fullmatch(plain + " "):
            return "cut", "", ""
        return "whole", "", ""
    if marked:
        return "cut", "", ""
    if plain[-1] in ",;:-–—(\"“„«¿¡/&" or plain.count("(") > plain.count(")"):
        return ("line" if plain[-1] == ":" else "cut"), final, before
    if emoji:
        return "whole", "", ""
    return ("item" if LIST.match(last) else "line"), final, before


TALLY = "kind string, doc_id bigint, source string, state string, word string, before string, n_chars bigint, n_bytes bigint, s_chars bigint, s_bytes bigint, marked boolean, hash bigint, total bigint, final bigint, penult bigint"
#: Words a task counts before it hands the counts on.
FLUSH = 200_000
#: A message that a chat source has so often, and in this share of its texts, can be all that was said.
REPEATS, REPEAT_SHARE = 3, 0.01
#: Lengths of a text as it stands and without what strip_end takes off.
MEASURES = ["n_chars", "n_bytes", "s_chars", "s_bytes"]
#: Different texts at a limit: so many, in this share of the source's, and so many times those of the NEAR lengths to either side.
LIMIT_TEXTS, LIMIT_SHARE, OVER_FULL, NEAR = 5, 0.01, 8, 16
#: This share of them ends in a break; at the source's longest text that is not asked.
LIMIT_BREAKS = 0.1
#: Footer lines up to which their table is broadcast; beyond, it is joined as the planner sees fit.
FEW_FOOTERS = 10_000
_RUNS = re.compile(r"([^\W_]+)([\W_]*)")


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 'text', one a text, and of kind 'word', counts of words by position."""
    counts: Counter = Counter()
    finals: Counter = Counter()
    penults: Counter = Counter()
    schema = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("source", pa.string()), ("state", pa.string()), ("word", pa.string()), ("before", pa.string()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("s_chars", pa.int64()), ("s_bytes", pa.int64()), ("marked", pa.bool_()), ("hash", pa.int64()), ("total", pa.int64()), ("final", pa.int64()), ("penult", pa.int64())])

    @lru_cache(maxsize=10_000)
    def stops(gap: str) -> bool:
        """Whether a sentence or a line ends between two words."""
        return "\n" in gap or any(c in STOPS for c in gap)

    def words() -> pa.RecordBatch:
        rows = [("word", None, None, None, w, None, None, None, None, None, None, None, n, finals[w], penults[w]) for w, n in counts.items()]
        for c in (counts, finals, penults):
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    for batch in batches:
        out = []
        for i, source, text, footers in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "source", "text", "footers"))):
            left, marked = strip_end(text or "", tuple(footers or ()))
            state, last, before = _ending(left, marked) if left else ("none", "", "")
            flush = left[-1:].isalnum()  # a token stands at the very end, so the trie can tell
            if flush and not last:
                last = TOKEN.findall(left.rsplit("\n", 1)[-1])[-1]
            digest = xxhash.xxh64_intdigest(text) - 2**63 if text else None
            out.append(("text", i, source, state, last.lower(), before.lower(), len(text or ""), len((text or "").encode()), len(left), len(left.encode()), marked, digest, None, None, None))
            if state == "none":
                continue
            runs = _RUNS.findall(left.lower())
            if (flush or state != "whole") and runs:  # what stands at a doubtful end is no evidence of a word
                runs.pop()
            if not runs:
                continue
            ws, between = zip(*runs)
            ends = list(map(stops, between))
            counts.update(ws)
            finals.update(compress(ws, ends))
            penults.update(compress(ws, ends[1:]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
        if len(counts) > FLUSH:
            yield words()
    if counts:
        yield words()


def footers(docs: DataFrame) -> DataFrame:
    """Of each source the lines that end many of its texts: source, footers."""
    text = F.rtrim("text", F.lit(" \t\r\n"))
    line = F.when(F.contains(text, F.lit("\n")), F.substring_index(text, "\n", -1)).otherwise("")
    n = materialize(docs.select("source", line.alias("line")).groupBy("source", "line").agg(F.count("*").alias("n")), "last-lines")
    of = n.groupBy("source").agg(F.sum("n").alias("of"))
    often = n.join(of, "source").where((F.col("line") != "") & (F.col("n") >= 20) & (F.col("n") >= FOOTER_SHARE * F.col("of")))
    return often.groupBy("source").agg(F.collect_list("line").alias("footers"))


def limits(texts: DataFrame) -> DataFrame:
    """Of each source the lengths at which it cuts, in each measure: source, at_ and the measure (arrays).

    texts has source, hash, the measures, marked and breaks, whether a text
    evidently breaks off. A length is a limit if it is over-full against its
    neighbours in the source's histogram, or if the longest texts share it.
    Copies of a text count once. A limit in bytes leaves up to three free,
    where a character did not fit. A mark may lie within the limit, so what is
    left before marks says nothing of texts without one and is not counted.
    Below the longest text only texts with longer characters show that bytes
    are limited; the others do so as well where characters are.
    """
    one = texts.groupBy("source", "hash").agg(*[F.min(m).alias(m) for m in MEASURES], F.max("marked").alias("marked"), F.max("breaks").alias("breaks"))
    wide = {m: F.col(m) != F.col(m.replace("bytes", "chars")) if m.endswith("bytes") else F.lit(True) for m in MEASURES}
    long = one.select("source", "marked", "breaks", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n"), wide[m].alias("tells")) for m in MEASURES])))
    long = long.where(F.col("measure").startswith("n_") | ~F.col("marked"))
    held = long.groupBy("source", "measure", "n").agg(F.count("*").alias("c"), F.count_if("tells").alias("t"), F.count_if(F.col("tells") & F.col("breaks")).alias("b"))
    of = Window.partitionBy("source", "measure")
    w = of.orderBy("n")
    in_bytes = F.col("measure").endswith("bytes")
    over = lambda c, least, most: F.sum(c).over(w.rangeBetween(least, most))
    here = lambda c: F.when(in_bytes, over(c, -3, 0)).otherwise(F.col(c))
    around = F.when(in_bytes, over("t", -3 - NEAR, NEAR)).otherwise(over("t", -NEAR, NEAR)) - here("t")
    usual = around * F.when(in_bytes, 4).otherwise(1) / (2 * NEAR)
    held = held.withColumns({"at": here("c"), "tell": here("t"), "broke": here("b"), "usual": usual, "all": F.sum("t").over(of), "most": F.max("n").over(of)})
    many = (F.col("tell") >= LIMIT_TEXTS) & (F.col("tell") >= LIMIT_SHARE * F.col("all")) & (F.col("tell") >= LIMIT_TEXTS - 1 + OVER_FULL * F.col("usual"))
    # a fifth at the length itself, so that none just above a limit in bytes counts as one
    many &= (F.col("t") >= 0.2 * F.col("tell")) & (F.col("broke") >= LIMIT_BREAKS * F.col("tell"))
    found = held.where(many | (F.col("n") == F.col("most")) & (F.col("at") >= LIMIT_TEXTS))
    return found.groupBy("source").agg(*[F.collect_list(F.when(F.col("measure") == m, F.col("n"))).alias(f"at_{m}") for m in MEASURES])


#: Characters from which on the words that begin alike are sorted to find those that go on.
HEAD = 4


def known_beginnings(asked: DataFrame, words: DataFrame) -> DataFrame:
    """The asked words that are proper prefixes of some of words; both have word, each once.

    The trie in sorted form: all words that go on from a prefix follow it
    directly, so the next one tells. Short prefixes are written out, at most
    HEAD - 1 of a word, and of longer ones only the word itself is moved.
    """
    short = words.select(F.explode(F.expr(f"transform(sequence(1, least({HEAD}, length(word))), k -> left(word, k - 1))")).alias("word")).where("word <> ''").distinct()
    few = asked.where(F.length("word") < HEAD).join(short, "word", "left_semi")
    both = asked.where(F.length("word") >= HEAD).select("word", F.lit(None).cast("string").alias("known")).unionByName(words.where(F.length("word") > HEAD).select("word", F.col("word").alias("known")))
    w = Window.partitionBy(F.left("word", F.lit(HEAD))).orderBy(F.desc("word")).rowsBetween(Window.unboundedPreceding, -1)
    next_ = both.withColumn("next", F.last("known", ignorenulls=True).over(w))
    return few.unionByName(next_.where(F.col("known").isNull() & F.startswith("next", "word") & (F.col("next") != F.col("word"))).select("word"))


def truncated(docs: DataFrame) -> DataFrame:
    """doc_id, source, state, cut and evidence of each text: what first shows the cut, of word, length, structure and sentence.

    docs needs doc_id, source and text; other columns are ignored. Null, empty
    and blank texts are never cut. A null source is a source of its own.
    Repeated rows come out repeated. Every text and every word of the corpus
    counts; only the words of the vocabulary and the undecided ends of texts
    are shuffled, never the texts.
    """
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    feet = materialize(footers(docs), "footers")
    few = (feet.agg(F.sum(F.size("footers"))).first()[0] or 0) <= FEW_FOOTERS
    read = docs.join(F.broadcast(feet) if few else feet, "source", "left")
    tally = materialize(read.mapInArrow(_read_texts, TALLY), "endings")
    texts = tally.where("kind = 'text'").select("doc_id", "source", "state", "word", "before", *MEASURES, "marked", "hash")
    vocabulary = materialize(tally.where("kind = 'word'").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("total", "final", "penult")]), "vocabulary")
    asked = texts.where("word <> ''").select("word").distinct()
    led = known_beginnings(asked, vocabulary.where(F.col("total") > 1)).withColumn("led", F.lit(True))
    known = asked.join(vocabulary, "word").select("word", "total", "final")
    prior = vocabulary.select(F.col("word").alias("before"), F.col("total").alias("b_total"), "penult")
    read = texts.where("state <> 'none'").join(known, "word", "left").join(led, "word", "left").join(prior, "before", "left")
    broken = F.col("total").isNull() & F.coalesce("led", F.lit(False))
    can_end = F.when(F.col("total").isNotNull(), F.col("final") >= 0.02 * F.col("total")).otherwise(F.coalesce(F.col("penult") >= 0.05 * F.col("b_total"), F.lit(False)))
    judged = read.withColumn("broken", broken).withColumn("sound", ~broken & can_end)
    judged = materialize(judged.select("doc_id", "source", "state", *MEASURES, "marked", "hash", "broken", "sound"), "judged")
    # where a source's different texts end without full stops and yet soundly, it is one of chat messages
    lines = judged.where("state = 'line'").groupBy("source", "hash").agg(F.max("sound").alias("sound"), F.count("*").alias("same"), F.min("n_chars").alias("n_chars"))
    chat = lines.groupBy("source").agg((F.avg(F.col("sound").cast("int")) >= 0.5).alias("chat"))
    # there a message that recurs may end in any known word
    size = judged.groupBy("source").agg(F.count("*").alias("of"))
    usual = lines.where(F.col("same") >= REPEATS).join(size, "source").where(F.col("same") >= REPEAT_SHARE * F.col("of")).select("source", "hash", F.lit("line").alias("state"), F.lit(True).alias("usual"))
    line, open_ = F.col("state") == "line", F.col("state").isin("item", "line")
    breaks = (F.col("state") == "cut") | open_ & F.col("broken") | line & ~F.col("sound")
    ends = judged.select("source", "hash", *MEASURES, "marked", breaks.alias("breaks"))
    of = judged.join(usual, ["source", "hash", "state"], "left").join(chat, "source", "left").join(limits(ends), "source", "left")
    reach = lambda m: F.array_contains(f"at_{m}", F.col(m)) if m.endswith("chars") else F.exists(f"at_{m}", lambda n: (F.col(m) <= n) & (F.col(m) > n - 4))
    full = reduce(Column.__or__, [F.coalesce(reach(m), F.lit(False)) for m in MEASURES])
    is_chat = F.coalesce("chat", F.lit(False))
    sound = F.col("sound") | F.coalesce("usual", F.lit(False)) & ~full
    # a text that seems whole is only cut where both kinds of evidence say so
    by_word = F.col("broken") & ((F.col("state") != "whole") | full)
    by_length = full & open_ & ~is_chat
    by = F.when(by_word, "word").when(by_length, "length").when(F.col("state") == "cut", "structure").when(line & ~(is_chat & sound), "sentence")
    decided = of.select("doc_id", "source", "state", by.isNotNull().alias("cut"), by.alias("evidence"))
    none = texts.where("state = 'none'").select("doc_id", "source", "state", F.lit(False).alias("cut"), F.lit(None).cast("string").alias("evidence"))
    return decided.unionByName(none)


def p9_found(spark, sf_dir: str) -> DataFrame:
    return truncated(read_table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p9_sources(spark, sf_dir: str) -> DataFrame:
    """How often each source truncates: source, texts, cut and its parts by what first shows it, share."""
    t = truncated(read_table(spark, sf_dir, "documents")).where("state <> 'none'")
    parts = [F.count_if(F.col("evidence") == e).alias(f"by_{e}") for e in ("word", "length", "structure", "sentence")]
    return t.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), *parts).withColumn("share", F.col("cut") / F.col("texts"))
