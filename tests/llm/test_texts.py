"""Splitting, encoding, packing and truncation: round trips, exact equality, capacity, planted cuts."""

import os
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlens.llm import packing, splitting, tokenize, truncation

HAVE = os.path.exists(os.path.join(tokenize.TOKENIZERS, "byte_bpe_50k.tiktoken"))
needs_files = pytest.mark.skipif(not HAVE, reason="no tokenizer files")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .\n#-|é中\r\t"), max_size=300), st.integers(1, 60), st.integers(0, 70))
def test_pieces_cover_the_text(text, limit, overlap):
    cuts = splitting.cut_points(text, limit, overlap)
    assert bool(cuts) == bool(text)
    shared = min(overlap, limit - 1)
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert b - c == shared and d > b
    assert all(0 < b - a <= limit for a, b in cuts)
    if cuts:
        assert "".join(text[a if k == 0 else a + shared : b] for k, (a, b) in enumerate(cuts)) == text
        assert (len(cuts) == 1) == (len(text) <= limit)


def test_natural_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    ends = [text[a:b] for a, b in splitting.cut_points(text, 34, 0)]
    assert ends == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven."]
    assert [text[a:b] for a, b in splitting.cut_points(text, 20, 0)][0] == "One two three. "
    assert [b - a for a, b in splitting.cut_points("x" * 25, 10, 2)] == [10, 10, 9]


def test_items(spark):
    sections = spark.createDataFrame([(1, [" a" * 10, None, " ", "b"], 2, "t"), (1, ["old" * 99], 1, "t"), (2, None, 1, "t"), (3, [], 1, "t"), (4, [None, ""], 1, "t")], "section_id bigint, paragraphs array<string>, parsed_at int, text string")
    plans = spark.createDataFrame([(1, "x" * 31, 1), (2, None, 1), (3, "", 1), (4, "y" * 30, 1), (4, "y" * 30, 1)], "plan_note_id bigint, body string, proposed_at int")
    limits = spark.createDataFrame([("section", 10, 2), ("plan", 30, 5)], "item_kind string, max_chars int, overlap_chars int")
    out = {(r.item_kind, r.item_id): r for r in splitting.split_items(splitting.limited_items(sections, plans, limits)).collect()}
    assert out["section", 1].text == ("a " * 10).strip() + "\n\nb" and len(out) == 8
    assert {k for k, r in out.items() if len(r.pieces) > 1} == {("section", 1), ("plan", 1)}
    assert [len(out[k].pieces) for k in (("plan", 2), ("plan", 3), ("plan", 4), ("section", 2))] == [0, 0, 1, 0]
    assert splitting.split_items(splitting.limited_items(sections.limit(0), plans.limit(0), limits)).collect() == []


@needs_files
def test_long_texts_have_the_same_ids():
    rnd = random.Random(2)
    enc = tokenize.Encoder(long_text=40, long_piece=16)
    parts = ["a", "the", "in", "'s", "'", "re", "  ", "\n", " ", "\t", "9", "12", "é", "ж", "中", "!?", "...", "<|endoftext|>", "ing", " ", "x", "\r\n", "👍"]
    for k in range(4000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120)))
        s = s.replace(" ", "") if k % 4 == 0 else s
        assert enc(s) == enc.bpe.encode_ordinary(s)
    assert enc("a b " * 30 + "z" * 900) == enc.bpe.encode_ordinary("a b " * 30 + "z" * 900)
    assert enc(None) == enc("") == []


@needs_files
def test_encoding_table(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (3, "", 5), (4, "word " * 40000, 5)], "doc_id bigint, text string, ids int")
    out = {r.doc_id: r.ids for r in tokenize.encode(df).collect()}
    assert out[1] == [15496, 995] and out[2] == out[3] == [] and len(out[4]) > 39999
    assert tokenize.encode(df).count() == 5 and tokenize.encode(df.limit(0)).collect() == []
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokenize.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    text = "Grüße <|endoftext|> и [[ссылки]]\r\n\r\n  def f(x):\n\treturn 1,250.00"
    assert tokenize.Encoder()(text) == t.encode(text, add_special_tokens=False).ids
    assert {r.doc_id: r.n_tokens for r in tokenize.token_counts(df.where("doc_id < 3")).collect()} == {1: 2, 2: 0}


def check_packing(spark, lengths, kinds, **kw):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id bigint, n_tokens bigint, n string")
    rows = packing.pack(df, kinds, **kw).collect()
    assert len({(r.container_kind, r.doc_id, r.piece_no) for r in rows}) == len(rows)
    shares = {}
    for kind, cap in kinds.items():
        of = [r for r in rows if r.container_kind == kind]
        per, room = {}, {}
        for r in of:
            per.setdefault(r.doc_id, []).append(r.n_tokens)
            if r.container_id is None:
                assert r.n_tokens == 0
            else:
                room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
        assert {i: sum(x) for i, x in per.items()} == {i: n or 0 for i, n in enumerate(lengths)}
        assert all(len(x) == 1 for i, x in per.items() if (lengths[i] or 0) <= cap)
        assert all(0 < x <= cap for x in room.values()) and sorted(room) == list(range(len(room)))
        shares[kind] = sum(room.values()) / (cap * len(room)) if room else 1.0
    return shares


def test_packing(spark):
    rnd = random.Random(3)
    lengths = [0, None, 1, 64, 65, 128, 500, *(min(rnd.randint(1, 90), rnd.randint(1, 90)) for _ in range(1500))]
    shares = check_packing(spark, lengths, {"s": 64, "w": 128})
    assert min(shares.values()) > 0.97
    assert min(check_packing(spark, lengths, {"s": 64}, buckets=8).values()) > 0.85
    check_packing(spark, [7] * 400, {"s": 20})
    check_packing(spark, [], {"s": 20})
    check_packing(spark, [0, None], {"s": 20})


def test_buckets_minimise_padding():
    import itertools

    import numpy as np

    lengths, counts = np.array([1, 2, 5, 6, 9, 10]), np.array([5, 1, 7, 2, 3, 1])
    pad = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
    for k in (1, 2, 3, 4):
        best = min(pad([*c, 10]) for c in itertools.combinations(lengths[:-1].tolist(), k - 1))
        assert pad(packing.bucket_bounds(lengths, counts, k).tolist()) == best


def test_buckets_minimise_padding_of_many_lengths():
    import numpy as np

    rnd = random.Random(8)
    for k in (3, 7, 20):
        lengths = np.array(sorted(rnd.sample(range(1, 400), 60)))
        counts = np.array([rnd.randint(1, 50) for _ in lengths])
        cost = lambda i, j: sum(int(c) * int(lengths[j - 1] - x) for x, c in zip(lengths[i:j], counts[i:j]))  # noqa: E731, B023
        table = {(i, j): cost(i, j) for j in range(61) for i in range(j)}
        best = {0: 0}
        for _ in range(k):
            best = {0: 0} | {j: min(best[i] + table[i, j] for i in range(j) if i in best) for j in range(1, 61)}
        b = packing.bucket_bounds(lengths, counts, k)
        assert len(b) <= k and sum(int(c) * int(b[np.searchsorted(b, x)] - x) for x, c in zip(lengths, counts)) == best[60]


def test_packing_inside_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 40)
    rnd = random.Random(4)
    lengths = [rnd.randint(1, 70) for _ in range(900)] + [200]
    check_packing(spark, lengths, {"s": 64, "w": 100}, buckets=6, mixed=False)
    check_packing(spark, lengths, {"s": 64, "w": 100}, buckets=6)


WHOLE = ["A full stop.", "Really?", '"Quoted."', "- item Alpha\n- item Beta", "#a/b #c/d", "See [[Link name]]", "Text.\n\n— Name", "Text.\n\nSource: x/page/12", "```\ncode\n```", '{"a": [1, "b"]}', "Intro\n\n{\n  \"a\": 1\n}", "| a | b |\n|---|---|\n| 1 | 2 |", "Fine. 📎", "."]
CUT = ["Some words that st", "See [[Link na", "Text.\n\n```\ncode", '{"a": [1, "b', "| a | b |\n|---|---|\n| 1 |", "One, two,", "A sentence and t…", "A sentence and t...", "A sentence and [...]", "The word is (this", "Intro\n\n{\n  \"a\": 1,", "bad �"]


def test_endings():
    for t in WHOLE:
        assert truncation.ending(t)[0] in ("whole", "item"), t
    for t in CUT:
        assert truncation.ending(t)[0] in ("cut", "line"), t
    for t in (None, "", " \n"):
        assert truncation.ending(t)[0] == "none"
    foot = ("forwarded",)
    assert truncation.ending("It broke of\n\n-- \nforwarded", foot)[0] == "line"
    assert truncation.ending("It is whole.\n\n-- \nforwarded", foot)[0] == "whole"


def test_long_blank_runs_take_no_time():
    gap = " " * 300_000 + "\n" * 300_000
    assert truncation.ending("One." + gap + "Two." + gap)[0] == "whole"
    assert truncation.ending("One." + gap + "two and thr" + " " * 300_000 + "👍")[0] in ("whole", "line")


def test_planted_cuts(spark):
    rnd = random.Random(8)
    nouns = [f"{a}{b}er" for a in ("gard", "lett", "numb", "wint", "summ", "pap") for b in ("", "in", "al")]
    sentence = lambda: f"The {rnd.choice(nouns)} near the {rnd.choice(nouns)} follows every {rnd.choice(nouns)}."
    rows, cut = [], set()
    for i in range(600):
        text, source = " ".join(sentence() for _ in range(rnd.randint(2, 6))), rnd.choice(["plain", "chat", "limited"])
        if source == "chat" and rnd.random() < 0.5:
            text = text[:-1]
        if i % 9 == 0:
            text, source = text[: text.rindex(" ") + rnd.randint(2, 4)], "plain"
            cut.add(i)
        if source == "limited" and len(text) > 160:
            text = text[:160]
            if not text.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, source, text, "x"))
    rows += [(900, None, None, "x"), (901, "plain", "", "x"), (902, "plain", "  ", "x"), (903, None, "Whole. " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, word string")
    got = {r.doc_id: r.cut for r in truncation.truncated(df).collect()}
    assert len(got) == len(rows) and not any(got[i] for i in (900, 901, 902, 903))
    found = {i for i, c in got.items() if c}
    assert len(found & cut) >= 0.98 * len(cut) and len(found - cut) <= 0.02 * len(rows)
    assert truncation.truncated(df.limit(0)).collect() == [] and F is not None


def test_copies_of_a_cut_text_are_cut(spark):
    rows = [("plain", f"The meeting about page {k} is over. We see the hub page and the garden.") for k in range(60)]
    rows += [("chat", f"see the hub page and the garden and page {k} of the garden") for k in range(60)]
    broken, short = "Notes for the next mee", "Notes for the next"
    rows += [("plain", broken)] * 60 + [("chat", broken)] * 30 + [("plain", short)] * 4 + [("chat", "passt so")] * 20 + [("plain", "passt so")] * 4
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, source string, text string")
    cut = {}
    for r in truncation.truncated(df).collect():
        cut.setdefault(rows[r.doc_id], set()).add(r.cut)
    assert cut["plain", broken] == cut["chat", broken] == cut["plain", short] == cut["plain", "passt so"] == {True}
    assert cut["chat", "passt so"] == {False}
    assert all(v == {False} for (_, t), v in cut.items() if "garden" in t)


def test_every_json_block_counts():
    one = '{"a": [1, "b"]}'
    for t in (one + "\n\n[{\"b\": \"It is so.\"}", one + "\n{\"b\": \"It is so.", "Intro\n\n{'a': 1}\n" + one + "\n{\"b\": [{\"c\": 1}]", f"{one}\n" * 3 + "{\"d\": {\"e\": \"x\"}"):
        assert truncation.ending(t)[0] == "cut", t
    for t in (f"{one}\n\nThen:\n\n{one}", f"{one}\n" * 3, one + "\n\nA full stop.", "[" * 5 + "\n" + one):
        assert truncation.ending(t)[0] == "whole", t
    assert truncation.ending(f"{one}\n" * 50_000 + '{"a": "It is so.')[0] == "cut"
    assert truncation.ending('{"a":' * 50_000 + '"It is so.')[0] == "cut"


def test_limits_below_the_longest_text(spark):
    rnd = random.Random(5)
    nouns = ["garden", "letter", "number", "winter", "summer", "paper"]
    sentence = lambda: f"The {rnd.choice(nouns)} near the {rnd.choice(nouns)} follows {rnd.randint(100, 999)}."
    known = " ".join(f"The {n} of the {n} is the {n}." for n in nouns)
    rows = [("other", known, False)] * 3 + [("once", "Some longer text that came in late. " * 20, False)]
    for k in range(40):
        rows.append(("once", " ".join(sentence() for _ in range(rnd.randint(1, 4))), False))
        rows.append(("marked", " ".join(sentence() for _ in range(rnd.randint(1, 4))), False))
        text = "- "
        while not text[197:200].isalpha():
            text = f"List {k + 100}:\n\n" + "\n".join(f"- {rnd.choice(nouns)} {rnd.choice(nouns)}" for _ in range(30))
        rows.append(("once", text[:200], True))
        rows.append(("marked", text[:200] if k % 2 else text[:193] + " garden", True))
        rows.append(("marked", text[:200] + " [...]", True))
        day = f"# Day {k + 100}"
        rows.append(("other", day, False))
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(rows)], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.cut for r in truncation.truncated(df).collect()}
    assert {i for i, c in got.items() if c} == {i for i, r in enumerate(rows) if r[2]}


def test_pieces_make_up_their_text(spark):
    rows = [("a", 1, "First one. Second one is here.\n\nThird " * 9, 40, 7), ("a", 2, None, 10, 1), ("a", 3, "", 10, 1), ("a", 4, "x" * 95, 10, 30), ("b", 5, "короткий", 100, None)]
    items = spark.createDataFrame([(*r, "t") for r in rows], "item_kind string, item_id bigint, text string, max_chars int, overlap_chars int, piece string")
    got = {r.item_id: (r.digest, r.fits, r.shared) for r in splitting.reassembled(splitting.split_items(items)).collect()}
    assert got == {i: (hashlib.md5(t.encode()).hexdigest(), True, True) for _, i, t, *_ in rows if t}


def test_decode(spark):
    texts = ["", None, "a b", "Ж" * 40, "  x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in tokenize.decode(tokenize.encode(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    kept = tokenize.token_counts(df.withColumn("source", F.lit("s")), keep=("source",)).collect()
    assert {(r.doc_id, r.source) for r in kept} == {(i, "s") for i in range(5)}


def test_known_beginnings(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abя") for _ in range(n))
    words = {word(rnd.randint(1, 9)) for _ in range(300)} | {"x" * 3000}
    asked = {word(rnd.randint(1, 9)) for _ in range(300)} | {"x" * 2999, "x" * 3000, "x"}
    got = truncation.known_beginnings(spark.createDataFrame([(x,) for x in asked], "word string"), spark.createDataFrame([(x,) for x in words], "word string"))
    found = [r.word for r in got.collect()]
    want = {a for a in asked if any(w != a and w.startswith(a) for w in words)}
    assert len(found) == len(set(found)) and {f for f in found if f not in words} == {w for w in want if w not in words} and set(found) <= want


def test_code_blocks_are_cut_between_lines_only_where_they_must():
    code = "```\n" + "x = 1\n\ny = 2. z\n" * 3 + "```\n"
    text = "Some words. " * 6 + "\n\n" + code + "\nAfter it. More."
    got = [text[a:b] for a, b in splitting.cut_points(text, 80, 0)]
    assert "".join(got) == text and got[1] == code + "\n" + "After it. More."
    small = [text[a:b] for a, b in splitting.cut_points(text, 30, 0)]
    assert "".join(small) == text and all(len(x) <= 30 for x in small)
    at = text.index("```") + 4
    cuts = {a for a, _ in splitting.cut_points(text, 30, 0)}
    assert all(text[c - 1] == "\n" for c in cuts if at < c < text.rindex("```"))
    open_ = "a b\n```\n" + "line of code\n" * 20
    assert all(open_[a - 1] == "\n" for a, _ in splitting.cut_points(open_, 40, 0)[1:])
