"""Components, consensus, set overlap and near copies against brute force."""

import random
import string
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultlens.llm import components, consensus, nearcopies, overlap, setjoin


def closure(edges, nodes):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def run_components(spark, pairs, nodes=()):
    p = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a bigint, b bigint, node string")
    n = spark.createDataFrame([(x, 1) for x in nodes], "node bigint, a int")
    return {r.node: r.component for r in components.connected_components(p, n).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_components_random(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randint(-9, 60), rnd.randint(-9, 60)) for _ in range(45)]
    nodes = {x for p in pairs for x in p} | {99, 100}
    assert run_components(spark, pairs + pairs[:4] + [(b, a) for a, b in pairs[:4]], nodes) == closure(pairs, nodes)


def test_components_shapes(spark):
    chain = [(i, i + 1) for i in range(70)]
    star = [(500, i) for i in range(501, 900)]
    got = run_components(spark, chain + star)
    assert set(got.values()) == {0, 500} and len(got) == 71 + 400
    assert run_components(spark, [(5, 5), (None, 1), (2, None)], [5, None]) == {5: 5}
    assert run_components(spark, []) == {}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def pairs_of(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(sets[a], sets[b]) >= t - 1e-12}


def some_sets(rnd, n, universe, sizes):
    sets = {}
    for i in range(n):
        if sets and rnd.random() < 0.6:  # an edited copy of an earlier one
            s = set(sets[rnd.choice(list(sets))])
            for _ in range(rnd.randint(0, max(1, len(s) // 3))):
                s.discard(rnd.choice(sorted(s))) if rnd.random() < 0.5 and len(s) > 1 else s.add(rnd.randint(1, universe))
        else:
            s = {min(rnd.randint(1, universe), rnd.randint(1, universe)) for _ in range(rnd.randint(*sizes))}
        sets[i] = s
    return sets


@pytest.mark.parametrize(("t", "words", "sizes", "universe", "rare"), [(0.7, 1, (4, 25), 60, 256), (0.5, 4, (1, 150), 400, 256), (0.5, 4, (1, 90), 120, 1), (0.7, 1, (1, 12), 20, 2), (0.8, 4, (5, 60), 90, 1), (0.5, 4, (30, 40), 60, 3)])
def test_similar_sets_are_all_found(spark, t, words, sizes, universe, rare):
    """Also where nearly every feature is frequent, so that the subsets of two do the work."""
    rnd = random.Random(rare)
    sets = some_sets(rnd, 220, universe, sizes)
    mixed = {k: [int(x) for x in setjoin.mix(np.array(sorted(v), np.uint64)).view(np.int64)] for k, v in sets.items()}
    df = spark.createDataFrame([(k, sorted(v), 0) for k, v in mixed.items()], "id bigint, f array<bigint>, m int")
    got = [(r.a, r.b) for r in setjoin.similar_pairs(df, t, words, rare).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(sets, t)


def test_similar_sets_empty(spark):
    df = spark.createDataFrame([], "id bigint, f array<bigint>")
    assert setjoin.similar_pairs(df, 0.7, 1).collect() == []


def test_overlap(spark):
    rows = [
        (1, ["#A", " b", "c"], ["X|y", "Z#h"], 1), (1, ["old"], None, 0), (2, ["a", "B ", "c", None, ""], ["x", "z", "|q"], 1), (3, ["a", "b", "c"], ["x"], 1),
        (4, ["x", "z", "a", "b"], None, 1), (5, None, ["a", "b", "c", "x", "z"], 1), (6, None, None, 1), (None, ["a"], None, 1), (2, ["a", "B ", "c", None, ""], ["x", "z", "|q"], 1), (7, ["a", "b", "c"], [], 1),
    ]
    df = spark.createDataFrame([(*r, "id", 5) for r in rows], "note_id bigint, tags array<string>, links array<string>, scanned_at int, id string, f int")
    assert {tuple(r) for r in overlap.overlapping(df).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert overlap.overlapping(df.limit(0)).collect() == []


def words_of(t):
    return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()


def brute_copies(texts, t=0.5):
    runs = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, x in texts.items() if len(w := words_of(x)) >= 25}
    return pairs_of(runs, t)


def test_near_copies(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(string.ascii_lowercase[:6]) for _ in range(rnd.randint(1, 3)))
    texts = {}
    for i in range(150):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(list(texts.values())).split(" ")
            for _ in range(rnd.randint(0, 12)):
                w[rnd.randrange(len(w))] = word()
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(word() for _ in range(rnd.randint(20, 160)))
    texts[200], texts[201], texts[202] = texts[3].upper(), None, ""
    texts[203] = texts[204] = "same " * 30
    texts[205] = "Ж1 _ " * 5000
    df = spark.createDataFrame([(i, x, "t") for i, x in texts.items()], "id bigint, text string, f string")
    got = [tuple(r) for r in nearcopies.near_copies(df).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_copies(texts) and (203, 204) in got


TOKENS = st.lists(st.sampled_from("abcde"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(TOKENS, TOKENS)
def test_alignment(base, value):
    """Partners are equal and rise in both; base becomes the value where all its votes win."""
    got = consensus.aligned(base, value)
    assert all(base[i] == value[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
    assert consensus.patched(base, consensus.votes(base, value)) == value
    assert consensus.votes(base, base) == [] and consensus.distance(value, value) == 0.0


def test_votes():
    base = "a b c d".split()
    assert consensus.votes(base, "a x c d".split()) == [(1, 0, "x")]
    assert consensus.votes(base, "a c d".split()) == [(1, 0, None)]
    assert consensus.votes(base, "z a b c d e f".split()) == [(-1, 1, "z"), (3, 1, "e"), (3, 2, "f")]
    assert consensus.votes([], ["x"]) == [(-1, 1, "x")] and consensus.votes(["x"], []) == [(0, 0, None)]
    assert consensus.distance(["a"], ["b"]) == 1.0 and consensus.distance([], []) == 0.0
    assert consensus.distance("x a b c d".split(), "a b c d y".split()) == pytest.approx(0.2)


def test_long_values_are_aligned_in_time():
    a, b = ["w"] * 40_000 + ["x"] + ["w"] * 40_000, ["w"] * 40_001 + ["y"] * 30_000 + ["w"] * 9_000
    assert consensus.patched(a, consensus.votes(a, b)) == b and 0 < consensus.distance(a, b) < 0.5
    c, d = [f"w{k}" for k in range(60_000)], [f"w{k}" for k in range(59_999, -1, -1)]
    assert consensus.patched(c, consensus.votes(c, d)) == d


def voted(rows, ordered):
    """The winners of one group by plain sums: rows of (member, tokens, w, o1, o2)."""
    order = lambda r: (-r[3], -r[4], r[0])
    weight = defaultdict(int)
    for r in rows:
        weight[tuple(r[1])] += r[2]
    first = {v: min((r for r in rows if tuple(r[1]) == v), key=order) for v in weight}
    rank = lambda v: order(first[v]) if ordered else (-weight[v], *order(first[v]))
    base = list(min(weight, key=rank))
    total = sum(weight.values())
    columns = defaultdict(lambda: defaultdict(int))
    for v, w in weight.items():
        for p, n, t in consensus.votes(base, list(v)):
            columns[p, n][t] += w
    won = []
    for (p, n), by in columns.items():
        top = max(by, key=lambda t: (by[t], t is not None, t or ""))
        if by[top] > total * (2 if ordered else 1) - sum(by.values()):
            won.append((p, n, top))
    agreed = consensus.patched(base, won)
    return first[min(weight, key=lambda v: (consensus.distance(list(v), agreed), -weight[v] if won else rank(v), order(first[v])))][0]


VALUES = "group bigint, field string, member bigint, value string, w bigint, o1 bigint, o2 bigint"


@pytest.mark.parametrize("ordered", [False, True])
def test_votes_of_groups(spark, ordered):
    """Small groups and one of many values, against plain sums."""
    rnd = random.Random(6)
    rows = []
    for g in range(25):
        true = [rnd.choice("abcdef") for _ in range(rnd.randint(1, 9))]
        for m in range(rnd.randint(1, 7) if g else 400):
            v = [t for t in true if rnd.random() < 0.85]
            for _ in range(rnd.randint(0, 2)):
                v.insert(rnd.randint(0, len(v)), rnd.choice("xyz"))
            if v:
                rows.append((g, "t", m, v, rnd.randint(1, 3), rnd.randint(0, 2), rnd.randint(0, 2)))
    df = spark.createDataFrame([(*r[:3], "\n".join(r[3]), *r[4:]) for r in rows], VALUES)
    got = {r.group: r.member for r in consensus.representatives(df, ordered=ordered).collect()}
    assert got == {g: voted([r[2:] for r in rows if r[0] == g], ordered) for g in {r[0] for r in rows}}
    if ordered:
        strongest = {g: min((r for r in rows if r[0] == g), key=lambda r: (-r[5], -r[6], r[2])) for g in got}
        assert got == {g: r[2] for g, r in strongest.items()}


def test_consensus_differs_from_the_strongest(spark):
    v = ["a b c d", "a b x d", "a b c d e", "b c d"]
    rows = [(1, "t", m, "\n".join(x.split()), w, w, 0) for m, x, w in zip((7, 5, 9, 4), v, (1, 3, 1, 1))]
    df = spark.createDataFrame(rows, VALUES)
    # a, b and d of the leading value hold; x has 3 of 6 votes, c has as many: a tie, which the leading one wins
    assert [r.member for r in consensus.representatives(df).collect()] == [5]
    more = spark.createDataFrame([*rows, (1, "t", 8, "a\nb\nc\nd\nf", 1, 0, 0)], VALUES)
    assert [r.member for r in consensus.representatives(more).collect()] == [7]
    assert [r.member for r in consensus.representatives(more, ordered=True).collect()] == [5]


def test_representatives(spark):
    rows = [(1, "t", 10, "a", 1, 5, 1), (1, "t", 9, "b", 1, 5, 1), (1, "t", 8, "c", 1, 4, 9), (1, "t", 9, "b", 1, 5, 1), (2, "t", 3, "z", None, None, None), (3, "t", 3, None, 1, 1, 1), (4, "t", 3, "", 1, 1, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VALUES + ", best string")
    assert {tuple(r) for r in consensus.representatives(df, ordered=True).collect()} == {(1, "t", 9), (2, "t", 3)}
    assert consensus.representatives(df.limit(0)).collect() == []


def test_order_holds_no_vote(spark, monkeypatch):
    """An order decides by itself: no value is aligned and no table of votes is written."""
    monkeypatch.setattr(consensus, "materialize", lambda *_: pytest.fail("a vote that decides nothing"))
    df = spark.createDataFrame([(1, "t", 5, "a\nb", 1, 2, 0), (1, "t", 6, "a\nc", 9, 1, 0), (1, "t", 7, "a\nc", 9, 1, 0)], VALUES)
    won = consensus.representatives(df, ordered=True)
    assert [tuple(r) for r in won.collect()] == [(1, "t", 5)]
    assert "MapInArrow" not in won._jdf.queryExecution().toString()


def test_canonical_fields(spark):
    groups = spark.createDataFrame([(1, [1, 2, 2, None, 3], [], True, 2), (1, [8, 9], [], True, 1), (2, [1, None], [], True, 1), (3, [1, 2], [], False, 1), (4, [77, 78], [], True, 1)], "group_id bigint, notes array<bigint>, pairs array<struct<a bigint, b bigint, score double>>, is_duplicate boolean, verified_at int")
    notes = spark.createDataFrame(
        [(1, "Untitled (2)", "p q\n\np q\n\nr", ["todo", None], " S1 ", 9), (2, "Weekly review", "a b c d", ["#Topic"], "none", 5), (3, "Old", None, ["x/y"], "s2", 3)],
        "note_id bigint, title string, body string, tags array<string>, source_doc string, updated int",
    ).selectExpr("*", "timestamp_ntz '2025-01-01 00:00:00' + make_interval(0,0,0,updated) as updated_at")
    sources = spark.createDataFrame([("s1", 9), ("S2", 3)], "source_doc string, trust int")
    v = consensus.member_values(groups, notes, sources)
    assert {tuple(r) for r in consensus.representatives(v, ordered=True).collect()} == {(1, "title", 3), (1, "tags", 2), (1, "body", 2)}


def test_groups_of_near_copies(spark):
    """Links and groups from classes of copies are those of all pairs."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(3))
    texts, kinds = {}, []
    for i in range(60):
        if kinds and rnd.random() < 0.7:
            w = list(rnd.choice(kinds))
            if rnd.random() < 0.6:
                for _ in range(3):
                    w[rnd.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(40)]
        kinds.append(w)
        texts[i] = " ".join(w)
    df = spark.createDataFrame([(i, x, 1) for i, x in texts.items()] + [(99, None, 2)], "id bigint, text string, n int")
    pairs = brute_copies(texts)
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    root = closure(pairs, links)
    got = {r.id: (r.group_id, r.links) for r in nearcopies.near_groups(df).collect()}
    assert got == {i: (root[i], n) for i, n in links.items()} and len(got) > 20
    assert nearcopies.near_groups(df.limit(0)).collect() == []
