"""Core operators on small fixtures with results worked out by hand."""

import json
import re
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlens.functions import replies
from vaultlens.operators import audit, graph, plan, prompts, registry, rewrite
from vaultlens.operators import similarity as sim
from vaultlens.plans.runtime import materialize, numbered, path_exists, scratch

NOTE = "note_id bigint, path string, title string, note_type string, source_doc string, frontmatter string, body string, tags array<string>, links array<string>, words int"


def note(i, title="T", kind="atomic", source="", fm=None, body="", tags=(), links=(), words=None):
    return (i, f"Notes/{title}.md", title, kind, source, fm, body, list(tags), list(links), len(body.split()) if words is None else words)


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), NOTE)


def test_audit(spark):
    df = notes(spark, note(1), note(2, fm='{"date": "x"}'), note(3, body="w " * 10), note(4, body="w " * 90), note(5, body="w " * 90, links=["A"]), note(6, kind="moc", body="w"))
    assert {(r.note_id, r.finding) for r in audit.audit(df).collect()} == {(1, "empty"), (3, "thin"), (4, "no_links")}
    assert tuple(audit.audit_summary(df).first()) == (6, 5, 1, 1, 1)
    assert {r[0] for r in df.where(audit.is_fix_target()).select("note_id").collect()} == {1, 2, 3, 4}
    assert tuple(audit.audit_summary(df.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_modes(spark):
    done = '{"source_doc": null, "note_type": ""}'
    para = "w " * 150
    df = notes(spark, note(1, fm=done, body="x"), note(2, body="w " * 19), note(3, body="w " * 601), note(4, body=f"{para}\n\n{para}\n \nw"), note(5, body=para), note(6, fm="broken {", body=para))
    assert [r[1] for r in audit.detect_mode(df).orderBy("note_id").collect()] == ["skip", "too_short", "atomize", "atomize", "enrich", "enrich"]


def test_links(spark):
    df = notes(spark, note(1, "A", links=["B", "X"]), note(2, "B", links=["X"]))
    assert {tuple(r) for r in audit.unresolved_links(df).collect()} == {(1, "X"), (2, "X")} or {(r.src_id, r.dst_title) for r in audit.unresolved_links(df).collect()} == {(1, "X"), (2, "X")}
    assert {tuple(r) for r in audit.link_degrees(df).collect()} == {("B", 1), ("X", 2)}


PLAN = "plan_note_id bigint, plan_id bigint, ord int, id string, title string, note_type string, tags array<string>, source_doc string, note_date string, body string"


def test_violations(spark):
    ok = ["a/b", "c/d"]
    df = spark.createDataFrame(
        [(1, 1, 0, "n1", "A", "atomic", ok, "s", "d", "b"), (2, 1, 1, "n1", "B", "moc", ok, "s", "d", "b"), (3, 2, 0, None, "C", "odd", ["x"], "s", "d", "b"), (4, 2, 1, None, "D", "atomic", None, "s", "d", None)], PLAN
    )
    got = {(r.plan_id, r.plan_note_id, r.rule) for r in plan.violations(df).collect()}
    assert got == {(1, 2, "dup_id"), (2, 3, "missing_fields"), (2, 3, "bad_type"), (2, 3, "tag_count"), (2, 4, "missing_fields"), (2, 4, "tag_count"), (2, None, "moc_count")}


def test_missing_keys(spark):
    df = spark.createDataFrame([('{"id": null, "title": 1}',)], "raw string")
    assert df.select(plan.missing_keys(F.col("raw"), ["id", "title", "body"])).first()[0] == ["body"]


def test_render(spark):
    df = spark.createDataFrame([(1, 1, 0, "n", "A: b", "atomic", ["x/y"], 'S: "q"', "2025-01-01", "Body")], PLAN)
    r = plan.render(df).first()
    assert r.file_name == "A- b.md"
    assert r.content == '---\ntags:\n  - x/y\ndate: 2025-01-01\nsource_doc: "S: \\"q\\""\nnote_type: atomic\n---\n\nBody\n'


def test_related_links(spark):
    c = lambda text, t: spark.createDataFrame([(text, t)], "c string, t string").select(rewrite.append_related(F.col("c"), F.col("t"))).first()[0]
    assert c("Body  \n", "A") == "Body\n\n## Related\n- [[A]]\n"
    assert c("Body [[A]]", "A") == "Body [[A]]"
    assert c("B\n\n## Related\n- [[X]]\n\n## More\ntext\n", "A") == "B\n\n## Related\n- [[X]]\n\n## More\ntext\n- [[A]]\n"
    df = spark.createDataFrame([("B", ["X", "Y", "X"])], "c string, t array<string>")
    assert df.select(rewrite.append_all(F.col("c"), F.col("t"))).first()[0] == "B\n\n## Related\n- [[X]]\n- [[Y]]\n"


def test_enrichment(spark):
    def c(text):
        return spark.createDataFrame([(text, ["P", "Q"])], "c string, p array<string>").select(rewrite.append_enrichment(F.col("c"), F.col("p"))).first()[0]

    once = c("Body\n\n## Related\n- [[X]]\n")
    assert once == "Body\n\n## Practical Notes\n\nP\n\nQ\n\n## Related\n- [[X]]\n"
    assert c(once) == once
    assert c("Body") == "Body\n\n## Practical Notes\n\nP\n\nQ\n"


def test_relink_is_one_pass(spark):
    m = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "D")], "old string, new string")
    rows = [(1, "[[A]] [[B]] [[A|x]] [[A#h]] A", 5), (2, "no links", 6), (3, None, 7), (4, "A]] and [[A]] see [[A", 8), (5, "[[[A]] [[A]]] [[]] [[B]]", 9), (6, "[[A", 1)]
    df = spark.createDataFrame(rows, "note_id bigint, body string, old int")
    got = {r.note_id: (r.body, r.changed) for r in rewrite.relink(df, m).collect()}
    turned = {i: None if b is None else re.sub(r"\[\[(A|B)\]\]", lambda x: "[[" + {"A": "B", "B": "C"}[x.group(1)] + "]]", b) for i, b, _ in rows}
    assert got == {i: (turned[i], turned[i] != b) for i, b, _ in rows} and got[1][0] == "[[B]] [[C]] [[A|x]] [[A#h]] A"


def test_canonical_body(spark):
    a, b = "First one here.\n\nShared paragraph of some length. [[L]]", "Shared paragraph of some length! [[L]]"
    df = spark.createDataFrame([(1, "T", a, b)], "pair_id bigint, canonical_title string, body_a string, body_b string")
    out = rewrite.canonical_bodies(df).first().body
    assert out == "T in short.\n\nFirst one here.\n\nShared paragraph of some length. [[L]]\n\n## Related\n- [[L]]"


def test_registry(spark):
    df = notes(spark, note(1, "A", source="s", fm='{"date": ""}'), note(2, "B", source="s", fm='{"date": "2025-02-01"}'), note(3, "B", source="s"), note(4, "C", source=" "))
    assert tuple(registry.rebuild(df).first()) == ("s", "2025-02-01", 2)
    old = spark.createDataFrame([("s", "A", ""), ("t", "Q", "2020")], "source_doc string, title string, date string")
    new = spark.createDataFrame([("s", "B", "2025"), ("t", "Q", "2026")], "source_doc string, title string, date string")
    assert {tuple(r) for r in registry.upsert(old, new).select("source_doc", "title", "date").collect()} == {("s", "A", "2025"), ("s", "B", "2025"), ("t", "Q", "2020")}


@pytest.mark.parametrize("policy", ["skip", "overwrite"])
def test_write_plan(spark, policy):
    staged = spark.createDataFrame([(1, "M", "moc", "s"), (2, "A", "atomic", "s"), (3, "A", "atomic", None), (4, "N", "source", "s")], "id bigint, title string, note_type string, source_doc string")
    known = spark.createDataFrame([("s", "A"), ("s", "A"), ("s", "M")], "source_doc string, title string")
    got = {r.id: (r.action, r.folder, r.registered, r.counted_as) for r in registry.write_plan(staged, known, on_conflict=policy).collect()}
    skipped = ("skip", None, False, "skipped")
    assert got == {1: ("create", "MOCs", True, "moc"), 2: skipped if policy == "skip" else ("overwrite", "Notes", True, "note"), 3: ("create", "Notes", False, "note"), 4: ("create", "Sources", True, "note")}


def test_merge_in_registry(spark):
    reg = spark.createDataFrame([("s", "A"), ("s", "B"), ("t", "C")], "source_doc string, title string")
    merged = spark.createDataFrame([("s", "A", "Z"), ("t", "C", None)], "source_doc string, title string, canonical_title string")
    assert {tuple(r) for r in registry.after_merge(reg, merged).collect()} == {("s", "B"), ("s", "Z")}


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_similar_pairs_are_those_of_the_nested_loop(spark):
    titles = ["tide", "diet", "Tide one", "tide two", "Registry of notes", "registry of note", "Note registry", "x", ""]
    tags = [["a"], ["a", "b"], [], ["a"], ["b"], ["b"], ["b", "c"], ["c"], ["c"]]
    df = notes(spark, *(note(i, t, tags=g) for i, (t, g) in enumerate(zip(titles, tags))))
    for weights, thr in ((sim.DEDUP, 0.55), (sim.AUDIT, 0.72), (sim.DEDUP, 0.3), (sim.AUDIT, 0.5), (sim.DEDUP, 0.0)):
        want = set()
        for i, j in combinations(range(len(titles)), 2):
            x, y = titles[i].lower(), titles[j].lower()
            s = weights[0] * SequenceMatcher(None, x, y).ratio() + weights[1] * jac(set(tags[i]), set(tags[j])) + weights[2] * jac(set(x.split()), set(y.split()))
            if s >= thr:
                want.add((i, j))
        got = [(r.a, r.b) for r in sim.similar_pairs(df, weights, thr).collect()]
        assert sorted(got) == sorted(want) and want
    assert sim.similar_pairs(df.limit(0), sim.AUDIT, 0.5).collect() == []


def test_tiles_are_the_nested_loop(spark, monkeypatch):
    """Parts and tiles of a few notes, also where all notes share a tag."""
    import random

    monkeypatch.setattr(sim, "PER_PART", 7)
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "of", "note", "review", "weekly"]
    rows = [note(i, " ".join(rnd.choices(words, k=rnd.randint(0, 4))), tags=["all"] * (i % 5 > 0) + rnd.sample("abcdefghijk", rnd.randint(0, 3))) for i in rnd.sample(range(500), 130)]
    df = notes(spark, *rows)
    for weights, thr in ((sim.DEDUP, 0.55), (sim.AUDIT, 0.72), (sim.AUDIT, 0.6), ((0.0, 0.6, 0.4), 0.4)):
        want = {}
        for x, y in combinations(sorted(rows), 2):
            s, t = x[2].lower(), y[2].lower()
            score = weights[0] * SequenceMatcher(None, s, t).ratio() + weights[1] * jac(set(x[7]), set(y[7])) + weights[2] * jac(set(s.split()), set(t.split()))
            if score >= thr:
                want[x[0], y[0]] = score
        got = {(r.a, r.b): r.score for r in sim.similar_pairs(df, weights, thr).collect()}
        assert got == pytest.approx(want) and len(want) > 20, (weights, thr)


def test_edges_within_a_component_are_gone_through_once(spark, monkeypatch):
    seen = []

    def counted(df, name):
        out = materialize(df, name)
        seen.append(out.count()) if name == "edges" else None
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    edges = [*combinations(range(9), 2), *combinations(range(20, 26), 2), (8, 25)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys([*range(9), *range(20, 26)], 0) and seen == [52, 1, 0]


def test_one_common_value_is_no_meeting(spark):
    """Notes with nothing but a frequent word or a frequent tag in common, which cannot be similar, do not meet."""
    df = notes(spark, *(note(i, f"{'the' if i % 2 else i} a{i} b{i} c{i}", tags=["all"] * (i % 2 == 0) + [f"{x}{i}" for x in "abcdef"]) for i in range(40)))
    alike = notes(spark, note(50, "the a1 b1 c1 d1", tags=["a1"]), note(51, "2 a2 b2", tags=[]))
    k = sim.keyed(df.unionByName(alike), sim.DEDUP)
    met = sim.meetings(k, sim.DEDUP, 0.55).groupBy("kind", "e1", "e2").count().where("count > 1").collect()
    assert max(r["count"] for r in met) == 2 and {(r.a, r.b) for r in sim.similar_pairs(df.unionByName(alike), sim.DEDUP, 0.55).collect()} == {(1, 50), (2, 51)}


def test_pairs_of_long_notes(spark):
    """Titles and lists of tags too long for couples, and short ones that meet them."""
    import random

    rnd = random.Random(3)
    words, names = [f"w{k}" for k in range(20)], [f"t{k}" for k in range(18)]
    rows = [note(i, " ".join(rnd.sample(words, rnd.choice((2, 3, 11, 14, 17)))), tags=rnd.sample(names, rnd.choice((0, 1, 2, 11, 15)))) for i in range(90)]
    for weights, thr in ((sim.DEDUP, 0.55), (sim.AUDIT, 0.72), ((0.0, 0.6, 0.4), 0.4)):
        want = {}
        for x, y in combinations(rows, 2):
            score = weights[0] * SequenceMatcher(None, x[2], y[2]).ratio() + weights[1] * jac(set(x[7]), set(y[7])) + weights[2] * jac(set(x[2].split()), set(y[2].split()))
            if score >= thr:
                want[x[0], y[0]] = score
        got = sim.similar_pairs(notes(spark, *rows), weights, thr).collect()
        assert {(r.a, r.b): r.score for r in got} == pytest.approx(want) and len(got) == len(want) > 2, (weights, thr)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=14), st.text(max_size=14), st.floats(0, 1)), max_size=8))
def test_ratios_are_left_out_only_below_the_limit(rows):
    texts = [r[0] for r in rows] + [r[1] for r in rows]
    at = np.arange(len(rows))
    for (x, y, low), got in zip(rows, sim.ratios_from(texts, at, at + len(rows), np.array([r[2] for r in rows]))):
        want = SequenceMatcher(None, x, y).ratio()
        assert got == want or got != got and want < low


def test_reviewed_and_linked(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "a bigint, b bigint, score double")
    reviewed = spark.createDataFrame([([2, 1],), ([2, 3, 4],)], "notes array<bigint>")
    assert [tuple(r)[:2] for r in sim.without_reviewed(pairs, reviewed).select("a", "b").collect()] == [(2, 3)]
    df = notes(spark, note(1, "A", links=["B"]), note(2, "B"), note(3, "C"))
    assert [(r.a, r.b) for r in sim.without_linked(pairs, df).collect()] == [(2, 3)]


def test_nearby_and_related(spark):
    df = notes(spark, note(1, "Deep registry", source="s", body="w"), note(2, "Registry ideas", source="s"), note(3, "Other words", source="s"), note(4, "Registry", source="t"), note(5, "nothing"))
    near = sim.nearby(df, sim.first_targets(df, F.col("note_id") == 1, 5))
    assert [(r.title, r.score) for r in near.orderBy("place").collect()] == [("Registry ideas", 4), ("Other words", 3), ("Registry", 1)]
    rel = sim.related(df, sim.first_targets(df, F.col("note_id") == 1, 5), threshold=0.3)
    score = lambda title, more: 0.7 * SequenceMatcher(None, "deep registry", title.lower()).ratio() + more
    want = {"Registry": score("Registry", 0.04), "Registry ideas": score("Registry ideas", 0.12), "Other words": score("Other words", 0.08)}
    got = {r.title: r.score for r in rel.collect()}
    assert got == pytest.approx({t: s for t, s in want.items() if s >= 0.3}) and len(got) >= 2


def test_nearest_is_nearby_of_all(spark):
    import random

    rnd = random.Random(4)
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta", "kappa", "zeta", "lambda", "epsilon", "omicron", "upsilon"]
    rows = [note(i, " ".join(rnd.sample(words, rnd.choice([0, 1, 1, 2, 3, 5, 9, 10, 12]))), source=rnd.choice(["", "s", "t", "u\nx"])) for i in range(160)]
    df = notes(spark, *rows)
    for t in (df, df.where("note_id % 7 = 0")):
        assert sorted(map(tuple, sim.nearest(df, t).collect())) == sorted(map(tuple, sim.nearby(df, t).collect()))


def test_enrichment_names_the_nearest_notes(spark):
    from vaultlens.plans import catalog

    df = notes(spark, note(1, "Deep ideas", source="s", body="w", links=["Zed"]), note(2, "Registry ideas", source="s", kind="moc"), note(3, "Other words", source="s", kind="moc"), note(4, "Ideas", kind="moc"), note(5, "nothing", body="w"))
    got = {r.note_id: r.content for r in catalog.enriched(df).collect()}
    assert got.keys() == {1, 5} and "[[Registry ideas]], [[Other words]], [[Ideas]]" in got[1] and "Zed" not in got[1]
    assert "no neighbours" in got[5]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=20))
def test_components(spark, edges):
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {tuple(r) for r in graph.components(df).select("node", "root").collect()} == set(root.items())


def test_groups(spark):
    chain = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14)]
    df = spark.createDataFrame([(*e, 0.5 + e[0] / 100) for e in chain], "a bigint, b bigint, score double")
    got = {(r.group_key, r.a, r.b) for r in graph.candidate_groups(df).collect()}
    assert got == {("1", 1, 2), ("1", 2, 3), ("10:10:11", 10, 11), ("10:11:12", 11, 12), ("10:12:13", 12, 13), ("10:13:14", 13, 14)}


REPLIES = ["", '{"a": 1}', '{"a": [1,', '{"a": "x', '{"a":', "```json\n{\"a\": 1}\n```", "text ```\n[1]\n``` more", "nonsense", '{"a": {"b": [{', '{"a": "}"', "x\\"]


def test_replies(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i int, t string")
    cut = [r[0] for r in df.orderBy("i").select(replies.looks_truncated("t")).collect()]
    assert cut == [True, False, True, False, True, False, False, False, True, False, True]
    got = [r[0] for r in df.orderBy("i").select(replies.reply_json(replies.fenced("t"))).collect()]
    assert [json.loads(x) if x else None for x in got] == [None, {"a": 1}, {"a": [1]}, {"a": "x"}, {}, {"a": 1}, [1], None, {"a": {"b": [{}]}}, {"a": "}"}, None]
    assert [replies.breaks_off(t) for t in REPLIES] == [True, False, True, True, True, False, False, False, True, True, False]


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


def begins(part, whole):
    """Whether part is whole as far as it was read."""
    if isinstance(whole, dict):
        return isinstance(part, dict) and list(part) == list(whole)[: len(part)] and all(begins(part[k], whole[k]) for k in part)
    if isinstance(whole, list):
        return isinstance(part, list) and len(part) <= len(whole) and all(map(begins, part, whole))
    return whole.startswith(part) if isinstance(whole, str) and isinstance(part, str) else part == whole or isinstance(whole, (int, float)) and isinstance(part, (int, float))


@settings(max_examples=500, deadline=None)
@given(st.dictionaries(st.text(max_size=4), VALUES, min_size=1, max_size=4), st.booleans(), st.data())
def test_every_beginning_of_an_object_is_repaired(value, ascii_, data):
    text = json.dumps(value, ensure_ascii=ascii_)
    cut = text[: data.draw(st.integers(1, len(text)))]
    got = replies.repair_json(cut)
    assert got is not None and begins(json.loads(got), value)
    assert json.loads(replies.repair_json('{"a": ["\\ud83d\\ude00", "\\ud83d')) == {"a": ["\U0001f600", ""]} and replies.repair_json('{"a": "\\ud83d", "b') == '{"a": "\\ud83d"}'
    assert replies.repair_json(text + "x") is None and replies.repair_json('{"a" 1') is None and replies.repair_json("") is None


def test_asking(spark):
    def rewriter(prompt):
        if prompt == "fail":
            raise RuntimeError
        return '"]}' if prompt.startswith("Continue") else '{"a": ["x'

    df = spark.createDataFrame([("p",), ("fail",)], "prompt string")
    got = {r.prompt: r.payload for r in prompts.ask(df, rewriter, tries=2, wait=0, continuations=1).collect()}
    assert got["fail"] is None and json.loads(got["p"]) == {"a": ["x"]}


def test_batches_and_their_answers(spark):
    rows = [(i, [i, i + 1]) for i in range(100, 112)]
    groups = spark.createDataFrame(rows, "group_id bigint, notes array<bigint>")
    df = notes(spark, *(note(i, f"T{i}", body="b") for i in range(100, 113)))
    asked = prompts.group_prompts(groups, df).orderBy("batch").collect()
    assert [r.groups for r in asked] == [list(range(100, 105)), list(range(105, 110)), [110, 111]] and "## Group 104" in asked[0].prompt
    replied = spark.createDataFrame(
        [(0, [100, 101], '{"groups": [{"group_id": 100, "is_duplicate": true, "confidence": 0.9, "canonical_title": "T"}, {"group_id": 105}]}'), (1, [105], None), (2, [110, 111], '{"groups": [{"group_id": 110}]}')],
        "batch bigint, groups array<bigint>, payload string",
    )
    got = {r.group_id: (r.is_duplicate, r.confidence, r.canonical_title) for r in prompts.match_groups(replied).collect()}
    assert got == {100: (True, 0.9, "T"), 110: (False, 0.0, None)}
    pairs = spark.createDataFrame([(1, 5, 6), (2, 7, 8)], "pair_id bigint, a bigint, b bigint")
    answers = spark.createDataFrame([('{"pairs": [{"pair_id": 2, "action": "merge", "confidence": 1}, {"pair_id": 9, "action": "link"}]}',), ('{"pairs": [{"pair_id": 1}]}',)], "payload string")
    assert {(r.a, r.action, r.confidence) for r in prompts.match_pairs(answers, pairs).collect()} == {(7, "merge", 1.0), (5, "ignore", 0.0)}


def test_rewriters_are_programs(tmp_path, monkeypatch):
    known = {"none": ["/no/such/program"], "upper": ["tr", "a-z", "A-Z"], "copy": ["cat"]}
    assert prompts.choose_rewriter(known)[0] == "upper" and prompts.choose_rewriter(known)[1]("ab") == "AB"
    monkeypatch.setenv("VAULTLENS_REWRITER", "copy")
    assert prompts.choose_rewriter(known)[0] == "copy" and prompts.choose_rewriter(known, "upper")[0] == "upper"
    with pytest.raises(ValueError):
        prompts.choose_rewriter(known, "other")
    with pytest.raises(Exception):
        prompts.command_rewriter(["sleep", "5"], timeout=0.2)("x")


def test_scratch_tables_are_deleted(spark):
    with scratch():
        t = materialize(spark.range(5), "t")
        path = t.inputFiles()[0]
        assert t.count() == 5 and path_exists(spark, path)
    assert not path_exists(spark, path)


def test_numbers_and_orders(spark):
    df = spark.createDataFrame([(k,) for k in range(1000, 0, -1)], "k int").repartition(7)
    assert all(r.number == r.k - 1 for r in numbered(df, "k").collect()) and numbered(df.limit(0), "k").count() == 0
    pairs = spark.createDataFrame([(3, 4, 0.8004, "B", "C"), (1, 2, 0.8001, "A", "C"), (5, 6, 0.9, "Z", "Z")], "a bigint, b bigint, score double, title_a string, title_b string")
    assert [(r.a, r.score) for r in sim.report_order(pairs).collect()] == [(5, 0.9), (1, 0.8), (3, 0.8)]
    assert {(r.a, r.pair_id) for r in sim.numbered_pairs(pairs).collect()} == {(1, 1), (3, 2), (5, 3)}
    ties = [k / 10_000 for k in range(5, 10_000, 10)]
    t = spark.createDataFrame([(x,) for x in ties], "x double").coalesce(1)
    assert [r[0] for r in t.select(sim.rounded("x")).collect()] == [round(x, 3) for x in ties]
    df = notes(spark, note(1, "A"), note(2, "A"), note(3, "B"))
    assert {tuple(r) for r in sim.note_by_title(df).collect()} == {("A", 2), ("B", 3)}
    acts = spark.createDataFrame([("merge",), ("link",), ("link",)], "action string")
    assert tuple(sim.action_counts(acts).first()) == (3, 1, 2, 0)


def test_staged_notes_in_order(spark):
    staged = spark.createDataFrame([(1, 1, "moc", "a.md"), (1, 2, "atomic", "z.md"), (1, 3, None, "b — MOC.md"), (1, 4, "source", "c.md"), (2, 5, None, "x.md")], "plan_id bigint, id bigint, note_type string, file_name string")
    assert {r.id: r.place for r in registry.write_order(staged).collect()} == {4: 1, 2: 2, 1: 3, 3: 4, 5: 1}
    planned = spark.createDataFrame([("note",), ("moc",), ("note",), ("skipped",)], "counted_as string")
    assert tuple(registry.tallies(planned).first()) == (2, 1, 1)


def test_proposed_tags(spark):
    rows = [(1, 0, 10, [("b", "r"), ("a", None)]), (1, 1, 11, [("b", "r"), ("c", "s")]), (1, 2, 12, None)]
    df = spark.createDataFrame(rows, "plan_id bigint, ord int, plan_note_id bigint, proposed_new_tags array<struct<tag string, reason string>>")
    assert [(r.place, r.tag) for r in plan.proposed_tag_log(df).orderBy("place").collect()] == [(1, "b"), (2, "a"), (3, "c")]
    assert [len(r.proposed_new_tags) for r in plan.with_defaults(df).orderBy("ord").collect()] == [2, 2, 0]


def test_title_of_a_merge(spark):
    df = spark.createDataFrame([("Long title", "Short"), ("ab", "cd"), ("a b", "b a"), ("x  y", " x y")], "a string, b string")
    assert [r[0] for r in df.coalesce(1).select(rewrite.canonical_title(F.col("a"), F.col("b"))).collect()] == ["Short", "ab", "a b", "x  y"]
