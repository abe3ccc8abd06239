"""Readers, files, the apply layer and streams on small trees."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from vaultlens.operators import apply
from vaultlens.operators import plan as plan_ops
from vaultlens.sources import docx, files, vault
from vaultlens.streaming import incremental

TREE = {
    "Notes/a.md": "---\ntags: [x/y, x/y]\nnote_type: atomic\nsource_doc: \"S: 1\"\ndate: 2025-01-02\n---\n# Title A\n[[B|b]] text\r\nmore",
    "Notes/empty.md": "",
    "Notes/_under.md": "x",
    "_dir/in.md": "no front --- a: 1 --- rest",
    ".archive/old.md": "old",
    "MOCs/Map — MOC.md": "---\nnote_type: moc\n---\n",
    "bad.md": "---\n: : [\n---\nbody",
    "Notes/a.txt": "no note",
}


@pytest.fixture()
def tree(tmp_path):
    for rel, text in TREE.items():
        p = tmp_path / "v" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return str(tmp_path / "v")


def test_vault(spark, tree):
    df = vault.read_vault(spark, tree)
    assert {r.rel_path for r in df.collect()} == {k for k in TREE if k.endswith(".md") and not k.startswith(".archive")}
    assert vault.read_vault(spark, tree, skip_dirs="").count() == 7
    assert {r.stem for r in vault.read_vault(spark, tree, folder="Notes").collect()} == {"a", "empty", "_under"}
    assert {r.stem for r in vault.read_vault(spark, "file://" + tree, exclude=["a.md", "none.md"], folder="Notes", files_per_partition="1").collect()} == {"empty", "_under"}
    strict = {r.rel_path: r for r in vault.strict_notes(df).collect()}
    a = strict["Notes/a.md"]
    assert (a.title, a.note_type, a.source_doc, a.date, a.tags, a.links) == ("Title A", "atomic", "S: 1", "2025-01-02", ["x/y"], ["B"])
    assert "\r" not in a.body and strict["_dir/in.md"].body.startswith("no front") and strict["bad.md"].body == "body" and strict["bad.md"].frontmatter == "{}"
    assert strict["Notes/empty.md"].is_blank and strict["Notes/empty.md"].words == 0
    lenient = {r.rel_path: r for r in vault.lenient_notes(df).collect()}
    assert lenient["_dir/in.md"].body == "rest" and "MOCs/Map — MOC.md" not in lenient and lenient["Notes/a.md"].title == "a"
    assert vault.find_note(df, "a").first().rel_path == "Notes/a.md"
    assert vault.find_note(df, "in").first().rel_path == "_dir/in.md"
    with pytest.raises(Exception):
        vault.read_vault(spark, tree + "/none").count()


def test_vault_of_many_folders(spark, tmp_path, monkeypatch):
    """Folders below those that the driver lists are listed by the tasks."""
    monkeypatch.setattr(vault, "TREES", 2)
    want = set()
    for k in range(12):
        rel = f"f{k % 4}/g{k % 3}/h{k}/n{k}.md"
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(str(k))
        want.add(rel)
    (tmp_path / "f0/g0/.trash").mkdir()
    (tmp_path / "f0/g0/.trash/x.md").write_text("x")
    assert {r.rel_path for r in vault.read_vault(spark, str(tmp_path)).collect()} == want


def test_bad_bytes(spark, tmp_path):
    (tmp_path / "x.md").write_bytes(b"a\xff")
    assert vault.read_vault(spark, str(tmp_path), errors="replace").first().is_valid is False


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style="", run="", extra=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t>{extra}</w:r></w:p>'


def test_docx(spark, tmp_path):
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>"
    body = table + p("Intro") + p("Top", "H3") + p("Bold", run="<w:b/>") + p("both", run="<w:b/><w:i/>") + p("item", "LB2") + p("- plain") + '<w:p><w:pPr><w:numPr><w:ilvl w:val="2"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>deep</w:t></w:r></w:p>' + p("2) two") + p("", extra="<w:drawing/>") + p("") + p("Sub", "H4") + table
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H3", "heading 3"), ("H4", "heading 4"), ("LB2", "List Bullet 2")))
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    rows = docx.read_docx(spark, str(tmp_path)).orderBy("section_idx", "para_idx").collect()
    t = "| h1 | h2 |\n| --- | --- |\n| a | b |"
    assert [(r.heading, r.level, r.content) for r in rows] == [
        (None, 0, t), (None, 0, "Intro"), ("Top", 1, "**Bold**"), ("Top", 1, "***both***"), ("Top", 1, "  - item"), ("Top", 1, "- plain"), ("Top", 1, "    - deep"), ("Top", 1, "- two"), ("Top", 1, "[image]"), ("Sub", 2, t),
    ]


def test_files(spark, tmp_path):
    assert files.load_config(str(tmp_path / "none"))["vault"]["notes_folder"] == "Notes"
    with pytest.raises(FileNotFoundError):
        files.load_config(str(tmp_path / "none"), strict=True)
    (tmp_path / "c.toml").write_text('[vault]\nnotes_folder = "N"\n')
    assert files.load_config(str(tmp_path / "c.toml"))["vault"] == {"notes_folder": "N", "moc_folder": "MOCs", "source_folder": "Sources"}
    (tmp_path / "t.yaml").write_text("version: 1\ntags:\n  b: [z, a]\n  a: [q]\n")
    assert [r[0] for r in files.load_taxonomy(spark, str(tmp_path / "t.yaml")).collect()] == ["a/q", "b/a", "b/z"]
    path = str(tmp_path / "r.json")
    assert files.load_registry(spark, path).count() == 0
    files.write_json(path, {"s": {"date": None, "note_titles": ["A", "B"]}})
    assert {tuple(r) for r in files.load_registry(spark, path).collect()} == {("s", "A", ""), ("s", "B", "")}
    (tmp_path / "rev.json").write_text('{"reviewed": [{"titles": ["A", "B"], "decision": "keep"}, 5]}')
    log = files.load_reviewed(spark, str(tmp_path / "rev.json"))
    assert log.first().titles == ["A", "B"] and log.count() == 1
    files.save_reviewed(str(tmp_path / "rev2.json"), log)
    assert json.loads((tmp_path / "rev2.json").read_text()) == {"reviewed": [{"titles": ["A", "B"], "decision": "keep"}]}
    assert files.load_reviewed(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "plan.json").write_text(json.dumps({"notes": [{"id": "n1", "title": None}, {"id": "n2", "tags": ["x"]}]}))
    got = files.read_plans(spark, str(tmp_path / "plan.json")).orderBy("ord").collect()
    (tmp_path / "odd.json").write_text('{"title": "no notes"}')
    with pytest.raises(Exception, match="no notes"):
        files.read_plans(spark, str(tmp_path / "odd.json")).collect()
    assert [(r.ord, r.id, r.tags) for r in got] == [(0, "n1", None), (1, "n2", ["x"])] and json.loads(got[0].raw) == {"id": "n1", "title": None}


def test_apply(spark, tmp_path):
    (tmp_path / "Notes").mkdir()
    for n in "ab":
        (tmp_path / "Notes" / f"{n}.md").write_text(n)
    df = spark.createDataFrame([("Notes/a.md", "a"), ("Notes/b.md", "a")], "path string, stem string")
    ops = apply.archive_plan(df, "2025-01-01", "dedup_").unionByName(spark.createDataFrame([("write", "Notes/a.md", None, "merged")], "op string, path string, dest string, content string"))
    assert apply.apply_plan(ops, str(tmp_path)) == [("archive", 2), ("write", 1)] and (tmp_path / "Notes/b.md").exists()
    apply.apply_plan(ops, str(tmp_path), dry_run=False)
    assert sorted(os.listdir(tmp_path / ".archive")) == ["2025-01-01_dedup_a.md", "2025-01-01_dedup_a_1.md"]
    assert (tmp_path / "Notes/a.md").read_text() == "merged" and not (tmp_path / "Notes/b.md").exists()
    # again on the same day: no archive is replaced
    (tmp_path / "Notes/b.md").write_text("b2")
    apply.apply_plan(ops, str(tmp_path), dry_run=False)
    kept = {(tmp_path / ".archive" / n).read_text() for n in os.listdir(tmp_path / ".archive")}
    assert kept == {"a", "b", "b2", "merged"} and len(os.listdir(tmp_path / ".archive")) == 4


def test_import_stream(spark, tmp_path):
    d = lambda n: str(tmp_path / n)
    row = {"id": 1, "title": "A", "note_type": "atomic", "source_doc": "s", "date": "", "body": ""}
    os.makedirs(d("staged"))
    (tmp_path / "staged/1.json").write_text(json.dumps(row))
    for k in (1, 2):
        incremental.import_stream(spark, d("staged"), d("registry"), d("plans"), d("check")).awaitTermination()
        (tmp_path / f"staged/{k + 1}.json").write_text(json.dumps(row | {"id": k + 1}))
    plans = spark.read.parquet(d("plans")).where("action is not null")
    assert {(r.id, r.action) for r in plans.collect()} == {(1, "create"), (2, "skip")}


def test_event_windows_agree(spark, sf):
    batch = incremental.event_windows(spark.read.parquet(f"{sf}/events.parquet"))
    stream = incremental.stream_event_windows(spark, f"{sf}/events.parquet")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_catalog_runs(spark, sf):
    from vaultlens.plans import catalog

    q = catalog.queries()
    assert set(catalog.oracle_sql()) <= set(q)
    for name in ("audit_summary", "plan_violations", "registry_drift", "p6_report"):
        assert q[name](spark, sf).count() > 0
    assert F is not None


def test_merge_plan(spark, tmp_path):
    groups = spark.createDataFrame([(1, [1, 2], "A", ["x/y"], "merged"), (2, [3], None, None, None)], "group_id bigint, notes array<bigint>, canonical_title string, canonical_tags array<string>, canonical_body string")
    notes = spark.createDataFrame([(1, "Notes/A.md", "A", "s"), (2, "Notes/B.md", "B", "t"), (3, "Notes/C.md", "C", "")], "note_id bigint, path string, title string, source_doc string")
    (tmp_path / "Notes").mkdir()
    for n in "ABC":
        (tmp_path / f"Notes/{n}.md").write_text(n)
    apply.apply_plan(apply.merge_plan(groups, notes, "2025-01-01"), str(tmp_path), dry_run=False)
    assert sorted(os.listdir(tmp_path / "Notes")) == ["A.md", "C.md"] and (tmp_path / "Notes/A.md").read_text().endswith('source_doc: "s"\nnote_type: atomic\n---\n\nmerged\n')
    assert sorted(os.listdir(tmp_path / ".archive")) == ["2025-01-01_dedup_A.md", "2025-01-01_dedup_B.md"]
    assert {tuple(r) for r in apply.title_map(groups, notes).collect()} == {("A", "A"), ("B", "A")}


@pytest.fixture()
def cli(spark, monkeypatch, capsys):
    from vaultlens import __main__ as main
    from vaultlens.plans import session

    monkeypatch.setattr(session, "local_session", lambda *a, **k: spark)

    def run(*argv):
        main.main([str(x) for x in argv])
        return json.loads(capsys.readouterr().out)

    return run


def test_command_line_writes_scan_registry_and_links_whole(tmp_path, cli):
    for i in range(30):
        (tmp_path / f"n{i:02}.md").write_text(f"---\nnote_type: atomic\nsource_doc: s{i:02}\n---\n# T{i}\n[[missing {i}]]\n")
    for command, section, n in (("scan", "titles", 30), ("registry", "sources", 30), ("links", "unresolved", 30)):
        assert len(cli(command, tmp_path)[section]) == n, command
    got = cli("audit", tmp_path, "--limit", 7)
    assert len(got["thin"]) == 7 and got["summary"]["thin"] == 30 and got["summary"]["similar"] >= 0 and got["empty"] == []
    assert len(cli("scan", tmp_path, "--exclude", "n00.md", "--exclude", "n01.md")["titles"]) == 28


def vault_of(tmp_path, **notes):
    for name, text in notes.items():
        p = tmp_path / "v" / "Notes" / f"{name}.md"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "v"


def front(kind="atomic", source="s", tags=("a/b", "c/d")):
    return f"---\ntags: [{', '.join(tags)}]\ndate: 2025-01-01\nsource_doc: {source}\nnote_type: {kind}\n---\n\n"


def texts(root):
    return {os.path.relpath(os.path.join(at, f), root): open(os.path.join(at, f)).read() for at, _, fs in os.walk(root) for f in fs}


def test_commands_that_change_files_plan_first(tmp_path, cli):
    v = vault_of(tmp_path, **{"Weekly review": front() + "One two three. [[X]]", "Weekly reviews": front() + "One two three four. [[Y]]", "Other": front("source") + "See [[Weekly reviews]].", "Empty": "", "Weekly plan": front(source="t") + "Some words."})
    before = texts(v)
    assert cli("archive-empty", v)["counts"] == {"archive": 1} and texts(v) == before
    cli("archive-empty", v, "--apply", "--run-date", "2025-05-05")
    assert ".archive/empty-notes/2025-05-05/Notes/Empty.md" in texts(v) and "Notes/Empty.md" not in texts(v)
    got = cli("fix-similar", v, "--dry-run")
    assert got["actions"] == {"candidates": 1, "merge": 1, "link": 0, "ignore": 0} and not got["applied"]
    reg = tmp_path / "processed.json"
    reg.write_text(json.dumps({"s": {"date": "2025", "note_titles": ["Weekly review", "Weekly reviews"]}}))
    cli("fix-similar", v, "--apply", "--registry", reg, "--run-date", "2025-05-05")
    now = texts(v)
    assert "Notes/Weekly reviews.md" not in now and "[[Weekly review]]" in now["Notes/Other.md"] and ".archive/2025-05-05_dedup_Weekly review.md" in now
    assert "One two three four." in now["Notes/Weekly review.md"] and json.loads(reg.read_text())["s"]["note_titles"] == ["Weekly review"]
    assert cli("enrich-thin", v, "--apply")["counts"]["write"] == 2 and "## Practical Notes" in texts(v)["Notes/Weekly plan.md"]
    once = texts(v)
    cli("enrich-thin", v, "--apply")
    assert texts(v) == once
    assert cli("fix-atomic", v, "--threshold", "0.2", "--apply")["applied"] and "[[Weekly review]]" in texts(v)["Notes/Weekly plan.md"]
    (tmp_path / "m.json").write_text('{"Weekly review": "W"}')
    assert cli("relink", v, "--map", tmp_path / "m.json")["counts"]["write"] >= 1
    log = tmp_path / "reviewed.json"
    pair = cli("dedup", v, "--threshold", "0.4")["groups"]
    log.write_text(json.dumps({"reviewed": [{"titles": sorted(os.path.basename(pair[0][k])[:-3] for k in ("path_a", "path_b")), "decision": "keep"}]}))
    assert len(cli("dedup", v, "--threshold", "0.4", "--reviewed", log)["groups"]) == len(pair) - 1


def test_plans_are_generated_and_written(tmp_path, cli):
    note = lambda i, title, kind: {"id": f"n{i}", "title": title, "note_type": kind, "tags": ["a/b", "c/d"], "source_doc": "s", "date": "2025-01-02", "body": "Body"}
    plan = tmp_path / "plan.json"
    plan.write_text(json.dumps({"notes": [note(1, "A: b", "atomic"), note(2, "S — MOC", "moc"), note(3, "Known", "atomic")]}))
    cli("generate", tmp_path / "staged", "--plan", plan, "--apply")
    assert sorted(texts(tmp_path / "staged")) == ["A- b.md", "Known.md", "S — MOC.md"]
    reg = tmp_path / "processed.json"
    reg.write_text(json.dumps({"s": {"date": "", "note_titles": ["Known"]}}))
    got = cli("write", tmp_path / "v", "--plan", plan, "--registry", reg, "--apply")
    assert got["counts"] == {"notes": 1, "mocs": 1, "skipped": 1} and got["violations"] == []
    assert sorted(texts(tmp_path / "v")) == ["MOCs/S — MOC.md", "Notes/A- b.md"]
    assert json.loads(reg.read_text()) == {"s": {"source_doc": "s", "date": "2025-01-02", "note_count": 3, "note_titles": ["A: b", "Known", "S — MOC"]}}
    assert cli("doctor", tmp_path / "v", "--registry", reg)["drift"] == [{"source_doc": "s", "noted": 3, "found": 2}]
    out = tmp_path / "out.json"
    from vaultlens import __main__ as main

    main.main(["registry", str(tmp_path / "v"), "--output", str(out), "--registry", str(tmp_path / "new.json"), "--apply"])
    assert json.loads(out.read_text())["sources"][0]["note_count"] == 2 and len(json.loads((tmp_path / "new.json").read_text())["s"]["note_titles"]) == 2


RESULT = "note_id bigint, plan_note_id bigint, title string, tags array<string>, source_doc string, note_date string, note_type string, body string, original_title string"


def test_enriched_and_split_notes_are_written_back(spark, tmp_path):
    v = vault_of(tmp_path, A="old a", B="old b", C="old c", D="old d")
    row = lambda i, title, was: (i, i, title, ["x/y"], "s", "d", "atomic", f"new {i}", was)
    results = spark.createDataFrame([row(1, "A", "A"), row(2, "New B", "B"), row(3, "New C", None)], RESULT)
    notes = spark.createDataFrame([(k + 1, f"Notes/{n}.md") for k, n in enumerate("ABCD")], "note_id bigint, path string")
    apply.apply_plan(apply.enrich_plan(results, notes, "2025-01-01"), str(v), dry_run=False)
    now = texts(v)
    assert sorted(now) == [".archive/2025-01-01_B.md", "Notes/A.md", "Notes/C.md", "Notes/D.md", "Notes/New B.md"]
    assert now["Notes/A.md"].endswith("new 1\n") and now["Notes/C.md"].endswith("new 3\n")
    assert {tuple(r) for r in apply.enriched_titles(results, run_date="d").collect()} == {("Личная заметка", t, "d") for t in ("A", "New B", "New C")}
    planned = spark.createDataFrame([(2, "create", "Notes"), (1, "skip", None)], "id bigint, action string, folder string")
    apply.apply_plan(apply.split_plan(planned, plan_ops.render(results), notes.where("note_id = 4"), "2025-01-01"), str(v), dry_run=False)
    assert ".archive/2025-01-01_D.md" in texts(v) and "Notes/D.md" not in texts(v)


def test_logs_and_rule_texts(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b/c", None), (1, "a/b", "why")], "place int, tag string, reason string")
    log = str(tmp_path / "x" / "tags.md")
    assert files.append_tag_log(log, rows.limit(0), "2025-01-01", "doc") == 0 and files.append_tag_log(log, rows, "2025-01-01", "doc") == 2
    assert open(log).read() == files.TAG_LOG + "\n## 2025-01-01 — doc\n\n- `a/b`: why\n- `b/c`: \n"
    (tmp_path / "r1.md").write_text("one\n")
    (tmp_path / "r2.md").write_text("two")
    assert files.load_texts(str(tmp_path), ["r1.md", "r2.md"]) == "one\n\ntwo"
    with pytest.raises(FileNotFoundError):
        files.load_texts(str(tmp_path), ["r3.md"])
