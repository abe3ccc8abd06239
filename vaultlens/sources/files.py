"""Small files at the edges: configuration, taxonomy, registry, review log, plans."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {"vault": {"notes_folder": "Notes", "moc_folder": "MOCs", "source_folder": "Sources"}, "rclone": {"staging_dir": "/tmp/vaultlens"}}
PLAN = "notes array<struct<id string, title string, note_type string, tags array<string>, source_doc string, date string, body string, proposed_new_tags array<struct<tag string, reason string>>>>, proposed_tags array<struct<tag string, reason string>>"


def load_config(path: str, strict: bool = False) -> dict:
    """Settings of a TOML file over the defaults; a missing file is an error only if strict."""
    if not os.path.exists(path):
        if strict:
            raise FileNotFoundError(path)
        return {k: dict(v) for k, v in DEFAULTS.items()}
    with open(path, "rb") as f:
        found = tomllib.load(f)
    return {k: DEFAULTS.get(k, {}) | found.get(k, {}) for k in {*DEFAULTS, *found}}


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """tag: domain/subtag of a YAML taxonomy, sorted."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    tags = [(f"{d}/{s}",) for d, subs in (found.get("tags") or {}).items() for s in subs or []]
    return spark.createDataFrame(tags, "tag string").orderBy("tag")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """source_doc, title, date of a JSON registry; none if it is missing or broken."""
    schema = "source_doc string, title string, date string"
    try:
        found = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        found = {}
    rows = [(k, t, v.get("date") or "") for k, v in found.items() if isinstance(v, dict) for t in v.get("note_titles") or []]
    return spark.createDataFrame(rows, schema)


def load_reviewed(spark: SparkSession, path: str) -> DataFrame:
    """titles, decision, date, confidence of a JSON review log {"reviewed": [...]}; none if it is missing or broken."""
    schema = "titles array<string>, decision string, date string, confidence double"
    try:
        found = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        found = {}
    entries = found.get("reviewed") if isinstance(found, dict) else None
    rows = [(x.get("titles"), x.get("decision"), x.get("date"), x.get("confidence")) for x in entries or [] if isinstance(x, dict)]
    return spark.createDataFrame(rows, schema)


def save_reviewed(path: str, reviewed: DataFrame) -> None:
    """Replace a review log by the rows of load_reviewed(); decisions of reviewers, so few enough for one file."""
    keep = ("titles", "decision", "date", "confidence")
    write_json(path, {"reviewed": [{k: r[k] for k in keep if r[k] is not None} for r in reviewed.select(*keep).toLocalIterator()]})


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """plan, ord and the fields of the notes of JSON plans, with raw, each note as written; a plan without notes is an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("plan"), "value")
    listed = F.get_json_object("value", "$.notes")
    missing = F.raise_error(F.concat(F.lit("no notes in plan "), "plan"))
    raw = F.from_json(F.when(listed.isNull() | ~listed.startswith("["), missing).otherwise(listed), "array<string>")
    typed = F.from_json("value", PLAN)["notes"]
    return files.select("plan", F.posexplode(F.arrays_zip(typed.alias("note"), raw.alias("raw"))).alias("ord", "x")).select("plan", "ord", "x.note.*", "x.raw")


def write_registry(path: str, rows: DataFrame) -> None:
    """Replace a JSON registry by rows (source_doc, title, date); titles are sorted and counted.

    A registry is one document, so it is written by the driver, which gets one
    source after another.
    """
    out: dict = {}
    for r in rows.select("source_doc", "title", "date").orderBy("source_doc", "title").toLocalIterator():
        of = out.setdefault(r.source_doc, {"source_doc": r.source_doc, "date": r.date or "", "note_count": 0, "note_titles": []})
        if r.title not in of["note_titles"][-1:]:
            of["note_titles"].append(r.title)
            of["note_count"] += 1
        of["date"] = of["date"] or r.date or ""
    write_json(path, out)


#: How a log of proposed tags begins.
TAG_LOG = "# Proposed New Tags\n\nTags that are not in the taxonomy yet. Review them and add what fits.\n"


def append_tag_log(path: str, proposals: DataFrame, run_date: str, source: str) -> int:
    """Append one plan's proposals (place, tag, reason) to a log, which begins with a header; the number of proposals."""
    rows = proposals.orderBy("place").toLocalIterator()
    lines = [f"- `{r.tag or '<unknown>'}`: {r.reason or ''}" for r in rows]
    new = not os.path.exists(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(TAG_LOG * new + ("\n".join(["", f"## {run_date} — {source}", "", *lines, ""]) if lines else ""))
    return len(lines)


def load_texts(folder: str, names: list[str]) -> str:
    """Rule texts of a folder, one after the other, for the prompts; a missing one is an error."""
    return "\n\n".join(Path(folder, n).read_text("utf-8").strip() for n in names)


def write_json(path: str, value: object) -> None:
    """Replace a JSON file in one step: a temporary file beside it, then a rename."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(tmp, path)
