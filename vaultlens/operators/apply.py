"""The only place where files of a vault change: applies plans that were computed before.

A plan is a DataFrame of (op, path, dest, content). Archives come first, then
writes, so that a merge never archives what it has just written. Each file is
replaced in one step and every operation may be repeated after a lost task. An
archive never replaces another one: where its name is taken, it is numbered.
"""

from __future__ import annotations

import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.operators.plan import last_per_name, render
from vaultlens.operators.rewrite import archive_path


def _put(path: str, content: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path), suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(content)
    os.replace(tmp, path)


def _archive(src: str, to: str) -> None:
    """Move a file to the first free of to, to_1, to_2, ...; a name is taken by linking, which fails where there is one."""
    os.makedirs(os.path.dirname(to), exist_ok=True)
    stem, end = os.path.splitext(to)
    for n in itertools.count():
        try:
            os.link(src, f"{stem}_{n}{end}" if n else to)
            break
        except FileExistsError:
            continue
        except OSError:  # a file system without links
            free = f"{stem}_{n}{end}" if n else to
            if os.path.exists(free):
                continue
            shutil.move(src, free)
            return
    os.unlink(src)


def apply_plan(plan: DataFrame, root: str, *, dry_run: bool = True) -> list[tuple[str, int]]:
    """Number of files per operation; changes nothing if dry_run. root must be shared by all workers."""
    if dry_run:
        return [(r[0], r[1]) for r in plan.groupBy("op").count().orderBy("op").collect()]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            done = []
            for op, path, dest, content in zip(pdf["op"], pdf["path"], pdf["dest"], pdf["content"]):
                src, to = os.path.join(root, path or ""), os.path.join(root, dest or path)
                if op == "archive":
                    if os.path.exists(src):
                        _archive(src, to)
                elif op == "write":
                    _put(to, content)
                else:
                    raise ValueError(op)
                done.append(op)
            yield pd.DataFrame({"op": done})

    out = []
    for op in ("archive", "write"):
        n = plan.where(F.col("op") == op).select("op", "path", "dest", "content").mapInPandas(run, "op string").count()
        out.append((op, n))
    return out


def archive_plan(notes: DataFrame, run_date: str, mark: str = "") -> DataFrame:
    """Archive operations for notes (path, stem): .archive/date_mark_stem.md, numbered where names meet."""
    base = F.concat(F.lit(f".archive/{run_date}_{mark}"), F.col("stem"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("path"))
    j = notes.withColumn("base", base).withColumn("n", n)
    dest = F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n") - 1)).otherwise(F.lit("")), F.lit(".md"))
    return j.select(F.lit("archive").alias("op"), "path", dest.alias("dest"), F.lit(None).cast("string").alias("content"))


def import_plan(planned: DataFrame, rendered: DataFrame) -> DataFrame:
    """Write operations of an import: planned is registry.write_plan(), rendered has plan_note_id, file_name and content.

    Notes that are skipped write nothing; of notes with one destination the
    last one counts, as later files replace earlier ones.
    """
    j = planned.where("action <> 'skip'").join(rendered, F.col("id") == F.col("plan_note_id"))
    files = j.groupBy(F.concat("folder", F.lit("/"), "file_name").alias("path")).agg(F.max_by("content", "id").alias("content"))
    return files.select(F.lit("write").alias("op"), "path", F.lit(None).cast("string").alias("dest"), "content")


def staged_plan(rendered: DataFrame) -> DataFrame:
    """Write operations that put rendered notes into a staging folder."""
    return last_per_name(rendered).select(F.lit("write").alias("op"), F.col("file_name").alias("path"), F.lit(None).cast("string").alias("dest"), "content")


def rewrite_plan(notes: DataFrame) -> DataFrame:
    """Write operations for notes (path, content) rewritten where they are."""
    return notes.select(F.lit("write").alias("op"), "path", F.lit(None).cast("string").alias("dest"), "content")


def empty_plan(notes: DataFrame, stamp: str) -> DataFrame:
    """Archive operations for empty notes (path), folders kept."""
    return notes.select(F.lit("archive").alias("op"), "path", archive_path(F.col("path"), stamp).alias("dest"), F.lit(None).cast("string").alias("content"))


def enrich_plan(results: DataFrame, notes: DataFrame, run_date: str, folder: str = "Notes") -> DataFrame:
    """Operations that write enriched notes back.

    results has note_id, the fields of a planned note (plan_note_id, title,
    tags, source_doc, note_date, note_type, body) and original_title; notes
    has note_id and path. Under its old title, or where the result names no
    old one, a note is rewritten in place; under a new one it goes to the
    notes' folder and the original to the archive.
    """
    j = results.join(render(results), "plan_note_id").join(notes.select("note_id", "path"), "note_id")
    same = F.col("title") == F.coalesce("original_title", "title")
    old = j.where(~same).select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem")).distinct()
    new = j.select(F.when(same, F.col("path")).otherwise(F.concat(F.lit(f"{folder}/"), "file_name")).alias("path"), "note_id", "content")
    return archive_plan(old, run_date).unionByName(rewrite_plan(new.groupBy("path").agg(F.max_by("content", "note_id").alias("content"))))


def enriched_titles(results: DataFrame, source: str = "Личная заметка", run_date: str = "") -> DataFrame:
    """Registry rows (source_doc, title, date) of enriched notes, for registry.upsert()."""
    return results.select(F.lit(source).alias("source_doc"), "title", F.lit(run_date).alias("date")).distinct()


def split_plan(planned: DataFrame, rendered: DataFrame, originals: DataFrame, run_date: str) -> DataFrame:
    """Operations that replace notes (path) by the planned notes they were split into, and archive them."""
    old = originals.select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem")).distinct()
    return archive_plan(old, run_date).unionByName(import_plan(planned, rendered))


def merge_plan(groups: DataFrame, notes: DataFrame, run_date: str, folder: str = "Notes") -> DataFrame:
    """Archive and write operations that merge confirmed groups into their canonical notes.

    groups has group_id, notes and the canonical fields; notes has note_id,
    path, title and source_doc. The canonical note has the source of the
    group's first note by id. A note in several groups is archived once; of
    canonical notes of one name the one of the smallest group counts.
    """
    g = groups.where("canonical_title is not null and canonical_body is not null")
    m = g.select("group_id", F.explode(F.array_distinct("notes")).alias("note_id")).join(notes.select("note_id", "path", "source_doc"), "note_id")
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    old = archive_plan(m.select("path", stem.alias("stem")).distinct(), run_date, "dedup_")
    first = m.groupBy("group_id").agg(F.min_by("source_doc", "note_id").alias("source_doc"))
    new = g.join(first, "group_id").select(
        F.col("group_id").alias("plan_note_id"), F.col("canonical_title").alias("title"), F.col("canonical_tags").alias("tags"), F.lit(run_date).alias("note_date"), "source_doc", F.lit("atomic").alias("note_type"), F.col("canonical_body").alias("body")
    )
    files = render(new).groupBy("file_name").agg(F.min_by("content", "plan_note_id").alias("content"))
    return old.unionByName(files.select(F.lit("write").alias("op"), F.concat(F.lit(f"{folder}/"), "file_name").alias("path"), F.lit(None).cast("string").alias("dest"), "content"))


def title_map(groups: DataFrame, notes: DataFrame) -> DataFrame:
    """old and new titles of merged notes, for relink()."""
    g = groups.where("canonical_title is not null")
    m = g.select(F.explode(F.array_distinct("notes")).alias("note_id"), F.col("canonical_title").alias("new"))
    return m.join(notes.select("note_id", F.col("title").alias("old")), "note_id").select("old", "new")
