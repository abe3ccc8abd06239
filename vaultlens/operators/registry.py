"""The registry of processed sources: rebuild, upsert, drift and write plans.

The registry is kept in row form, a row per source and title, from which
counts and dates are aggregates: a source may hold a large part of a vault and
its titles never become one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.functions import text as T

FOLDERS = {"moc": "MOCs", "source": "Sources"}


def titles_of_sources(notes: DataFrame) -> DataFrame:
    """source_doc, title, date and path of notes that name their source."""
    date = F.get_json_object("frontmatter", "$.date")
    return notes.where(~T.is_blank("source_doc")).select("source_doc", "title", F.coalesce(date, F.lit("")).alias("date"), "path")


def rebuild(notes: DataFrame) -> DataFrame:
    """source_doc, date (the first non-empty one by path) and note_count (different titles)."""
    first = F.min(F.when(F.col("date") != "", F.struct("path", "date")))
    r = titles_of_sources(notes).groupBy("source_doc").agg(first.getField("date").alias("date"), F.countDistinct("title").alias("note_count"))
    return r.select("source_doc", F.coalesce("date", F.lit("")).alias("date"), "note_count")


def upsert(registry: DataFrame, added: DataFrame) -> DataFrame:
    """Rows (source_doc, title, date) of a registry after an import; a date is filled only where there was none."""
    both = registry.select("source_doc", "title", F.struct(F.when(F.col("date") == "", 2).otherwise(0).alias("o"), "date").alias("d"))
    both = both.unionByName(added.select("source_doc", "title", F.struct(F.when(F.col("date") == "", 3).otherwise(1).alias("o"), "date").alias("d")))
    dates = both.groupBy("source_doc").agg(F.min("d").getField("date").alias("date"))
    return both.select("source_doc", "title").distinct().join(dates, "source_doc")


def drift(registry: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """source_doc, noted and found where the registry's count differs from the vault's; -1 for a missing count."""
    r = registry.select("source_doc", F.coalesce("note_count", F.lit(-1)).cast("bigint").alias("noted"))
    f = rebuilt.select("source_doc", F.col("note_count").cast("bigint").alias("found"))
    return r.join(f, "source_doc", "left").select("source_doc", "noted", F.coalesce("found", F.lit(0)).alias("found")).where("noted <> found")


def write_plan(staged: DataFrame, registered: DataFrame, *, on_conflict: str = "skip", folders: dict[str, str] = FOLDERS, notes_folder: str = "Notes") -> DataFrame:
    """What an import does with each staged note: id, title, action, folder, registered, counted_as.

    staged has id, title, note_type, source_doc; registered has source_doc and
    title. Maps of content and notes without a source are always created. A
    note that its source already registered is skipped or overwritten.
    """
    if on_conflict not in ("skip", "overwrite"):
        raise ValueError(on_conflict)
    known = registered.select(F.col("source_doc").alias("__s"), F.col("title").alias("__t"), F.lit(True).alias("__known")).distinct()
    s = staged.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("note_type", F.lit("")).alias("note_type"), F.coalesce("source_doc", F.lit("")).alias("source_doc"))
    j = s.join(known, (F.col("source_doc") == F.col("__s")) & (F.col("title") == F.col("__t")), "left")
    moc = F.col("note_type") == "moc"
    clash = ~moc & (F.col("source_doc") != "") & F.coalesce("__known", F.lit(False))
    action = F.when(clash, on_conflict).otherwise("create")
    folder = F.lit(notes_folder)
    for kind, f in folders.items():
        folder = F.when(F.col("note_type") == kind, f).otherwise(folder)
    skipped = action == "skip"
    return j.select(
        "id", "title", action.alias("action"), F.when(~skipped, folder).alias("folder"), (~skipped & (F.col("source_doc") != "")).alias("registered"),
        F.when(skipped, "skipped").when(moc, "moc").otherwise("note").alias("counted_as"),
    )


def write_order(staged: DataFrame) -> DataFrame:
    """plan_id, id and place of staged notes (plan_id, id, note_type, file_name): maps of content last, each part by name."""
    moc = (F.coalesce("note_type", F.lit("")) == "moc") | F.col("file_name").endswith(" — MOC.md")
    w = Window.partitionBy("plan_id").orderBy(moc, "file_name", "id")
    return staged.select("plan_id", "id", F.row_number().over(w).alias("place"))


def tallies(planned: DataFrame) -> DataFrame:
    """What write_plan() counts in one row: notes (all but maps of content), mocs and skipped ones."""
    count = lambda kind: F.count_if(F.col("counted_as") == kind)
    return planned.agg(count("note").alias("notes"), count("moc").alias("mocs"), count("skipped").alias("skipped"))


def supplement(staged: DataFrame, plan: DataFrame) -> DataFrame:
    """Fill empty note_type and source_doc from the plan by title; of equal titles the last in the plan wins."""
    last = plan.where("title is not null").groupBy("title").agg(F.max_by(F.struct("note_type", "source_doc"), F.struct("plan_id", "ord", "plan_note_id")).alias("p"))
    j = staged.join(last, "title", "left")
    fill = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.coalesce(F.col(f"p.{c}"), F.lit(""))).otherwise(F.col(c)).alias(c)
    return j.select(*[fill(c) if c in ("note_type", "source_doc") else c for c in staged.columns])


def after_merge(registry: DataFrame, merged: DataFrame) -> DataFrame:
    """Registry rows (source_doc, title) after merges: old titles leave their source, canonical ones enter the first note's source.

    merged has source_doc and title of each merged note and, on the first note
    of a group, canonical_title.
    """
    gone = merged.select("source_doc", "title").distinct()
    new = merged.where("canonical_title is not null and source_doc <> ''").select("source_doc", F.col("canonical_title").alias("title"))
    return registry.select("source_doc", "title").join(gone, ["source_doc", "title"], "left_anti").unionByName(new).distinct()
