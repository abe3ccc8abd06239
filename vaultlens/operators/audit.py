"""Quality audit of a vault: empty, thin and unlinked notes, modes, link checks.

Every operator takes the note projection of sources.tables and is one pass of
native expressions, or an equi-join with the titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import text as T

MIN_WORDS = 80


def no_frontmatter() -> Column:
    return T.is_blank("frontmatter") | F.trim("frontmatter").isin("{}", "null", "[]")


def is_empty() -> Column:
    """No words and no frontmatter, of any type."""
    return (F.col("words") == 0) & no_frontmatter()


def is_thin(min_words: int = MIN_WORDS) -> Column:
    """An atomic note with some words, but fewer than wanted."""
    return (F.col("note_type") == "atomic") & F.col("words").between(1, min_words - 1)


def is_linkless(min_words: int = MIN_WORDS) -> Column:
    """An atomic note of sufficient length that links to nothing."""
    return (F.col("note_type") == "atomic") & (F.col("words") >= min_words) & (F.size("links") == 0)


def is_fix_target(min_words: int = MIN_WORDS) -> Column:
    """An atomic note that is short, even without words, or links to nothing."""
    return (F.col("note_type") == "atomic") & ((F.col("words") < min_words) | (F.size("links") == 0))


def audit(notes: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """note_id, title, words and the audit's finding of every note that has one."""
    found = F.when(is_empty(), "empty").when(is_thin(min_words), "thin").when(is_linkless(min_words), "no_links")
    return notes.select("note_id", "title", "words", found.alias("finding")).where("finding is not null")


def audit_summary(notes: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Counts of notes, atomic notes and findings in one row."""
    return notes.agg(
        F.count("*").alias("notes"),
        F.count_if(F.col("note_type") == "atomic").alias("atomic"),
        F.count_if(is_empty()).alias("empty"),
        F.count_if(is_thin(min_words)).alias("thin"),
        F.count_if(is_linkless(min_words)).alias("no_links"),
    )


def with_similar(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """An audit_summary() with the number of similar pairs."""
    return summary.join(pairs.agg(F.count("*").alias("similar")))


def detect_mode(notes: DataFrame) -> DataFrame:
    """note_id and mode: skip, too_short, atomize or enrich, in this order of checks.

    A note that has both keys source_doc and note_type in its frontmatter,
    whatever their values, was processed before and is skipped.
    """
    keys = F.json_object_keys("frontmatter")
    done = F.coalesce(F.array_contains(keys, "source_doc") & F.array_contains(keys, "note_type"), F.lit(False))
    w, parts = F.col("words"), F.size(T.paragraphs("body"))
    mode = F.when(done, "skip").when(w < 20, "too_short").when((w > 600) | (parts >= 3) & (w > 300), "atomize").otherwise("enrich")
    return notes.select("note_id", mode.alias("mode"))


def link_edges(notes: DataFrame) -> DataFrame:
    """src_id, src_title and dst_title of every link of the vault."""
    return notes.select(F.col("note_id").alias("src_id"), F.col("title").alias("src_title"), F.explode("links").alias("dst_title"))


def link_degrees(notes: DataFrame) -> DataFrame:
    """title and the number of notes that link to it; counted before the shuffle, so hot targets are no burden."""
    return link_edges(notes).groupBy(F.col("dst_title").alias("title")).agg(F.count("*").alias("incoming"))


def unresolved_links(notes: DataFrame) -> DataFrame:
    """Links whose target is the title of no note: src_id, dst_title."""
    titles = notes.select(F.col("title").alias("dst_title")).distinct()
    return link_edges(notes).select("src_id", "dst_title").join(titles, "dst_title", "left_anti")


def titles_by_folder(titles: DataFrame) -> DataFrame:
    """folder, title and copies of the titles not archived; sorted output is the sink's task.

    One row per title and folder rather than one list per folder: a folder may
    hold a large share of the vault.
    """
    live = titles.where(F.col("archived_at").isNull() & F.col("title").isNotNull())
    return live.groupBy("folder", "title").agg(F.countDistinct("title_id").alias("copies"))


def title_collisions(plans: DataFrame, titles: DataFrame) -> DataFrame:
    """Planned notes, maps of content apart, whose title is taken: plan_note_id, title."""
    taken = titles.where(F.col("archived_at").isNull()).select("title").distinct()
    return plans.where(F.coalesce(F.col("note_type") != "moc", F.lit(True))).select("plan_note_id", "title").join(taken, "title", "left_semi").select("plan_note_id", "title")
