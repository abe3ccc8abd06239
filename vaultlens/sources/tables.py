"""The vault's Parquet tables as note projections: counting rows, typed and cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.functions import text as T
from vaultlens.plans.runtime import counting_rows, read_table


def clean_list(c) -> F.Column:  # type: ignore[name-defined]
    """Different non-blank elements, stripped; an empty array for null."""
    a = F.coalesce(T.col(c), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(a, T.strip), lambda x: x.isNotNull() & (x != "")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_records in the audit dialect: titles, tags and normalised links of the counting rows."""
    n = counting_rows(read_table(spark, sf_dir, "note_records"), "note_id", "scanned_at")
    links = F.array_distinct(F.filter(F.transform(F.coalesce("links", F.array().cast("array<string>")), T.link_target), lambda x: x.isNotNull() & (x != "")))
    return n.select(
        "note_id",
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("note_type", F.lit("")).alias("note_type"),
        F.coalesce("source_doc", F.lit("")).alias("source_doc"),
        "frontmatter",
        F.coalesce("body", F.lit("")).alias("body"),
        clean_list("tags").alias("tags"),
        links.alias("links"),
        T.word_count("body").alias("words"),
    )


def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vault_notes in the dedup dialect, maps of content left out; words are counted, not believed."""
    n = counting_rows(read_table(spark, sf_dir, "vault_notes"), "note_id", "updated_at")
    n = n.where(~is_moc(F.coalesce("note_type", F.lit("")), F.coalesce("title", F.lit(""))))
    return n.select(
        "note_id",
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        clean_list("tags").alias("tags"),
        F.coalesce("note_type", F.lit("")).alias("note_type"),
        F.coalesce("source_doc", F.lit("")).alias("source_doc"),
        T.word_count("body").alias("words"),
    )


def plan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting rows of plan_notes."""
    return counting_rows(read_table(spark, sf_dir, "plan_notes"), "plan_note_id", "proposed_at")


def is_moc(note_type, title) -> F.Column:  # type: ignore[name-defined]
    """A map of content, by type or by the ending of its title."""
    return (T.col(note_type) == "moc") | T.col(title).endswith(" — MOC")
