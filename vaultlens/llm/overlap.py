"""All similar pairs between set-valued records (problem 3).

Records meet under values they contain, the rarest first: of each as many as the
bound on the symmetric difference of two similar records demands, so that any
two similar ones share one, and are compared exactly (see setjoin). These are
not the pivots of a metric partitioning, in which nearly every record would
have to be entered in nearly every cell: see the README for figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import text as T
from vaultlens.llm.setjoin import similar_pairs
from vaultlens.plans.runtime import counting_rows, read_table


def note_values(notes: DataFrame) -> DataFrame:
    """id and f, the different tags and links of each counting row of note_records.

    Null, blank and repeated elements and null arrays add nothing; a tag never
    equals a link.
    """
    n = counting_rows(notes.select("note_id", "tags", "links", "scanned_at"), "note_id", "scanned_at")
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.lower(F.regexp_replace(x, f"^(?:{T.WS}|#)+|{T.WS}+$", "")))
    links = F.transform(F.coalesce("links", F.array().cast("array<string>")), T.target_key)
    some = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    f = F.concat(F.transform(some(tags), lambda x: F.xxhash64(F.lit("tag"), x)), F.transform(some(links), lambda x: F.xxhash64(F.lit("link"), x)))
    return n.select(F.col("note_id").alias("id"), F.array_sort(F.array_distinct(f)).alias("f"))


def overlapping(notes: DataFrame, *, threshold: float = 0.7, least: int = 4) -> DataFrame:
    """note_id_a, note_id_b of the pairs of notes with at least so many values and so high a similarity."""
    f = note_values(notes).where(F.size("f") >= least)
    return similar_pairs(f, threshold, words=1).select(F.col("a").alias("note_id_a"), F.col("b").alias("note_id_b"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return overlapping(read_table(spark, sf_dir, "note_records"))
