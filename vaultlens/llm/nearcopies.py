"""Near-duplicate records with small edits (problem 4).

PartEnum signatures over the word runs of each body: see setjoin for the
bands of set sizes, the partition of the feature domain and the subsets. A run
that few bodies have is a subset of its own; of the others two make one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.components import connected_components
from vaultlens.llm.setjoin import expanded, mix, set_batch, set_schema, similar_classes
from vaultlens.plans.runtime import counting_rows, materialize, read_table

_WORD = re.compile(r"[^\W_]+|\0")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of the parity maps by which chance meetings are told.
MAP_WORDS = 8
#: Bodies that may have a run which is a signature by itself; of more frequent ones two make one.
RARE = 16


def word_runs(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts at once: the number of words of each, and row and hash of the different runs of size words, by row."""
    words = pa.array(_WORD.findall("\0".join((t or "").replace("\0", " ") for t in texts).lower()), pa.string()).dictionary_encode()
    known = words.dictionary.to_pylist()
    h = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
    code = words.indices.to_numpy()
    gap = code == known.index("\0") if "\0" in known else np.zeros(len(code), bool)
    row = np.cumsum(gap)
    h, row = h[code[~gap]] if len(known) else np.empty(0, np.uint64), row[~gap]
    count = np.bincount(row, minlength=len(texts))
    n = max(0, len(h) - size + 1)
    run = np.zeros(n, np.uint64)
    for k in range(size):
        run = mix(run * _A + h[k : k + n] + _B)
    inside = row[:n] == row[size - 1 : size - 1 + n]
    run, row = run[inside], row[:n][inside]
    order = np.lexsort((run, row))
    run, row = run[order], row[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    return count, row[first], run[first]


def shingles(texts: DataFrame, *, size: int = 3, least_words: int = 25, words: int = MAP_WORDS) -> DataFrame:
    """Rows of set_schema(): the different runs of size words of texts (id, text) of at least so many words."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                count, row, run = word_runs(b.column("text").to_pylist(), size)
                long = count >= max(least_words, size)
                if long.any():
                    yield set_batch(b.column("id").filter(pa.array(long)), np.bincount(row, minlength=b.num_rows)[long], run[long[row]], words)

    return texts.select("id", "text").mapInArrow(rows, set_schema(words))


def near_copies(texts: DataFrame, *, threshold: float = 0.5, size: int = 3, least_words: int = 25) -> DataFrame:
    """Pairs (a, b), a < b, of ids of similar texts; texts has id, each once, and text.

    Null and short texts have no pairs; repeated texts are pairs of each other.
    """
    return expanded(*similar_classes(shingles(texts, size=size, least_words=least_words), threshold, MAP_WORDS, RARE))


def near_groups(texts: DataFrame, *, threshold: float = 0.5, size: int = 3, least_words: int = 25) -> DataFrame:
    """id, group_id and links of every text that has a near copy: the smallest id of its group, and its number of near copies.

    Copies stay classes throughout: a class links each of its texts to the
    others, and to all texts of the classes similar to it.
    """
    pairs, members = similar_classes(shingles(texts, size=size, least_words=least_words), threshold, MAP_WORDS, RARE)
    pairs = materialize(pairs, "pairs")
    of = members.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    ends = pairs.union(pairs.select("b", "a")).toDF("id", "other").join(of.toDF("other", "n"), "other", "left")
    far = ends.groupBy("id").agg(F.sum(F.coalesce("n", F.lit(1))).alias("far"))
    group = connected_components(pairs, of.select(F.col("id").alias("node"))).toDF("id", "group_id")
    whole = group.join(far, "id", "left").join(members.select(F.col("rep").alias("id"), F.col("id").alias("member"), "n"), "id", "left")
    links = F.coalesce("far", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1
    return whole.select(F.coalesce("member", "id").alias("id"), "group_id", links.alias("links"))


def note_bodies(notes: DataFrame) -> DataFrame:
    n = counting_rows(notes.select("note_id", "body", "updated_at"), "note_id", "updated_at")
    return n.select(F.col("note_id").alias("id"), F.col("body").alias("text"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return near_copies(note_bodies(read_table(spark, sf_dir, "vault_notes"))).select(F.col("a").alias("note_id_a"), F.col("b").alias("note_id_b"))


def p4_groups(spark, sf_dir: str) -> DataFrame:
    """One row per note that has near copies: note_id, group_id and links."""
    return near_groups(note_bodies(read_table(spark, sf_dir, "vault_notes"))).withColumnRenamed("id", "note_id")
