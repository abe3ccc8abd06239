"""Similarity joins of sets: shared machinery of problems 3 and 4.

Sets are arrays of 64-bit features. Equal sets are one class. A class is
entered under signatures such that any two classes above the threshold share
one, whatever their sizes:

* The features of a set are put in one global order, rare ones first. A set
  keeps all but as many of its last ones as it can do without: if a pair shares
  at least o features and each set keeps all but its last o - c, then both keep
  c common features, the c first common ones.
* A rare feature is a signature by itself, for which c = 1 is kept. Pairs whose
  first common feature is rare meet there.
* All common features of the other pairs are frequent ones. For them, sizes
  fall into bands [L, 2L); a pair meets in the band of its larger set, and a
  set enters its own band and those above it that may hold a larger partner.
  The kept frequent features are partitioned into B = c - 1 blocks by hash; two
  of the c common ones lie in the same block, so the two-feature subsets of
  each block are signatures of which the pair shares one.

How frequent a feature is, a sketch of fixed size tells: counts by hash, which
never fall short of the true ones. Any order that is the same for all sets
serves, so the sketch changes the work and never the result; in a corpus that
fills it, features it can't tell to be rare go the way of the subsets.

A pair that met under a feature by itself has its later features in common at
most, which the places of that feature bound; a parity map of each set bounds
the symmetric difference from below. Both drop chance meetings without loss;
the rest is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.plans.runtime import materialize

#: Share of the surest common features that the blocks are spread over.
SPREAD = 0.4
#: Sets that may have a feature which is a signature by itself.
RARE = 256
#: Counters of the sketch, and those that travel together while it is summed.
CELLS, BLOCK = 1 << 20, 1 << 11
#: Sets whose signatures are made at once.
AT_ONCE = 4000
_EPS = 1e-9
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MAP, _KEY, _CELL = np.uint64(0x5BD1E995), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def set_schema(words: int) -> str:
    """id, f, m (the number of features), k1 and k2 (equal for equal sets) and the words b0, b1, ... of a parity map."""
    return "id bigint, f array<bigint>, m int, k1 bigint, k2 bigint" + "".join(f", b{k} bigint" for k in range(words))


def set_batch(ids: pa.Array, sizes: np.ndarray, flat: np.ndarray, words: int) -> pa.RecordBatch:
    """Rows of set_schema() of sets whose features (uint64) follow each other in flat; no set is empty."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    start = offsets[:-1]
    once, twice = mix(flat), mix(flat ^ _KEY)
    k1, k2 = np.add.reduceat(once, start), np.add.reduceat(twice, start)
    cell = mix(flat ^ _MAP) % np.uint64(64 * words)
    bit = np.uint64(1) << (cell & np.uint64(63))
    maps = [np.bitwise_xor.reduceat(np.where(cell >> np.uint64(6) == k, bit, np.uint64(0)), start) for k in range(words)]
    f = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
    cols = [ids, f, pa.array(sizes.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (k1, k2, *maps))]
    return pa.RecordBatch.from_arrays(cols, names=["id", "f", "m", "k1", "k2", *(f"b{k}" for k in range(words))])


def described(features: DataFrame, words: int) -> DataFrame:
    """Rows of set_schema() of sets (id, f)."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                f = b.column("f")
                yield set_batch(b.column("id"), np.diff(f.offsets.to_numpy()).astype(np.int64), f.flatten().to_numpy().view(np.uint64), words)

    return features.select("id", "f").mapInArrow(rows, set_schema(words))


def _cells(flat: np.ndarray) -> np.ndarray:
    return (mix(flat ^ _CELL) % np.uint64(CELLS)).astype(np.int64)


def _sums(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks of counters of one number added up."""
    total: dict[int, np.ndarray] = {}
    for k, x in parts:
        total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def frequency_classes(sets: DataFrame) -> np.ndarray:
    """For each cell of the sketch the frequency of its features, eight classes to each doubling; 0: one set at most.

    Every task counts all features of its sets; the counters are added up by
    block, and the driver gets a fixed number of bytes, however large the
    corpus.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for b in it:
            counts += np.bincount(_cells(b.column("f").flatten().to_numpy().view(np.uint64)), minlength=CELLS)
        if counts.any():
            yield from _sums((k, counts[k * BLOCK : (k + 1) * BLOCK]) for k in range(CELLS // BLOCK))

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sums((k, np.frombuffer(x, np.int64)) for b in it for k, x in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()))

    def classes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merge(it):
            of = [np.minimum(127, np.floor(np.log2(np.maximum(np.frombuffer(x, np.int64), 1)) * 8)).astype(np.uint8).tobytes() for x in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(of, pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros(CELLS, np.uint8)
    for r in sets.select("f").mapInArrow(count, schema).repartition("block").mapInArrow(classes, schema).collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint8)
    return out


def bands(m: int, t: float) -> list[tuple[int, int, int]]:
    """(band, features to keep, blocks) for each band that a set of m features enters; 0 blocks: single features."""
    out = []
    own = int(math.log2(m))
    j = own
    while (low := 1 << j) <= m / t + _EPS:
        least = math.ceil(t * low - _EPS)  # what any pair of the band shares at least
        c = min(least, 2 + int(SPREAD * least))
        o = math.ceil(t * m - _EPS) if j == own else math.ceil(t / (1 + t) * (m + low) - _EPS)
        if o <= m:
            out.append((j, min(m, m - o + c), c - 1))
        j += 1
    return out


def signatures(sizes: np.ndarray, x: np.ndarray, often: np.ndarray, t: float, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, place) of many sets at once.

    Of each row sizes has the number of features; x has these (uint64) row
    after row, often their classes of frequency. The place is that of a rare
    feature in its set; -1 marks subsets.
    """
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    order = np.lexsort((x, often, row))
    x, often = x[order], often[order]
    start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    rank = np.arange(len(x)) - np.repeat(start, sizes)
    frequent = often > math.log2(rare) * 8
    alone = (rank <= sizes[row] - np.ceil(t * sizes[row] - _EPS)) & ~frequent & (often > 0)
    table = {int(m): bands(int(m), t) for m in np.unique(sizes)}
    depth = max(map(len, table.values()), default=0)
    keep, blocks, band = (np.zeros((depth, n), np.int64) for _ in range(3))
    for m, of in table.items():
        at = sizes == m
        for k, (j, p, b) in enumerate(of):
            band[k, at], keep[k, at], blocks[k, at] = j, p, b
    sig, who, place = [mix(x[alone])], [row[alone]], [rank[alone]]
    for k in range(depth):
        kept = frequent & (rank < keep[k][row])
        f, r = x[kept], row[kept]
        b, j = blocks[k][r], band[k][r].astype(np.uint64)
        base = mix(f + (j + np.uint64(1)) * _KEY)
        one = b == 0
        sig.append(base[one])
        who.append(r[one])
        f, r, b, base = f[~one], r[~one], b[~one], base[~one]
        block = (mix(f ^ _CELL) % b.astype(np.uint64)).astype(np.int64)
        o = np.lexsort((f, block, r))
        r, block, base = r[o], block[o], base[o]
        group = np.concatenate(([0], np.cumsum((r[1:] != r[:-1]) | (block[1:] != block[:-1])))) if len(r) else r
        d = 1
        while d < len(r):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            sig.append(mix(base[:-d][same] * np.uint64(3) + base[d:][same]))
            who.append(r[:-d][same])
            d += 1
    place += [np.full(len(w), -1) for w in who[1:]]
    return np.concatenate(sig).view(np.int64), np.concatenate(who), np.concatenate(place)


def signature_rows(sets: DataFrame, t: float, rare: int = RARE) -> DataFrame:
    """sig, id, m and place: a row for each signature of each set of set_schema()."""
    spark = sets.sparkSession
    sketch = spark.sparkContext.broadcast(frequency_classes(sets))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a in range(0, b.num_rows, AT_ONCE):
                part = b.slice(a, AT_ONCE)
                f = part.column("f")
                x = f.flatten().to_numpy().view(np.uint64)
                sig, who, place = signatures(np.diff(f.offsets.to_numpy()).astype(np.int64), x, sketch.value[_cells(x)], t, rare)
                cols = [part.column(c).to_numpy()[who] for c in ("id", "m")]
                yield pa.RecordBatch.from_arrays([pa.array(sig), *map(pa.array, cols), pa.array(place.astype(np.int32))], names=["sig", "id", "m", "place"])

    return sets.select("id", "m", "f").mapInArrow(rows, "sig bigint, id bigint, m int, place int")


def similar_sets(sets: DataFrame, copies: DataFrame, t: float, words: int, rare: int = RARE) -> DataFrame:
    """Pairs (a, b), a < b, of different sets whose Jaccard similarity is t or more.

    sets has rows of set_schema(), written; copies has the ids that are left
    out, as another id stands for them.
    """
    own = sets.join(copies, "id", "left_anti")
    s = signature_rows(own, t, rare)
    x, y = s.alias("x"), s.alias("y")
    c = lambda n, k: F.col(f"{n}.{k}")
    mx, my = c("x", "m"), c("y", "m")
    common = F.ceil(t / (1 + t) * (mx + my) - _EPS)  # what a similar pair of such sizes shares at least
    may = (c("x", "id") < c("y", "id")) & (F.least(mx, my) >= t * F.greatest(mx, my) - _EPS)
    may &= (c("x", "place") <= mx - common) & (c("y", "place") <= my - common)
    # the planner takes the signatures for as few bytes as the sets; a shuffled join is what their number asks for
    met = x.join(y.hint("merge"), (c("x", "sig") == c("y", "sig")) & may).select(c("x", "id").alias("a"), c("y", "id").alias("b")).distinct()
    maps = [f"b{k}" for k in range(words)]
    side = lambda n: sets.select(F.col("id").alias(n), F.col("m").alias(f"m{n}"), *[F.col(k).alias(f"{n}{k}") for k in maps])
    apart: Column = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in maps), F.lit(0))
    near = met.join(side("a"), "a").join(side("b"), "b").where(apart <= (1 - t) / (1 + t) * (F.col("ma") + F.col("mb")) + _EPS)
    near = materialize(near.select("a", "b"), "candidates")
    of = lambda n: sets.select(F.col("id").alias(n), F.col("f").alias(f"f{n}"))
    both = near.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("fa", "fb"))
    return both.where(shared >= t * (F.size("fa") + F.size("fb") - shared) - _EPS).select("a", "b")


def classes_of(sets: DataFrame) -> DataFrame:
    """rep, id and n of every set that has copies; the smallest id stands for its class of n."""
    of = sets.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return sets.select("id", "k1", "k2").join(of, ["k1", "k2"]).select("rep", "id", "n")


def similar_classes(sets: DataFrame, t: float, words: int, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of class representatives whose Jaccard similarity is t or more, and the classes (rep, id, n) of copies.

    sets has rows of set_schema(), each id once. Of words, the length of the
    parity maps in 64 bits, and rare only the work depends, not the result.
    """
    sets = materialize(sets, "sets")
    members = materialize(classes_of(sets), "members")
    return similar_sets(sets, members.where("rep <> id").select("id"), t, words, rare), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of ids that similar_classes() found, copies named in full."""
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    far = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"))
    near = a.join(b, F.col("a") == F.col("b")).where("ia < ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    return far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(near)


def similar_pairs(features: DataFrame, t: float, words: int, rare: int = RARE) -> DataFrame:
    """Pairs (a, b), a < b, of all ids whose sets have a Jaccard similarity of t or more.

    features has id (each once) and f, an array of different 64-bit features,
    never empty. Copies are compared once, as a class, and only the result
    names all their pairs.
    """
    return expanded(*similar_classes(described(features, words), t, words, rare))
