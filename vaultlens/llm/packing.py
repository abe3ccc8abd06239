"""Filling fixed-capacity containers with items of varying length (problem 8).

The global histogram of lengths, which capacity bounds, is all the driver sees.
Dynamic programming over it chooses the bucket boundaries that minimise the
padding from an item's length to its bucket's boundary. Batches are formed
under the token budget of a container, as counts per bucket: either inside
each bucket alone, or, to leave less room, opened by the longest bucket left and
filled up from the longest buckets that still fit. A batch is repeated as often
as the counts allow, so a plan has few kinds of batch however many items there
are. An item's rank in its bucket finally names its container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.llm.tokenize import token_counts
from vaultlens.plans.runtime import materialize, read_table

#: Buckets per capacity.
BUCKETS = 128


#: Items of a bucket that one task ranks.
PER_SALT = 100_000


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most so many buckets with the least padding; lengths ascend.

    The best place of a boundary never moves down as the last length grows, so
    each bucket takes the time of sorting: the middle lengths of all open
    ranges are decided together, then the halves to either side.
    """
    m = len(lengths)
    if m <= buckets:
        return lengths
    top = np.concatenate(([0.0], lengths.astype(np.float64)))
    n = np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    s = np.concatenate(([0.0], np.cumsum(counts.astype(np.float64) * lengths)))
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    came = np.zeros((buckets, m + 1), np.int64)
    for k in range(buckets):
        now = np.full(m + 1, np.inf)
        now[0] = 0.0
        lo, hi, least, most = (np.array([x]) for x in (1, m, 0, m - 1))
        while len(lo):
            mid = (lo + hi) // 2
            width = np.minimum(mid - 1, most) - least + 1
            first = np.cumsum(width) - width
            of = np.repeat(np.arange(len(mid)), width)
            i = np.arange(width.sum()) - np.repeat(first - least, width)
            j = mid[of]
            cost = best[i] + top[j] * (n[j] - n[i]) - (s[j] - s[i])
            now[mid] = np.minimum.reduceat(cost, first)
            hit = np.flatnonzero(cost == now[j])
            at = i[hit[np.unique(of[hit], return_index=True)[1]]]
            came[k, mid] = at
            lo, hi, least, most = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (least, at), (at, most)))
            some = lo <= hi
            lo, hi, least, most = lo[some], hi[some], least[some], most[some]
        best = now
    out, j = [], m
    for k in reversed(range(buckets)):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = came[k, j]
    return np.array(sorted(out))


def batch_plan(bounds: np.ndarray, counts: np.ndarray, capacity: int, *, mixed: bool = True) -> list[tuple[dict[int, int], int]]:
    """Batches (items per bucket) and how often each is repeated; every item is in one of them."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    if not mixed:
        for k, c in enumerate(left.tolist()):
            per = capacity // int(bounds[k])
            plan += [({k: n}, times) for n, times in ((per, c // per), (c % per, 1)) if n and times]
        return plan
    top = len(bounds) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            return plan
        room, batch, k = capacity, {}, top
        while k >= 0 and room >= bounds[0]:
            k = min(k, int(np.searchsorted(bounds, room, "right")) - 1)
            if k < 0:
                break
            fit = min(int(left[k]), int(room // bounds[k])) if left[k] else 0
            if fit:
                batch[k] = fit
                room -= fit * int(bounds[k])
            k -= 1
        times = min(int(left[k]) // n for k, n in batch.items())
        for k, n in batch.items():
            left[k] -= n * times
        plan.append((batch, times))


def container_finder(ranges: dict[str, dict[int, list[tuple[int, int, int]]]]):
    """Column function (kind, bucket, rank) -> container, of each bucket's ranges of ranks (low, items per container, first container)."""
    tables = {(kind, b): tuple(np.array(x) for x in zip(*of)) for kind, by in ranges.items() for b, of in by.items()}

    @F.pandas_udf("bigint")
    def container(kind: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(rank), np.int64)
        for key, at in pd.Series(rank.to_numpy()).groupby([kind.to_numpy(), bucket.to_numpy()]):
            low, per, base = tables[key]
            r = at.to_numpy()
            k = np.searchsorted(low, r, "right") - 1
            out[at.index] = base[k] + (r - low[k]) // per[k]
        return pd.Series(out)

    return container


def pack(items: DataFrame, kinds: dict[str, int], *, buckets: int = BUCKETS, mixed: bool = True) -> DataFrame:
    """container_kind, container_id, doc_id, piece_no and n_tokens of every piece of every item.

    items has doc_id and n_tokens (bigint), each id once; kinds are the few
    containers and their capacities. An item above the capacity is cut into
    full pieces and a rest, all others stay whole. An item without tokens
    takes no room: its container_id is null. A null length counts as 0. With
    mixed=False the items of a container are of one bucket. Ranks are counted
    per bucket and salt, of which a bucket has as many as its items ask for.
    """
    spark = items.sparkSession
    if not kinds:
        return spark.createDataFrame([], "container_kind string, container_id bigint, doc_id bigint, piece_no int, n_tokens bigint")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).cast("bigint").alias("capacity")) for k, c in sorted(kinds.items())])).alias("c")
    of = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"), each).select("doc_id", "n", "c.*")
    none = of.where("n <= 0").select("container_kind", F.lit(None).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("n_tokens"))
    pieces = of.where("n > 0").select("container_kind", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("capacity")).cast("int"))).alias("piece_no"))
    pieces = pieces.select("container_kind", "doc_id", "piece_no", F.least(F.col("capacity"), F.col("n") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"))

    histogram: dict[str, dict[int, int]] = {k: {} for k in kinds}
    for r in pieces.groupBy("container_kind", "n_tokens").count().collect():  # at most a row per kind and length
        histogram[r[0]][r[1]] = r[2]
    bucket_of: list[tuple[str, int, int, int]] = []
    ranges: dict[str, dict[int, list[tuple[int, int, int]]]] = {k: {} for k in kinds}
    for kind, h in histogram.items():
        if not h:
            continue
        lengths = np.array(sorted(h))
        counts = np.array([h[x] for x in lengths])
        bounds = bucket_bounds(lengths, counts, buckets)
        at = np.searchsorted(bounds, lengths)
        held = np.bincount(at, counts, len(bounds)).astype(np.int64)
        bucket_of += [(kind, int(x), int(b), int(-(-held[b] // PER_SALT))) for x, b in zip(lengths, at)]
        base, used = 0, [0] * len(bounds)
        for batch, times in batch_plan(bounds, held, kinds[kind], mixed=mixed):
            for b, n in batch.items():
                ranges[kind].setdefault(b, []).append((used[b], n, base))
                used[b] += n * times
            base += times
    # a row per kind and length, which capacity bounds
    buckets_df = F.broadcast(spark.createDataFrame(bucket_of, "container_kind string, n_tokens bigint, bucket int, salts int"))
    salt = F.pmod(F.xxhash64("doc_id", "piece_no"), "salts").cast("int").alias("salt")
    placed = pieces.join(buckets_df, ["container_kind", "n_tokens"]).select("container_kind", "doc_id", "piece_no", "n_tokens", "bucket", salt)
    tally = placed.groupBy("container_kind", "bucket", "salt").count()
    before = Window.partitionBy("container_kind", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = tally.select("container_kind", "bucket", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    w = Window.partitionBy("container_kind", "bucket", "salt").orderBy("doc_id", "piece_no")
    ranked = placed.withColumn("r", F.row_number().over(w) - 1).join(offset, ["container_kind", "bucket", "salt"])
    found = container_finder(ranges)("container_kind", "bucket", F.col("r") + F.col("offset"))
    return ranked.select("container_kind", found.alias("container_id"), "doc_id", "piece_no", "n_tokens").unionByName(none)


def _kinds(spark, sf_dir: str) -> dict[str, int]:
    return {r[0]: r[1] for r in read_table(spark, sf_dir, "container_sizes").select("container_kind", "capacity_tokens").collect()}


def p8_containers(spark, sf_dir: str) -> DataFrame:
    counts = materialize(token_counts(read_table(spark, sf_dir, "documents")), "counts")
    return pack(counts, _kinds(spark, sf_dir))


def p8_checked(spark, sf_dir: str) -> DataFrame:
    """Of each kind of container: documents placed, containers above the capacity, documents torn that would have fitted, tokens lost."""
    counts = materialize(token_counts(read_table(spark, sf_dir, "documents")), "counts")
    sizes = read_table(spark, sf_dir, "container_sizes")
    placed = materialize(pack(counts, _kinds(spark, sf_dir)), "placed")
    full = placed.where("container_id is not null").groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t")).join(sizes, "container_kind").groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    of = placed.groupBy("container_kind", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("t")).join(counts, "doc_id").join(sizes, "container_kind")
    torn = F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens")))
    each = of.groupBy("container_kind").agg(F.count("*").alias("docs"), torn.alias("torn"), F.sum(F.abs(F.col("t") - F.col("n_tokens"))).alias("lost"))
    return each.join(full, "container_kind").select("container_kind", "docs", "overfull", "torn", "lost")


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """How well the containers of each kind are filled: containers, pieces, tokens and the share used."""
    c = p8_containers(spark, sf_dir).where("container_id is not null")
    each = c.groupBy("container_kind", "container_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    sizes = F.broadcast(read_table(spark, sf_dir, "container_sizes"))
    return each.join(sizes, "container_kind").groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / F.sum("capacity_tokens")).alias("used")
    )
