"""References to records that do not exist (problem 6).

A reference names a key at a moment; a key exists during intervals. References
are pre-aggregated per key and month. A pair of key and month whose references
all lie in one interval, or outside all of them, is decided as a whole; only
mixed ones are decided reference by reference. Heavy keys, of which a corpus
has at most 1/share, are checked against a broadcast of their verdicts, all
others by a shuffled join; both parts are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.functions import text as T
from vaultlens.plans.runtime import counting_rows, materialize, read_table

#: A key with this share of all references or more is heavy: at most 500 keys are.
HEAVY_SHARE = 0.002
#: Intervals of heavy keys up to which they are broadcast; beyond, the join is left to the planner.
FEW_INTERVALS = 100_000


def merged_intervals(spans: DataFrame) -> DataFrame:
    """Disjoint intervals (key, since, until) of possibly overlapping ones.

    A null until is open, a null since never begins. Copies go before the
    sort, so a key sends each of its different intervals once.
    """
    s = spans.where(F.col("key").isNotNull() & F.col("since").isNotNull()).where(F.col("until").isNull() | (F.col("until") > F.col("since"))).select("key", "since", "until").distinct()
    far = F.lit("9999-12-31").cast(s.schema["since"].dataType)
    w = Window.partitionBy("key").orderBy("since", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = s.withColumn("end", F.coalesce("until", far)).withColumn("new", F.when(F.col("since") <= before, 0).otherwise(1))
    run = opened.withColumn("run", F.sum("new").over(w))
    return run.groupBy("key", "run").agg(F.min("since").alias("since"), F.max("end").alias("until")).drop("run")


def orphan_references(refs: DataFrame, spans: DataFrame, *, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """The rows of refs whose key does not exist at their time.

    refs needs the columns key and ts and keeps all others; spans has key,
    since and until (null: still there). A reference exists from since on and
    until before until. References without a key are dropped; one without a
    time is an orphan, as no moment can be shown at which its key existed.
    Repeated references stay repeated. Columns may have any further names but
    those starting with two underscores.
    """
    live = materialize(merged_intervals(spans), "intervals")
    refs = refs.where(F.col("key").isNotNull()).withColumn("__month", F.trunc("ts", "month"))
    periods = materialize(refs.groupBy("key", "__month").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")), "periods")
    # of each key and month: does one interval hold all its references, does any meet them
    met = periods.join(live, "key", "left").groupBy("key", "__month").agg(
        F.max("n").alias("__n"),
        F.max(F.coalesce((F.col("since") <= F.col("first")) & (F.col("until") > F.col("last")), F.lit(False))).alias("__whole"),
        F.max(F.coalesce((F.col("since") <= F.col("last")) & (F.col("until") > F.col("first")), F.lit(False))).alias("__met"),
    )
    met = materialize(met, "verdicts")
    total = met.agg(F.sum("__n")).first()[0] or 0
    keys = met.groupBy("key").agg(F.sum("__n").alias("n")).where(F.col("n") >= max(1.0, heavy_share * total)).select("key")
    # at most 1/heavy_share keys by arithmetic, whatever the size of the corpus
    heavy = F.broadcast(keys)
    verdict = met.select(F.col("key").alias("__key"), F.col("__month").alias("__at"), "__whole", "__met")

    def judged(part: DataFrame, of: DataFrame) -> DataFrame:
        same = (F.col("key") == F.col("__key")) & F.col("__month").eqNullSafe(F.col("__at"))
        return part.join(of, same, "left").where(~F.col("__whole")).drop("__key", "__at", "__whole")

    hot = judged(refs.join(heavy, "key", "left_semi"), F.broadcast(verdict.join(heavy, F.col("__key") == F.col("key"), "left_semi")))
    cold = judged(refs.join(heavy, "key", "left_anti"), verdict)
    at = live.withColumnsRenamed({"key": "__key"})
    held = at.join(heavy, F.col("__key") == F.col("key"), "left_semi")
    if held.limit(FEW_INTERVALS + 1).count() <= FEW_INTERVALS:
        held = F.broadcast(held)
    inside = (F.col("key") == F.col("__key")) & (F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("until"))
    parts = []
    for part, of in ((hot, held), (cold, at)):
        parts += [part.where(~F.col("__met")), part.where("__met").join(of, inside, "left_anti")]
    return reduce(DataFrame.unionByName, parts).drop("__month", "__met")


def note_references(notes: DataFrame) -> DataFrame:
    """Different link targets of each counting row of note_records."""
    n = counting_rows(notes.select("note_id", "links", "scanned_at"), "note_id", "scanned_at")
    targets = F.array_distinct(F.transform("links", T.target_key))
    return n.select(F.lit("note_records").alias("src_table"), F.col("note_id").alias("src_id"), F.lit(None).cast("bigint").alias("plan_id"), F.explode(targets).alias("key"), F.col("scanned_at").alias("ts")).where("key <> ''")


def plan_rows(plans: DataFrame) -> DataFrame:
    """Counting rows of plan_notes: plan_note_id, plan_id, title and targets as keys, ts."""
    p = counting_rows(plans.select("plan_note_id", "plan_id", "title", "body", "proposed_at"), "plan_note_id", "proposed_at")
    found = F.regexp_extract_all("body", F.lit(T.LINK), F.lit(1))
    return p.select("plan_note_id", "plan_id", T.title_key("title").alias("title"), F.array_distinct(F.transform(found, T.target_key)).alias("targets"), F.col("proposed_at").alias("ts"))


def plan_references(rows: DataFrame) -> DataFrame:
    """Different wikilink targets of each row of plan_rows()."""
    return rows.select(F.lit("plan_notes").alias("src_table"), F.col("plan_note_id").alias("src_id"), "plan_id", F.explode("targets").alias("key"), "ts").where("key <> ''")


def vault_orphans(notes: DataFrame, plans: DataFrame, titles: DataFrame, mocs: DataFrame) -> DataFrame:
    """Orphan references of the vault's tables: src_table, src_id, target, ref_month.

    Null, blank and repeated links are no references; an empty table gives no
    rows.
    """
    p = materialize(plan_rows(plans), "plans")
    own = p.where("title is not null and plan_id is not null").select("plan_id", F.col("title").alias("key")).distinct()
    refs = note_references(notes).unionByName(plan_references(p).join(own, ["plan_id", "key"], "left_anti").select("src_table", "src_id", "plan_id", "key", "ts"))
    fixed = mocs.select(T.title_key("title").alias("key")).where("key is not null").distinct()
    refs = materialize(refs.drop("plan_id").join(fixed, "key", "left_anti"), "references")
    spans = titles.select(T.title_key("title").alias("key"), F.col("created_at").alias("since"), F.col("archived_at").alias("until"))
    lost = orphan_references(refs, spans)
    return lost.select("src_table", "src_id", F.col("key").alias("target"), F.date_format("ts", "yyyy-MM").alias("ref_month"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    return vault_orphans(t("note_records"), t("plan_notes"), t("title_index"), t("moc_catalog"))


def p6_report(spark, sf_dir: str) -> DataFrame:
    """Orphan references per table and month."""
    return p6_found(spark, sf_dir).groupBy("src_table", "ref_month").agg(F.count("*").alias("orphans"), F.countDistinct("target").alias("targets"))
