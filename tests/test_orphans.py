"""References against brute force, with the cases a vault has."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vaultlens.operators import orphans

T0 = dt.datetime(2025, 1, 1)
DAY = dt.timedelta(days=1)


def brute(refs, spans):
    def lives(k, t):
        return t is not None and any(s[0] == k and s[1] is not None and s[1] <= t and (s[2] is None or t < s[2]) for s in spans)

    return sorted(((i, k) for i, k, t in refs if k is not None and not lives(k, t)), key=str)


def run(spark, refs, spans, **kw):
    r = spark.createDataFrame(refs, "id bigint, key string, ts timestamp_ntz").withColumn("n", F.lit("x")).withColumn("first", F.lit(1))
    s = spark.createDataFrame(spans, "key string, since timestamp_ntz, until timestamp_ntz")
    return sorted(((x["id"], x["key"]) for x in orphans.orphan_references(r, s, **kw).collect()), key=str)


def test_random_intervals(spark):
    rnd = random.Random(4)
    day = lambda: T0 + DAY * rnd.randint(0, 120)
    spans = []
    for _ in range(120):
        a = day()
        spans.append((rnd.choice("abcdefgh"), a, rnd.choice([None, a + DAY * rnd.randint(0, 40)])))
    spans = [s for s in spans if s[0] not in "a" or s[2]] + spans[:3]
    refs = [(i, rnd.choice("aaaaaaabcdefghxyz"), day()) for i in range(400)]
    refs += refs[:5]
    assert run(spark, refs, spans) == brute(refs, spans)
    assert run(spark, refs, spans, heavy_share=0.3) == brute(refs, spans)  # one heavy key


def test_edges_and_nulls(spark):
    spans = [("a", T0, T0 + DAY), ("a", T0 + 3 * DAY, None), ("b", None, None), (None, T0, None), ("c", T0, T0)]
    refs = [(1, "a", T0), (2, "a", T0 + DAY), (3, "a", T0 + 3 * DAY), (4, "b", T0), (5, None, T0), (6, "a", None), (7, "c", T0), (7, "c", T0)]
    assert run(spark, refs, spans) == [(2, "a"), (4, "b"), (6, "a"), (7, "c"), (7, "c")]


def test_empty(spark):
    assert run(spark, [], [("a", T0, None)]) == []
    assert run(spark, [(1, "a", T0)], []) == [(1, "a")]


def test_vault_tables(spark):
    notes = spark.createDataFrame(
        [(1, ["A|x", "a", None, " ", "#h", "B"], T0 + DAY, "later"), (1, ["gone"], T0, "older"), (2, None, T0, ""), (None, ["Z"], T0, "")],
        "note_id bigint, links array<string>, scanned_at timestamp_ntz, target string",
    )
    plans = spark.createDataFrame(
        [(1, 7, "Own  title", "[[own TITLE]] [[Home]] [[Missing#x]] [[a]]", T0), (2, 7, None, None, T0)],
        "plan_note_id bigint, plan_id bigint, title string, body string, proposed_at timestamp_ntz",
    )
    titles = spark.createDataFrame([("A", T0, None, 1), ("A", T0, None, 1)], "title string, created_at timestamp_ntz, archived_at timestamp_ntz, key int")
    mocs = spark.createDataFrame([("Home",)], "title string")
    got = sorted(map(tuple, orphans.vault_orphans(notes, plans, titles, mocs).collect()))
    assert got == [("note_records", 1, "b", "2025-01"), ("plan_notes", 1, "missing", "2025-01")]
