"""Chunks of large keys: sizes near the span, right results for outliers, fractions and null keys."""

import itertools
import operator

import pytest
from pyspark.sql import functions as F

from talkweave.operators import skew

ROWS = 20_000
SPAN = 1_000


@pytest.fixture(scope="module")
def keyed(spark):
    """Five keys: one far outlier, fractional orders, a null key, times, and a small key."""
    order = {
        "outlier": F.when(F.col("i") == 77, 1e15).otherwise(F.col("i").cast("double")),
        "fraction": F.col("i") / 1e6, None: F.col("i") * F.col("i") / 3.0, "time": 1.7e9 + F.col("i") / 1e3, "small": F.col("i") * 1.0,
    }
    frames = [
        spark.range(50 if k == "small" else ROWS).withColumnRenamed("id", "i").select(F.lit(k).cast("string").alias("k"), o.alias("o"), (F.xxhash64("i") % 1000).alias("v"))
        for k, o in order.items()
    ]
    frame = frames[0]
    for f in frames[1:]:
        frame = frame.union(f)
    return frame


def test_chunks_are_near_the_span(keyed):
    sizes = skew._chunked(keyed, ["k"], "o", SPAN).groupBy("k", "_chunk").count().collect()
    by_key = {}
    for r in sizes:
        by_key.setdefault(r["k"], []).append(r["count"])
    assert by_key.pop("small") == [50]
    assert set(by_key) == {"outlier", "fraction", None, "time"}
    for counts in by_key.values():
        assert sum(counts) == ROWS and max(counts) <= 2 * SPAN and len(counts) >= ROWS // (2 * SPAN)


def test_chunks_keep_the_order(keyed):
    ranges = skew._chunked(keyed, ["k"], "o", SPAN).groupBy("k", "_chunk").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).collect()
    for _, group in itertools.groupby(sorted(ranges, key=lambda r: (str(r["k"]), r["_chunk"])), key=lambda r: r["k"]):
        group = list(group)
        assert all(a["hi"] < b["lo"] for a, b in itertools.pairwise(group))


@pytest.mark.parametrize("span", [SPAN, 10**9])
def test_running_values(keyed, span):
    rows = sorted(keyed.collect(), key=lambda r: (str(r["k"]), r["o"]))
    want = {}
    for _, group in itertools.groupby(rows, key=lambda r: r["k"]):
        group = list(group)
        values = [r["v"] for r in group]
        for r, s, x, m in zip(group, itertools.accumulate(values), itertools.accumulate(values, operator.xor), itertools.accumulate(values, max)):
            want[r["k"], r["o"]] = (s, x, m)
    got = skew.running(keyed, ["k"], "o", {"s": ("sum", F.col("v")), "x": ("xor", F.col("v")), "m": ("max", F.col("v"))}, span).collect()
    assert {(r["k"], r["o"]): (r["s"], r["x"], r["m"]) for r in got} == want


def test_count_last_and_preceding_with_null_keys(keyed):
    few = keyed.filter("k IS NULL OR k = 'small'")
    counted = {(r["k"], r["o"]): r["n"] for r in skew.running_count(few, ["k"], "o", "n", SPAN).collect()}
    assert sorted(n for (k, _), n in counted.items() if k is None) == list(range(1, ROWS + 1))
    last = skew.running_last(few, ["k"], "o", {"l": F.when(F.col("v") < 0, F.col("v"))}, SPAN).collect()
    seen = {}
    for r in sorted(few.collect(), key=lambda r: (str(r["k"]), r["o"])):
        seen[r["k"], r["o"]] = seen.get(r["k"])
        if r["v"] < 0:
            seen[r["k"]] = r["v"]
    assert {(r["k"], r["o"]): r["l"] for r in last} == {k: v for k, v in seen.items() if isinstance(k, tuple)}
    before = skew.preceding_rows(few, ["k"], "o", ["v"], 3, "b", SPAN)
    assert {min(n - 1, 3) for n in counted.values()} == {0, 1, 2, 3}
    assert all(len(r["b"]) == min(counted[r["k"], r["o"]] - 1, 3) for r in before.collect())


def test_no_job_while_the_plan_is_built(spark, keyed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    skew.running_count(keyed, ["k"], "o", "n", SPAN)
    skew.preceding_rows(keyed, ["k"], "o", ["v"], 3, "b", SPAN)
    assert not tracker.getJobIdsForGroup("plan-only")


def test_rows_are_not_shuffled_to_meet_the_large_keys(spark):
    # Above the size that statistics let Spark broadcast, a join with the few large keys moved every row.
    rows = spark.createDataFrame([(i % 3, i, float(i)) for i in range(30)], "k int, seq long, v double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (skew.running_last(rows, ["k"], "seq", {"last": "v"}, 4), skew.preceding_rows(rows, ["k"], "seq", ["v"], 2, span=4)):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
