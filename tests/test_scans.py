"""Windows over groups that are split, against the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from docket.operators import requestlog, runs

RNG = random.Random(8)
BY, ORDER = ("run",), ("ts", "id")
day = lambda: F.floor(F.unix_micros("ts") / F.lit(86_400_000_000))


@pytest.fixture(scope="module")
def log(spark):
    """One run with most requests, gaps of many days, equal times, missing ones and a null run."""
    rows = [(k, 1 if RNG.random() < 0.8 else RNG.choice([2, 3, None]), RNG.choice([None, *range(0, 3_000_000, 7_001)]) if RNG.random() < 0.5 else RNG.randrange(5000), RNG.choice(["ok", "bad", "limited", "other"]), RNG.choice(["a", "b", None])) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, run long, s long, kind string, content string")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")


def same(a, b):
    assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))


@pytest.mark.parametrize("cut", [day, lambda: F.lit(7), lambda: F.floor(F.unix_micros("ts") / F.lit(500_000_000))])
def test_split_scans_equal_whole_ones(log, cut):
    kind, cut = F.col("kind"), cut()
    for scan in (
        lambda c: requestlog.streaks(log, kind == "bad", kind == "ok", 2, BY, ORDER, cut=c),
        lambda c: requestlog.spacing(log, 100.0, BY, ORDER, cut=c),
        lambda c: requestlog.cooldown(log, kind == "limited", F.lit(30.0), 200.0, BY, ORDER, cut=c),
        lambda c: requestlog.stability(log, BY, ORDER, "content", 24.0, cut=c),
        lambda c: runs.numbered(log, BY, ORDER, c),
    ):
        same(scan(cut), scan(None))


def test_rolling_counts_by_stretches(log):
    for seconds in (60, 3600, 86_400):
        same(requestlog.rolling(log, seconds, 3, BY, split=True), requestlog.rolling(log, seconds, 3, BY))


def test_one_hot_run_is_spread_over_tasks(spark):
    """A million requests of one run: no task of the scan gets more than a small part of them, and positions run from 1 to the end."""
    log = spark.range(1_000_000).select(F.col("id"), F.lit(1).alias("run"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = runs.numbered(log, BY, ("ts", "id"), day()).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
        assert max(sizes) < 500_000 and sum(sizes) == 1_000_000
        assert out.filter(F.col("position") != F.col("id") + 1).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
