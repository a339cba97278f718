"""Streams with state that ends, against versions without Spark."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from docket.operators import requestlog
from docket.streaming import state

RNG = random.Random(21)
HOUR, DAY = 3600, 86_400
ORIGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "id long, run long, at long, kind string"


def brute_streaks(batches, least, idle, bucket, late):
    """Streaks that have ended after the last batch: rows in the order of time, without those that came too late."""
    mark, kept = None, []
    for rows in batches:
        kept += [r for r in rows if r[2] is not None and (mark is None or (r[2] // bucket + 1) * bucket > mark)]
        mark = max([r[2] for rows in batches[: batches.index(rows) + 1] for r in rows if r[2] is not None]) - late
    out = []
    for run in {r[1] for r in kept}:
        now = None
        for i, _, at, kind in sorted((r for r in kept if r[1] == run and (r[2] // bucket + 1) * bucket <= mark), key=lambda r: (r[2], r[0])):
            if now and (kind == "ok" or kind == "bad" and at - now[1] > idle):
                out.append((run, *now))
                now = None
            if kind == "bad":
                now = (now[0], at, now[2] + 1) if now else (at, at, 1)
        if now and now[1] + idle + bucket < mark:
            out.append((run, *now))
    return sorted([s for s in out if s[3] >= least], key=repr)


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, folder, batches, schema, build, each=None):
    """What build makes of the batches, one after another, each in a query of its own that goes on from the checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        if each:
            each(k, query)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def at(stream):
    return stream.withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.lit(ORIGIN)) + F.col("at")))


def log(n, low, high):
    runs = [1, 1, 1, 1, 2, 3, None, 9_007_199_254_740_993]
    return [(RNG.randrange(10**9), RNG.choice(runs), RNG.choice([None, *[RNG.randrange(low, high)] * 30]), RNG.choice(["bad", "bad", "bad", "ok", "other", None])) for _ in range(n)]


def test_streaks_over_restarts_equal_a_version_without_spark(spark, tmp_path):
    """Most rows belong to one run; batches overlap, some rows are late, some runs fall silent, ties and rows without a time or run."""
    batches = [log(150, 0, 3 * DAY), log(120, 2 * DAY, 4 * DAY), log(60, 0, 5 * DAY), [(1, 2, 9 * DAY, "bad")], log(80, 9 * DAY, 10 * DAY), [(2, 3, 14 * DAY, "other")]]
    build = lambda s: state.streaks(at(s), F.col("kind") == "bad", F.col("kind") == "ok", 2, ("run",), "ts", ("id",), 6 * HOUR, HOUR, "20 minutes")
    left = {}
    got = feed(spark, tmp_path, batches, LOG, build, lambda k, q: left.update({k: [o["numRowsTotal"] for o in q.lastProgress["stateOperators"]]}))
    seconds = lambda c: (F.unix_seconds(c) - F.unix_seconds(F.lit(ORIGIN))).alias(c)
    rows = [tuple(r) for r in got.select("run", seconds("first"), seconds("last"), "length").collect()]
    want = brute_streaks(batches, 2, 6 * HOUR, HOUR, 20 * 60)
    assert sorted(rows, key=repr) == want and len({r[0] for r in want}) == 5
    assert sum(left[5]) <= 2  # the last row's bucket; all groups have been silent for long


def test_streaks_equal_those_of_a_table(spark, tmp_path):
    """Where all streaks have ended by resets and silence doesn't count, the batch operator gives the same."""
    rows = log(300, 0, 2 * DAY)
    rows = [r for r in rows if r[2] is not None] + [(k, run, 3 * DAY, "ok") for k, run in enumerate({r[1] for r in rows})]
    bad, ok = F.col("kind") == "bad", F.col("kind") == "ok"
    got = feed(spark, tmp_path, [rows, [(0, 0, 9 * DAY, "other")]], LOG, lambda s: state.streaks(at(s), bad, ok, 3, ("run",), "ts", ("id",), 365 * DAY, HOUR))
    want = requestlog.streaks(at(spark.createDataFrame(rows, LOG)), bad, ok, 3, ("run",), ("ts", "id"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect())) and got.count() > 10


def test_silence_may_not_be_shorter_than_a_bucket(spark):
    with pytest.raises(ValueError, match="bucket"):
        state.streaks(spark.range(1), F.lit(True), F.lit(False), 2, ("id",), idle_s=60, bucket_s=61)


def test_first_sightings_are_remembered_over_restarts_and_then_forgotten(spark, tmp_path):
    seen = lambda days: ORIGIN + timedelta(days=days)
    batches = [
        [(1, "a", seen(0)), (1, "a", seen(1)), (2, None, seen(0)), (2, None, seen(0)), (None, "a", seen(0))],
        [(1, "a", seen(2)), (1, "b", seen(2)), (2, None, seen(2)), (None, "a", seen(2))],  # repeats, after a restart
        [(3, "c", seen(40))],
        [(1, "a", seen(41)), (3, "c", seen(42)), (4, "d", seen(5))],  # forgotten; a repeat; too late
    ]
    left = {}
    got = feed(spark, tmp_path, batches, "doc_id long, sha256 string, seen_at timestamp", lambda s: state.first_seen(s, "10 days"), lambda k, q: left.update({k: q.lastProgress["stateOperators"][0]["numRowsTotal"]}))
    assert sorted([(r.doc_id, r.sha256) for r in got.collect()], key=repr) == sorted([(1, "a"), (2, None), (None, "a"), (1, "b"), (3, "c"), (1, "a")], key=repr)
    assert left[1] == 4 and left[2] == 1 and left[3] == 2
