"""Streams that keep state with an end: first sightings of versions, and streaks of failures, without a look at what was loaded before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session that runs streaks must name as its state store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "first long, last long, length long"


def first_seen(stream: DataFrame, keep: str = "30 days", by: tuple[str, ...] = ("doc_id", "sha256"), ts: str = "seen_at") -> DataFrame:
    """The rows of a stream that are the first of theirs by the columns by, nulls being equal. A value is remembered for the time keep after its first row, by the watermark, and then forgotten: a repeat
    that comes later than that is a first sighting again. Rows that come later than the watermark are left out. To be written in append mode."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark(list(by))


def _segments(rows: Column) -> Column:
    """first, last and length of the failures before, between and after the resets among sorted rows (us, f, b): one segment more than resets. A reset that is a failure too begins a segment."""
    places = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: F.get(rows, i - 1)["b"])
    borders = F.concat(F.array(F.lit(1)), places, F.array(F.size(rows) + 1))

    def segment(lo: Column, i: Column) -> Column:
        failures = F.filter(F.slice(rows, lo, F.get(borders, i + 1) - lo), lambda r: r["f"])
        n = F.size(failures)
        return F.struct(F.get(failures, F.lit(0))["us"].alias("first"), F.get(failures, n - 1)["us"].alias("last"), n.cast("long").alias("length"))

    return F.transform(F.slice(borders, 1, F.size(borders) - 1), segment)


def _carry(keys: list[str], least: int, idle_s: int, bucket_s: int) -> StatefulProcessor:
    """Carries the open streak of a group from bucket to bucket. Each bucket has its segments (first, last, length; null times where it is 0): what goes on from before, what ended within, what goes on."""

    class Carry(StatefulProcessor):  # local, so that workers need no module of ours
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.open = handle, handle.getValueState("open", STATE)

        def due(self, last: int) -> int:
            return last // 1000 + (idle_s + bucket_s) * 1000 + 1

        def handleInputRows(self, key, rows, timerValues):
            now = before = tuple(self.open.get()) if self.open.exists() else None
            for row in sorted(rows, key=lambda r: r["_at"]):
                segments = [(s["first"], s["last"], s["length"]) for s in row["_s"]]
                head, ended = segments[0], segments[1:-1]
                if head[2]:
                    if now and head[0] - now[1] > idle_s * 1_000_000:
                        yield from self.out(key, now)
                        now = None
                    now = (now[0], head[1], now[2] + head[2]) if now else head
                if len(segments) > 1:
                    for streak in (now, *ended):
                        yield from self.out(key, streak)
                    now = segments[-1] if segments[-1][2] else None
            if now and self.due(now[1]) <= timerValues.getCurrentWatermarkInMs():
                yield from self.out(key, now)
                now = None
            if now != before:
                if before:
                    self.handle.deleteTimer(self.due(before[1]))
                if now:
                    self.open.update(now)
                    self.handle.registerTimer(self.due(now[1]))
                else:
                    self.open.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.open.exists():
                yield from self.out(key, tuple(self.open.get()))
                self.open.clear()

        def out(self, key, streak):
            if streak and streak[2] >= least:
                yield Row(**dict(zip((*keys, "first", "last", "length"), (*key, *streak), strict=True)))

        def close(self) -> None:
            pass

    return Carry()


def streaks(
    stream: DataFrame, failed: Column, reset: Column, least: int, by: tuple[str, ...], ts: str = "ts", ties: tuple[str, ...] = (), idle_s: int = 86_400, bucket_s: int = 3600, late: str = "10 minutes"
) -> DataFrame:
    """by, first, last, length of the runs of at least least failures that have ended, to be written in append mode: each comes out once.

    A reset ends one, and so does silence: a time longer than idle_s between two failures. Rows count in the order of ts and ties, whatever the batches that bring them; rows that come after the
    watermark has passed their bucket are left out, and so are rows without a time. Conditions that are null don't hold. A streak comes out when the watermark has passed the bucket of what ended it, or all
    buckets within idle_s of its last failure; then its group's state goes. So state is one row for each group that failed of late, and the rows of buckets that are still open.

    Rows of a group are first summed up by buckets of so many seconds, each wherever Spark puts it, and only these sums, a row for each bucket, come together by group: a group with most
    of all rows is spread over tasks by time. spark.sql.streaming.stateStore.providerClass must be STORE.
    """
    if bucket_s > idle_s:
        raise ValueError("a bucket may not be longer than the silence that ends a streak")
    schema = stream.schema
    f, b = F.coalesce(failed, F.lit(False)), F.coalesce(reset, F.lit(False))
    row = F.struct(F.unix_micros(ts).alias("us"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], f.alias("f"), b.alias("b"))
    # Not a filter: the watermark goes by all rows
    marked = stream.withWatermark(ts, late).select(F.col(ts), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.when(f | b, row).alias("_row"))
    keys = [f"_k{i}" for i in range(len(by))]
    buckets = marked.groupBy(F.window(ts, f"{bucket_s} seconds").alias("window"), *keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows")).filter(F.size("_rows") > 0)
    parts = buckets.select(F.window_time("window").alias("_at"), *keys, _segments(F.col("_rows")).alias("_s"))
    inner = F.filter(F.slice("_s", 2, F.greatest(F.size("_s") - 2, F.lit(0))), lambda s: s["length"] >= least)
    parts = parts.select("_at", *keys, F.when(F.size("_s") == 1, F.col("_s")).otherwise(F.concat(F.slice("_s", 1, 1), inner, F.slice("_s", -1, 1))).alias("_s"))
    typed = ", ".join(f"{k} {schema[name].dataType.simpleString()}" for k, name in zip(keys, by, strict=True))
    ended = parts.groupBy(*keys).transformWithState(_carry(keys, least, idle_s, bucket_s), f"{typed}, {STATE}", "Append", "EventTime")
    named = [F.col(k).alias(name) for k, name in zip(keys, by, strict=True)]
    return ended.select(*named, F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "length")
