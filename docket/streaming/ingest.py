"""Incremental load of documents: each micro-batch appends its versions, and is committed by a row written last; what was seen before, or by a batch that ran twice, is left out when the
versions are read, so a batch costs what it holds, however much was loaded before."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.operators.ledger import new_versions
from docket.operators.snapshots import Change, Store

VERSIONS = "doc_id long, sha256 string, seen_at timestamp, load int, stream string, batch_id long"
COMMITS = "stream string, batch_id long"


def stream_name(checkpoint: str) -> str:
    """A stream is named by where its progress is kept: batch numbers count within it."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def committed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, sha256, seen_at, load: the first sighting of each version in the batches of all streams that have their commit row; rows of a batch that was cut off are as if not there."""
    rows = spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    done = spark.read.schema(COMMITS).parquet(f"{path}/commits").distinct()
    return new_versions(rows.join(done, ["stream", "batch_id"], "left_semi"))


def start(stream: DataFrame, path: str, checkpoint: str, load: int = 1):
    """A query that appends the versions of the stream's documents (doc_id, text, seen_at) under path, for all that is there now."""
    spark, name = stream.sparkSession, stream_name(checkpoint)
    for table, schema in (("versions", VERSIONS), ("commits", COMMITS)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{table}")

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "seen_at", F.lit(load).alias("load"))
        mark = {"stream": F.lit(name), "batch_id": F.lit(batch_id).cast("long")}
        new_versions(rows).withColumns(mark).write.mode("append").parquet(f"{path}/versions")
        spark.range(1).select(*[c.alias(n) for n, c in mark.items()]).coalesce(1).write.mode("append").parquet(f"{path}/commits")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take(store: Store, run: str, batch: DataFrame, batch_id: int) -> int:
    """One batch of documents (doc_id, text, seen_at) as one snapshot: their versions are appended, their links to a run and their metadata replaced; left out where the store has it already."""
    rows = batch.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    newest = rows.groupBy("doc_id").agg(F.max_by(F.struct("sha256", F.length("text").alias("n_chars")), F.struct("seen_at", "sha256")).alias("m")).select("doc_id", "m.sha256", "m.n_chars")
    changes = {
        "versions": Change(new_versions(rows.select("doc_id", "sha256", "seen_at", F.lit(1).alias("load"))).select("doc_id", "sha256", "seen_at")),
        "links": Change(rows.select("doc_id", F.lit(run).alias("run_id")).distinct(), key=("doc_id", "run_id")), "metadata": Change(newest, key="doc_id"),
    }
    return store.commit(changes, run, batch_id)


def start_snapshots(stream: DataFrame, store: Store, checkpoint: str, run: str):
    """A query that takes all that is there now into the store, batch by batch."""
    return stream.writeStream.foreachBatch(lambda batch, i: take(store, run, batch, i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle(spark: SparkSession, path: str, to: str) -> None:
    """The committed versions written anew under to, each once, as one committed batch."""
    mark = {"stream": F.lit("settled"), "batch_id": F.lit(0).cast("long")}
    committed(spark, path).withColumns(mark).write.parquet(f"{to}/versions")
    spark.range(1).select(*[c.alias(n) for n, c in mark.items()]).coalesce(1).write.parquet(f"{to}/commits")


def budget(stream: DataFrame, seconds: int = 60, most: int = 450, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """window, run_id, n, over: requests of each run in each window of so many seconds, to be written in append mode: a window comes out once, when the watermark has passed its end,
    and its state goes; rows that come later than that are left out."""
    span = F.window(F.col(ts), f"{seconds} seconds")
    return stream.withWatermark(ts, late).groupBy(span.alias("window"), "run_id").agg(F.count("*").alias("n")).withColumn("over", F.col("n") > most)
