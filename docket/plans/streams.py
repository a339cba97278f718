"""Queries that run a stream over the given tables to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.operators import runs
from docket.operators.snapshots import Store
from docket.sources.records import candidates, decode, first_candidates, page_checks
from docket.sources.tables import shared_folder, stored_once, table
from docket.streaming import ingest, state


def stream_ingest_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, streamed twice: the second time adds nothing. Then another stream writes the versions of a batch and is cut off before its commit."""
    out, path = shared_folder(spark, "stream"), f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    for k in (1, 2):
        files = spark.readStream.schema(schema).parquet(f"{path}*").select("doc_id", "text", F.to_timestamp(F.lit("2024-01-01")).alias("seen_at"))
        ingest.start(files, out, f"{out}/checkpoint-{k}").awaitTermination()
    cut_off = spark.read.parquet(path).select("doc_id", F.lit("0").alias("sha256"), F.to_timestamp(F.lit("2024-01-02")).alias("seen_at"), F.lit(1).alias("load"), F.lit("cut off").alias("stream"), F.lit(0).cast("long").alias("batch_id"))
    cut_off.write.mode("append").parquet(f"{out}/versions")
    ingest.settle(spark, out, f"{out}/settled")
    return ingest.committed(spark, f"{out}/settled").select("doc_id", "sha256")


def snapshot_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads as two snapshots, the second of documents that changed, which is then taken once more: what each snapshot holds, and the second one's metadata after compaction and expiry of the first."""
    store = Store(spark, shared_folder(spark, "snapshots"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = docs.filter(F.contains("text", F.lit("Licensed under"))).withColumn("text", F.replace("text", F.lit("Licensed under"), F.lit("Available in detail under")))
    for k, rows in enumerate((docs, changed, changed)):
        ingest.take(store, "load", rows.withColumn("seen_at", F.to_timestamp(F.lit(f"2024-0{k + 1}-01"))), min(k, 1))

    def row(name: str, at: int | None) -> DataFrame:
        counts = [store.read(t, at).agg(F.count("*").alias(t)) for t in ("versions", "links")]
        return store.read("metadata", at).agg(F.count("*").alias("metadata"), F.sum("n_chars").alias("chars")).join(counts[0]).join(counts[1]).withColumn("snapshot", F.lit(name))

    old = stored_once(spark, sf_dir, "first-snapshot", lambda path: row("first", 0).write.parquet(path) or path)  # read before it is expired
    store.compact("metadata", "doc_id")
    store.expire(keep=1)
    return spark.read.parquet(old).unionByName(row("last", None)).withColumn("kept", F.lit(len(store.snapshots())))


def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each run by the hour; the hours that the watermark has not passed at the end don't come out."""
    out, path = shared_folder(spark, "stream"), f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"))
    counted = ingest.budget(stream, 3600, 2).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "run_id", "n", "over")
    counted.writeStream.format("parquet").outputMode("append").option("path", f"{out}/result").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{out}/result")


def stream_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks of a user's errors and views, ended by purchases, signups or a day of silence, from a stream whose state ends with them; those that nothing had ended yet don't come out."""
    out, path = shared_folder(spark, "stream"), f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), "event_id", "event_type")
    failed, reset = F.col("event_type").isin("error", "view"), F.col("event_type").isin("purchase", "signup")
    found = state.streaks(stream, failed, reset, 3, ("run_id",), "ts", ("event_id",))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, state.STORE)
    try:
        found.writeStream.format("parquet").outputMode("append").option("path", f"{out}/result").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(found.schema).parquet(f"{out}/result").select("run_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "length")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of all documents, each of which comes on three days; what the stream wrote is read as it is, without looking for repeats."""
    out, path = shared_folder(spark, "stream"), f"{sf_dir}/documents.parquet"
    days = F.explode(F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda d: F.timestamp_seconds(F.lit(1_704_067_200) + d * 86_400))).alias("seen_at")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), days)
    found = state.first_seen(stream, "10 days").select("doc_id", "sha256")
    found.writeStream.format("parquet").outputMode("append").option("path", f"{out}/result").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/result")


def record_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as landed records: the number of characters stands for costs, and as text where it is odd; every third lacks its end."""
    costs = F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")).otherwise(F.concat(F.lit('"'), F.col("n_chars"), F.lit('"')))
    body = F.concat(F.lit('{"slug": "'), "doc_id", F.lit('", "primary_signature": " KIO '), "doc_id", F.lit('/24 ", "signatures": [" ", 5], "outcome": "", "costs_total": '), costs, F.when(F.col("doc_id") % 3 == 0, "").otherwise("}"))
    rows = decode(table(spark, sf_dir, "documents").select("doc_id", body.cast("binary").alias("content")))
    return rows.select("doc_id", "decoded", "source_ref", F.array_join("sygnatury", ";").alias("sygnatury"), "rozstrzygniecie", "koszty")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as listing pages, a record for each turn; assistants' turns have no slug, and of every fifth page it isn't said whether more follow."""
    slug = F.when(F.col("role") == "user", F.concat(F.lit('"slug": "'), "conv_id", F.lit("-"), "turn", F.lit('", '))).otherwise("")
    record = F.concat(F.lit("{"), slug, F.lit('"primary_signature": "KIO '), "turn", F.lit('/24"}'))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", record.alias("r")).groupBy(F.col("conv_id").alias("page")).agg(F.array_sort(F.collect_list(F.struct("turn", "r"))).alias("a"))
    more = F.when(F.col("page") % 5 == 0, "1").otherwise("true")
    return rows.select("page", F.concat(F.lit('{"has_more": '), more, F.lit(', "data": ['), F.array_join(F.transform("a", lambda x: x["r"]), ","), F.lit("]}")).alias("body"))


def listing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(_pages(spark, sf_dir)).select("page", "idx", "source_ref", F.array_join("sygnatury", ";").alias("sygnatura"), "good")


def listing_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a slug, by page."""
    return candidates(_pages(spark, sf_dir)).filter("not good").groupBy("page").agg(F.count("*").alias("n"))


def listing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_checks(_pages(spark, sf_dir), 50)


def first_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 candidates that a load with that cap would take."""
    return first_candidates(candidates(_pages(spark, sf_dir)), 25).select("page", "idx", "source_ref")


def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for a batch of candidates: toxic ones are known, those of bad quality couldn't be read, and those without a document are missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("there")).distinct()
    batch = table(spark, sf_dir, "labels").join(docs, "doc_id", "left")
    return runs.outcome_summary(batch.select((F.col("toxic") == 0).alias("nowy"), F.col("there").isNull().alias("missing"), (F.col("quality") == 0).alias("parse_error")))


QUERIES = {f.__name__: f for f in (stream_ingest_equals_batch, snapshot_time_travel, stream_budget, stream_streaks, stream_first_seen, record_decode, listing_candidates, listing_rejects, listing_checks, first_listed, batch_outcome)}
_LISTED = "l AS (SELECT conv_id AS page, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1)::INT AS idx, CASE WHEN role = 'user' THEN conv_id || '-' || turn END AS source_ref, 'KIO ' || turn || '/24' AS sygnatura, role = 'user' AS good FROM conversations) "
ORACLE_SQL = {
    "stream_ingest_equals_batch": "SELECT DISTINCT doc_id, sha256(text) AS sha256 FROM documents",
    "snapshot_time_travel": "WITH d AS (SELECT length(text) AS a, contains(text, 'Licensed under') AS c, length(replace(text, 'Licensed under', 'Available in detail under')) AS b FROM documents) SELECT 'first' AS snapshot, count(*) AS metadata, sum(a)::BIGINT AS chars, count(*) AS versions, count(*) AS links, 1 AS kept FROM d UNION ALL SELECT 'last', count(*), sum(CASE WHEN c THEN b ELSE a END)::BIGINT, count(*) + count(*) FILTER (c), count(*), 1 FROM d",
    "stream_budget": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, user_id AS run_id, count(*) AS n, count(*) > 2 AS over FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2",
    "stream_streaks": "WITH w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS t FROM events), e AS (SELECT user_id AS run_id, ts, event_id, event_type IN ('purchase', 'signup') AS b FROM events, w WHERE event_type IN ('error', 'view', 'purchase', 'signup') AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= t), g AS (SELECT *, sum(b::INT) OVER p AS g, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS r FROM e WINDOW p AS (PARTITION BY run_id ORDER BY ts, event_id)), f AS (SELECT *, coalesce(ts - lag(ts) OVER p > INTERVAL 24 HOUR, false) AS cut FROM g WHERE NOT b WINDOW p AS (PARTITION BY run_id, g ORDER BY ts, event_id)), h AS (SELECT *, sum(cut::INT) OVER (PARTITION BY run_id, g ORDER BY ts, event_id) AS h FROM f), s AS (SELECT run_id, min(ts) AS first, max(ts) AS last, count(*) AS length, min(r) > 1 AS ended FROM h GROUP BY run_id, g, h) SELECT run_id, epoch_us(first) AS first_us, epoch_us(last) AS last_us, length FROM s, w WHERE length >= 3 AND (ended OR last + INTERVAL 25 HOUR <= t)",
    "stream_first_seen": "SELECT DISTINCT doc_id, sha256(text) AS sha256 FROM documents",
    "record_decode": "SELECT doc_id, doc_id % 3 <> 0 AS decoded, CASE WHEN doc_id % 3 <> 0 THEN doc_id::VARCHAR END AS source_ref, CASE WHEN doc_id % 3 <> 0 THEN 'KIO ' || doc_id || '/24' END AS sygnatury, NULL::VARCHAR AS rozstrzygniecie, CASE WHEN doc_id % 3 <> 0 AND n_chars % 2 = 0 THEN n_chars::DOUBLE END AS koszty FROM documents",
    "listing_candidates": "WITH " + _LISTED + "SELECT * FROM l",
    "listing_rejects": "WITH " + _LISTED + "SELECT page, count(*) AS n FROM l WHERE NOT good GROUP BY page",
    "listing_checks": "SELECT count(DISTINCT conv_id) AS pages, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0) AS bad_flags, max(conv_id) > 50 AS runaway FROM conversations",
    "first_listed": "WITH " + _LISTED + "SELECT page, idx, source_ref FROM l WHERE good ORDER BY page, idx LIMIT 25",
    "batch_outcome": "SELECT count(*) AS candidates, count(*) FILTER (toxic = 0) AS new, count(*) FILTER (toxic <> 0) AS skipped, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) AS missing, count(*) FILTER (quality = 0) AS errors FROM labels",
}
