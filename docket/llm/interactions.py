"""Filter interaction audit: what each filter of a chain removes in every order of the filters, counted by an incremental stream that retracts what later rows make untrue.

Conditions that a text alone decides are bits of a mask. The last filter fails for a text that some row of a smaller doc_id has too, anywhere in the table, so a row that arrives
later can change what was counted before. The stream reads all files that are there as micro-batches. Each batch looks up, for its texts alone, the smallest ids that earlier batches left in the
keyed state; all its rows are counted as later copies, and the rows of a new minimum are counted back as first ones, while those of the minimum that it replaces are retracted. State and
counters are logs of Parquet files by batch: a batch that runs again after a loss overwrites its own files, and a state is its key's row with the smallest id.
The counters of the parts are then spread over all orders by arithmetic on masks. DataFrame functions only.

Defined results: a null text is an empty one, and a null language the empty part. Rows that share an id and a text are neither's later copy, and count each. A null doc_id is larger than all
others. A document counts as labelled where any of its label rows says so; labels of null ids or of no document count for nothing. Steps that remove nothing have zeros. An empty table
gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docket.sources.tables import shared_folder

from .common import discard, prepare

WHITE = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1  # stands for a null id
COLUMNS = "doc_id long, text string, lang string"
STATE = "key binary, id long, part string, mask int, quality boolean, toxic boolean, n long"
COUNTS = "part string, mask int, quality boolean, toxic boolean, n long"
MARKS = ("part", "mask", "quality", "toxic")


def short(text: Column, words: Column) -> Column:
    return F.size(words) < 200


def repetitive(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)


def shouting(text: Column, words: Column) -> Column:
    return 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 3 * F.length(text)


def marked_up(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: A letter for each filter, and when it fails a text; the letter of the filter for copies follows them.
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {"A": short, "B": repetitive, "C": shouting, "D": marked_up}
COPY = "E"


def masks(docs: DataFrame, conditions: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """key, id, doc_id, part, mask of each row; the key stands for the whole text."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    split = text.withColumn("words", F.filter(F.split("text", WHITE), lambda w: w != ""))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(conditions.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    key = F.unhex(F.sha2("text", 256))
    return split.select(key.alias("key"), F.coalesce("doc_id", F.lit(LAST)).alias("id"), "doc_id", "part", mask.cast("int").alias("mask"))


def flags(labels: DataFrame) -> DataFrame:
    """doc_id, quality, toxic: whether a row of the document says so."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("quality"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))


class Audit:
    """Keyed text state and part counters of one stream, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, labels: DataFrame, conditions: dict[str, Callable[[Column, Column], Column]]):
        self.spark, self.path, self.labels, self.conditions = spark, path, labels, conditions
        self.copy = 1 << len(conditions)
        for name, schema in (("state", STATE), ("counts", COUNTS)):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}/batch=-1")

    def _log(self, name: str, schema: str, batch: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows if batch is None else rows.filter(F.col("batch") < batch)

    def _put(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/batch={batch}")

    def take(self, docs: DataFrame, batch: int) -> None:
        """One micro-batch. Whatever it wrote in an earlier attempt is written anew from what smaller batches left."""
        own = masks(docs, self.conditions).join(flags(self.labels), "doc_id", "left")
        no = F.lit(False)
        own = own.select("key", "id", "part", "mask", F.coalesce("quality", no).alias("quality"), F.coalesce("toxic", no).alias("toxic"))
        own = self._put(own.groupBy("key", "id", *MARKS).agg(F.count("*").alias("n")), "rows", batch)  # narrow, and summed before it is shuffled
        least = own.groupBy("key").agg(F.min("id").alias("least"))
        held = self._log("state", STATE, batch).join(least.select("key"), "key", "left_semi").drop("batch")
        was = held.groupBy("key").agg(F.min("id").alias("was"))
        # What stays the first of its text, what becomes it, and what was it until now
        turn = self._put(least.join(was, "key", "left"), "turns", batch)
        new = own.withColumnRenamed("id", "least").join(turn.filter("was is null or least <= was").drop("was"), ["key", "least"], "left_semi").withColumnRenamed("least", "id")
        new = self._put(new.select("key", "id", *MARKS, "n"), "state", batch)
        lost = held.withColumnRenamed("id", "was").join(turn.filter("least < was").drop("least"), ["key", "was"], "left_semi")
        as_copy = (F.col("mask") + self.copy).alias("mask")
        count = lambda rows, mask, sign: rows.select("part", mask, "quality", "toxic", (F.lit(sign) * F.col("n")).alias("n"))
        first = F.col("mask")
        deltas = count(own, as_copy, 1)
        for rows, up, down in ((new, first, as_copy), (lost, as_copy, first)):
            deltas = deltas.unionAll(count(rows, up, 1)).unionAll(count(rows, down, -1))
        self._put(deltas.groupBy(*MARKS).agg(F.sum("n").alias("n")).filter("n <> 0"), "counts", batch)
        for name in ("rows", "turns"):
            discard(self.spark, f"{self.path}/{name}/batch={batch}")

    def counters(self) -> DataFrame:
        """part, mask, quality, toxic, n: the counters after all batches."""
        return self._log("counts", COUNTS).groupBy(*MARKS).agg(F.sum("n").alias("n")).filter("n <> 0")


def orders(letters: str) -> Column:
    """All orders of the filters step by step: order, step, the filter's bit and the bits before it."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    rows = [("".join(p), k + 1, bit[c], sum(bit[x] for x in p[:k])) for p in itertools.permutations(letters) for k, c in enumerate(p)]
    return F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"p":{p}}}' for o, s, b, p in rows) + "]"), "array<struct<o:string,s:int,b:int,p:int>>")


def interactions(counters: DataFrame, letters: str) -> DataFrame:
    """The counts of every part, order and step from a part's counters by mask; rows of a part are bounded by the number of masks."""
    x = counters.withColumn("x", F.explode(orders(letters))).select("*", "x.*").drop("x")
    own, earlier = F.col("mask").bitwiseAND(F.col("b")) != 0, F.col("mask").bitwiseAND(F.col("p")) != 0
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(F.lit(0))).cast("long")
    gone = own & ~earlier
    steps = x.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "b").agg(
        total(~own & ~earlier).alias("kept"), total(gone).alias("removed"), total(own & earlier).alias("redundant"), total(F.col("mask") == F.col("b")).alias("unique_fails"),
        total(gone & F.col("quality")).alias("good_lost"), total(gone & F.col("toxic")).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "b"))).drop("b")


def audit(spark: SparkSession, path: str, labels: DataFrame, conditions: dict[str, Callable[[Column, Column], Column]] | None = None, batches: int = 4) -> DataFrame:
    """part, filter_order, step and the counts of each step, for the documents in the Parquet file or folder at path, read in so many micro-batches of files (fewer where there are fewer files).
    labels: doc_id, quality, toxic. They are read once for each micro-batch."""
    prepare(spark)
    conditions = CONDITIONS if conditions is None else conditions
    files = len(spark.read.schema(COLUMNS).parquet(path).inputFiles())
    state = Audit(spark, shared_folder(spark, "audit"), labels.select("doc_id", "quality", "toxic"), conditions)
    glob = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern
    rows = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(glob)
    rows.writeStream.foreachBatch(state.take).option("checkpointLocation", f"{state.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return interactions(state.counters(), "".join(conditions) + COPY)


_FAILS = {"A": "len(w) < 200", "B": "100 * len(list_distinct(w)) < 50 * len(w)", "C": "100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t)", "D": "regexp_matches(t, '[#$%&*|]')"}
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, {" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(_FAILS.values()))} + CASE WHEN d.doc_id > least THEN 16 ELSE 0 END AS mask, coalesce(q, 0) AS q, coalesce(x, 0) AS x FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(q) AS q, sum(x) AS x FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, bs[step] AS b, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS p FROM o, range(1, 6) r(step)),
g AS (
  SELECT part, filter_order, step, b, sum(CASE WHEN mask & (b | p) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & b > 0 AND mask & p = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & b > 0 AND mask & p > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & b > 0 AND mask & p = 0 THEN q ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & b > 0 AND mask & p = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM g
"""
