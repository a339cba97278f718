"""The run ledger: states of runs, their links to documents, and lineage from the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .requestlog import scanned


def latest(runs: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The latest row of each group."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def classified(runs: DataFrame) -> DataFrame:
    """Runs with state: done, resumable (in progress without an end, or interrupted), or failed (an error, resumed only on demand), and the page to go on from."""
    state = F.when(F.col("status") == "zakonczony", "done").when(F.col("status") == "blad", "failed").otherwise("resumable")
    page = F.when(state == "done", None).otherwise(F.coalesce("last_page", F.lit(1)))
    return runs.withColumns({"state": state, "resume_page": page})


def numbered(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], cut: Column | None = None) -> DataFrame:
    """rows with position, from 1 on without gaps in each group. cut: as in requestlog.scanned, so that a group of a whole corpus is numbered by many tasks."""
    return scanned(rows, by, order, cut, {"position": ("sum", F.lit(1).cast("long"))})


def first_links(links: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One link for each run and document: the first by order; positions run on without gaps."""
    w = W.partitionBy("run_id", "doc_id").orderBy(*order)
    kept = links.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return kept.withColumn("position", F.row_number().over(W.partitionBy("run_id").orderBy(*order, "doc_id")))


def continued(links: DataFrame, before: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Positions of new links of a run, which go on from the largest that before has."""
    start = before.groupBy("run_id").agg(F.max("position").alias("_last"))
    w = W.partitionBy("run_id").orderBy(*order)
    return links.join(start, "run_id", "left").withColumn("position", F.row_number().over(w) + F.coalesce("_last", F.lit(0))).drop("_last")


def counts(runs: DataFrame, links: DataFrame, requests: DataFrame) -> DataFrame:
    """runs with linked and new documents, requests, and those after the first try. Each side is summed before the join."""
    docs = links.groupBy("run_id").agg(F.count("*").alias("documents"), F.count_if("nowy").alias("new_documents"))
    asked = requests.groupBy("run_id").agg(F.count("*").alias("requests"), F.count_if(F.col("attempt") > 1).alias("retries"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("documents", "new_documents", "requests", "retries")}
    return runs.join(docs, "run_id", "left").join(asked, "run_id", "left").withColumns(zero)


def rebuilt_lineage(runs: DataFrame, links: DataFrame, requests: DataFrame, versions: DataFrame) -> DataFrame:
    """run_id, doc_id, position, nowy for runs without links, from what they requested: a hash that belongs to exactly one document names it; positions follow the first request for it."""
    one = versions.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("_other")).filter("doc_id = _other").drop("_other")
    bare = runs.select("run_id").join(links.select("run_id"), "run_id", "left_anti")
    first = requests.join(bare, "run_id", "left_semi").join(one, "sha256").groupBy("run_id", "doc_id").agg(F.min("ts").alias("first_ts"))
    w = W.partitionBy("run_id").orderBy("first_ts", "doc_id")
    return first.select("run_id", "doc_id", F.row_number().over(w).alias("position"), F.lit(True).alias("nowy"))


def union_of_runs(links: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The documents of several runs, each once, with its first occurrence."""
    return latest(links.withColumn("_neg", -F.row_number().over(W.partitionBy("doc_id").orderBy(*order))), ("doc_id",), ("_neg",)).drop("_neg")


def outcome_summary(batch: DataFrame) -> DataFrame:
    """One row: candidates, new, skipped, missing and unread ones of a batch with the flags nowy, missing and parse_error."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return batch.agg(F.count("*").alias("candidates"), flag(F.col("nowy")).alias("new"), flag(~F.col("nowy")).alias("skipped"), flag(F.col("missing")).alias("missing"), flag(F.col("parse_error")).alias("errors"))


def documents_of(links: DataFrame, docs: DataFrame, run_id, key: str = "doc_id") -> DataFrame:
    """The documents of one run in the order in which it met them."""
    own = links.filter(F.col("run_id") == run_id).select(key, "position")
    return docs.join(own, key).orderBy("position", key)


def listed(runs: DataFrame, k: int, wanted: Column | None = None, started: str = "started", inserted: str = "run_id") -> DataFrame:
    """The k latest runs among those wanted, the newest first, ties by insertion."""
    return (runs if wanted is None else runs.filter(wanted)).orderBy(F.desc(started), F.desc(inserted)).limit(k)


def selected(docs: DataFrame, links: DataFrame | None = None, order: tuple[str, ...] = (), criteria: Column | None = None, key: str = "doc_id") -> DataFrame:
    """The documents of an export: those of some runs (links), each once where it comes first, or those that criteria let through; never both."""
    if (links is None) == (criteria is None):
        raise ValueError("an export is by runs or by criteria")
    return docs.filter(criteria) if links is None else docs.join(union_of_runs(links, order).select(key, *order), key)


def requests_of(requests: DataFrame, runs: DataFrame, channel: str, since: str, ts: str = "ts") -> DataFrame:
    """The requests of a channel's runs since a time."""
    own = runs.filter(F.col("channel") == channel).select("run_id", "channel")
    return requests.filter(F.col(ts) >= F.lit(since).cast(requests.schema[ts].dataType)).join(own, "run_id")
