"""Queries of the run ledger, the request log and response shapes: users stand for runs, events for requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.operators import filters, quality, requestlog, runs
from docket.sources.tables import table

def _hash():
    return F.concat(F.col("event_type"), F.lit(":"), F.floor("value").cast("string"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run_id"), "event_type", "value", "props")


def _week() -> Column:
    """Parts of a run that are scanned on their own, so that one with most requests is no single task."""
    return F.floor(requestlog.micros("ts") / F.lit(7 * 86_400_000_000))


def run_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests in the order of their time, numbered from 1 on as one run."""
    return runs.numbered(_events(spark, sf_dir).select("event_id", "ts", F.lit("all").alias("run")), ("run",), ("ts", "event_id"), _week()).select("event_id", "position")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user: its last event decides its status."""
    last = runs.latest(_events(spark, sf_dir), ("run_id",), ("ts", "event_id"))
    status = F.when(F.col("event_type") == "error", "blad").when(F.col("event_type") == "purchase", "zakonczony").otherwise("w_toku")
    return last.select("run_id", status.alias("status"), F.when(F.col("event_type") != "signup", F.floor("value").cast("int")).alias("last_page"), F.col("event_id").alias("last_event"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.classified(_runs(spark, sf_dir)).select("run_id", "last_event", "state", "resume_page")


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    links = runs.first_links(events.filter("event_type in ('purchase', 'view')").select("run_id", F.floor("value").cast("long").alias("doc_id"), "ts", "event_id", (F.col("event_type") == "purchase").alias("nowy")), ("ts", "event_id"))
    requests = events.select("run_id", F.when(F.col("event_type") == "error", 2).otherwise(1).alias("attempt"))
    return runs.counts(_runs(spark, sf_dir).select("run_id", "status"), links, requests)


def lineage_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs have links, the others none. Type and value of an event stand for a hash; those of signups may belong to two documents."""
    events, ledger = _events(spark, sf_dir), _runs(spark, sf_dir)
    doc = F.floor("value").cast("long") % 7 + F.when(F.col("event_type") == "signup", F.col("run_id") % 2 * 10).otherwise(0)
    versions = events.select(_hash().alias("sha256"), doc.alias("doc_id")).distinct()
    return runs.rebuilt_lineage(ledger, ledger.filter("status = 'zakonczony'").select("run_id"), events.select("run_id", "ts", _hash().alias("sha256")), versions)


def union_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _events(spark, sf_dir).select(F.floor("value").cast("long").alias("doc_id"), "run_id", "ts", "event_id")
    return runs.union_of_runs(links, ("ts", "event_id")).select("doc_id", "run_id", "event_id")


def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed, reset = F.col("event_type").isin("error", "view"), F.col("event_type").isin("purchase", "signup")
    return requestlog.streaks(_events(spark, sf_dir), failed, reset, 3, ("run_id",), ("event_id",), cut=F.floor(F.col("event_id") / 1000))


def rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.rolling(_events(spark, sf_dir), 86_400, 3, ("event_type", "run_id"), split=True).select("event_id", "in_window", "over")


def min_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.spacing(_events(spark, sf_dir), 3600.0, ("run_id",), ("ts", "event_id"), cut=_week()).select("event_id", "gap_s", "too_close")


def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requestlog.cooldown(_events(spark, sf_dir), F.col("event_type") == "error", F.col("value") * 600, 3600.0, ("run_id",), ("ts", "event_id"), cut=_week())
    return rows.select("event_id", "blocked")


def byte_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requestlog.stability(_events(spark, sf_dir).withColumn("content", F.when(F.col("event_type") != "error", F.col("event_type"))), ("run_id",), ("ts", "event_id"), "content", 24.0, cut=_week())
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def request_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return requestlog.profile(_events(spark, sf_dir).select("*", day), ("day",), "event_type", "value")


def continued_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a resumed run, whose positions go on from those of views."""
    events = _events(spark, sf_dir)
    before = runs.first_links(events.filter("event_type = 'view'").select("run_id", F.floor("value").cast("long").alias("doc_id"), "ts", "event_id"), ("ts", "event_id"))
    return runs.continued(events.filter("event_type = 'click'").select("run_id", "event_id"), before, ("event_id",)).select("run_id", "event_id", "position")


def criteria_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs that were stored with their criteria, which odd ones write in another order, with repeats and an empty field: what was asked for, and by how many runs."""
    quoted = lambda *cs: F.concat(F.lit('["'), F.concat_ws('", "', *cs), F.lit('"]'))
    status, kinds = F.col("o_orderstatus"), quoted("o_orderpriority")
    even = F.concat(F.lit('{"since": "1995-01-01", "outcomes": '), quoted(status, F.lit("Z")), F.lit(', "kinds": '), kinds, F.lit("}"))
    odd = F.concat(F.lit('{"until": "", "party": null, "kinds": '), kinds, F.lit(', "outcomes": '), quoted(F.lit("Z"), status, F.lit("Z")), F.lit(', "since": "1995-01-01"}'))
    stored = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, even).otherwise(odd).alias("stored"))
    return stored.groupBy(filters.canonical(F.col("stored")).alias("criteria"), filters.fingerprint(F.col("stored")).alias("fingerprint")).agg(F.count("*").alias("runs"))


def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest runs that can be resumed."""
    ledger = _runs(spark, sf_dir).join(_events(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("started")), "run_id")
    return runs.listed(runs.classified(ledger), 20, F.col("state") == "resumable").select("run_id", "status", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"))


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one run, in its order; values of events stand for documents."""
    links = runs.first_links(_events(spark, sf_dir).select("run_id", F.floor("value").cast("long").alias("doc_id"), "ts", "event_id"), ("ts", "event_id"))
    return runs.documents_of(links, table(spark, sf_dir, "documents").select("doc_id", "lang"), 7).select("doc_id", "lang", "position")


def requests_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a channel's runs since a day, by type; even runs belong to one channel, odd ones to the other."""
    events = _events(spark, sf_dir)
    ledger = events.select("run_id", F.when(F.col("run_id") % 2 == 0, "atlas").otherwise("uzp").alias("channel")).distinct()
    since = runs.requests_of(events, ledger, "atlas", "2024-01-15")
    return since.groupBy("channel", "event_type").agg(F.count("*").alias("n"))


def capped_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of loads of at most 500 documents of each month."""
    orders = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    plan = orders.agg(F.when(F.count("*") % 5 > 0, F.count("*")).alias("listed"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("known"), F.lit(1).cast("long").alias("pages_read"))
    return requestlog.load_cost(plan, most=500).select("month", "docs_left", "pages_left", "requests", "least_seconds")


def vintage_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each month of orders: urgent ones are known."""
    orders = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    plan = orders.agg(F.count("*").alias("listed"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("known"), F.lit(1).cast("long").alias("pages_read"))
    return requestlog.load_cost(plan).select("month", "docs_left", "pages_left", "requests", "least_seconds", "ceiling", "ask_first")


def shape_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties, wrapped as a page of records; those of errors come cut off."""
    body = F.concat(F.lit('{"data": ['), F.col("props"), F.when(F.col("event_type") == "error", "").otherwise("]}"))
    rows = quality.list_shape(_events(spark, sf_dir).select("event_type", body.alias("body")), "body", "data")
    return rows.groupBy("event_type", "ok", "transient").agg(F.count("*").alias("n"))


def shape_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.record_shape(_events(spark, sf_dir).select("event_type", "props"), "props", ("k",))
    return rows.groupBy("event_type", "ok", "place").agg(F.count("*").alias("n"))


FRAGMENTS, MARKERS = ("<!DOCTYPE html", "<article>", "<table"), ("licensed under", "<p>", "copyright")


def shape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.html_shape(table(spark, sf_dir, "pages"), "html", FRAGMENTS)
    return rows.select("page_id", "ok", F.array_join("missing", ",").alias("missing"))


def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.marker_counts(table(spark, sf_dir, "pages"), "page_id", "html", MARKERS)


QUERIES = {f.__name__: f for f in (
    run_positions, latest_run, run_ledger, lineage_rebuild, union_of_runs, error_streaks, rolling_budget, min_spacing, cooldown, byte_stability, request_profile, continued_positions, criteria_of_runs, run_list,
    run_documents, requests_by_channel, capped_cost, vintage_cost_estimate,
    shape_list, shape_record, shape_html, marker_counts,
)}

_E = "WITH e AS (SELECT event_id, ts, user_id AS run_id, event_type, value, props, epoch_us(ts) AS us FROM events), r AS (SELECT *, CASE event_type WHEN 'error' THEN 'blad' WHEN 'purchase' THEN 'zakonczony' ELSE 'w_toku' END AS status FROM e QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1) "
ORACLE_SQL = {
    "latest_run": _E + "SELECT run_id, event_id AS last_event, CASE status WHEN 'zakonczony' THEN 'done' WHEN 'blad' THEN 'failed' ELSE 'resumable' END AS state, CASE WHEN status <> 'zakonczony' THEN coalesce(CASE WHEN event_type <> 'signup' THEN floor(value)::INT END, 1) END AS resume_page FROM r",
    "run_ledger": _E
    + ", l AS (SELECT run_id, floor(value)::BIGINT AS doc_id, event_type = 'purchase' AS nowy FROM e WHERE event_type IN ('purchase', 'view') QUALIFY row_number() OVER (PARTITION BY run_id, floor(value)::BIGINT ORDER BY ts, event_id) = 1) SELECT run_id, status, (SELECT count(*) FROM l WHERE l.run_id = r.run_id) AS documents, (SELECT count(*) FROM l WHERE l.run_id = r.run_id AND nowy) AS new_documents, (SELECT count(*) FROM e WHERE e.run_id = r.run_id) AS requests, (SELECT count(*) FROM e WHERE e.run_id = r.run_id AND event_type = 'error') AS retries FROM r",
    "lineage_rebuild": _E
    + ", v AS (SELECT DISTINCT event_type || ':' || floor(value)::BIGINT AS h, (floor(value)::BIGINT % 7) + CASE WHEN event_type = 'signup' THEN run_id % 2 * 10 ELSE 0 END AS doc_id FROM e), one AS (SELECT h, min(doc_id) AS doc_id FROM v GROUP BY h HAVING count(*) = 1), f AS (SELECT run_id, one.doc_id, min(ts) AS t FROM e JOIN one ON event_type || ':' || floor(value)::BIGINT = h WHERE run_id NOT IN (SELECT run_id FROM r WHERE status = 'zakonczony') GROUP BY ALL) SELECT run_id, doc_id, row_number() OVER (PARTITION BY run_id ORDER BY t, doc_id)::INT AS position, true AS nowy FROM f",
    "union_of_runs": _E + "SELECT floor(value)::BIGINT AS doc_id, run_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY floor(value)::BIGINT ORDER BY ts, event_id) = 1",
    "error_streaks": _E + ", g AS (SELECT *, sum((event_type IN ('purchase', 'signup'))::INT) OVER (PARTITION BY run_id ORDER BY event_id) AS g FROM e) SELECT run_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g WHERE event_type IN ('error', 'view') GROUP BY run_id, g HAVING count(*) >= 3",
    "rolling_budget": _E + "SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS over FROM e WINDOW w AS (PARTITION BY event_type, run_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)",
    "min_spacing": _E + ", g AS (SELECT event_id, (us - lag(us) OVER (PARTITION BY run_id ORDER BY ts, event_id)) / 1e6 AS gap_s FROM e) SELECT event_id, gap_s, gap_s < 3600 AS too_close FROM g",
    "cooldown": _E + "SELECT event_id, coalesce(us < max(CASE WHEN event_type = 'error' THEN us + trunc(greatest(3600.0::DOUBLE, coalesce(value * 600, 0)) * 1e6)::BIGINT END) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM e",
    "byte_stability": _E
    + ", g AS (SELECT nullif(event_type, 'error') AS c, lag(nullif(event_type, 'error')) OVER w AS p, (us - lag(us) OVER w) / 3.6e9 AS h, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)) SELECT CASE WHEN n = 1 THEN 'first' WHEN c IS NULL OR p IS NULL THEN 'not_comparable' WHEN h IS NULL THEN 'unknown_gap' WHEN c <> p THEN 'unstable' WHEN h < 24 THEN 'too_early' ELSE 'stable' END AS verdict, count(*) AS n FROM g GROUP BY 1",
    "request_profile": _E + "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM e GROUP BY ALL",
    "vintage_cost_estimate": "WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS listed, count(*) FILTER (o_orderpriority = '1-URGENT') AS known FROM orders GROUP BY 1), c AS (SELECT month, listed - known AS docs_left, greatest(ceil(listed / 100)::BIGINT - 1, 0) AS pages_left FROM p), q AS (SELECT *, docs_left + pages_left AS requests FROM c) SELECT *, round(greatest((requests - 1) * 0.2::DOUBLE, floor(greatest(requests - 1, 0) / 450) * 60.0::DOUBLE, floor(greatest(requests - 1, 0) / 1400) * 86400.0::DOUBLE, 0.0::DOUBLE), 6) AS least_seconds, requests * 4 AS ceiling, requests * 4 > 50 AS ask_first FROM q",
    "shape_list": "SELECT event_type, event_type <> 'error' AS ok, event_type = 'error' AS transient, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY ALL",
    "run_positions": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events",
    "shape_record": "SELECT event_type, json_contains(json_keys(props)::JSON, '\"k\"') AS ok, CASE WHEN json_contains(json_keys(props)::JSON, '\"k\"') THEN '$' END AS place, count(*) AS n FROM events GROUP BY ALL",
    "shape_html": "SELECT page_id, array_to_string(m, ',') = '' AS ok, array_to_string(m, ',') AS missing FROM (SELECT page_id, list_filter([CASE WHEN NOT contains(lower(html), '<!doctype html') THEN '<!DOCTYPE html' END, CASE WHEN NOT contains(lower(html), '<article>') THEN '<article>' END, CASE WHEN NOT contains(lower(html), '<table') THEN '<table' END], lambda x: x IS NOT NULL) AS m FROM pages)",
    "marker_counts": "SELECT page_id, m.marker, ((length(lower(html)) - length(replace(lower(html), m.marker, ''))) / length(m.marker))::BIGINT AS n FROM pages, (VALUES ('licensed under'), ('<p>'), ('copyright')) m(marker)",
    "continued_positions": _E + ", l AS (SELECT run_id, count(DISTINCT floor(value)::BIGINT) AS k FROM e WHERE event_type = 'view' GROUP BY 1) SELECT run_id, event_id, (row_number() OVER (PARTITION BY run_id ORDER BY event_id) + coalesce(k, 0))::INT AS position FROM e LEFT JOIN l USING (run_id) WHERE event_type = 'click'",
    "criteria_of_runs": """WITH c AS (SELECT '{"kinds":["' || o_orderpriority || '"],"outcomes":["' || o_orderstatus || '","Z"],"since":"1995-01-01"}' AS criteria FROM orders) SELECT criteria, substr(sha256(criteria), 1, 16) AS fingerprint, count(*) AS runs FROM c GROUP BY criteria""",
    "run_list": _E + ", b AS (SELECT run_id, min(ts) AS started FROM e GROUP BY 1) SELECT run_id, status, strftime(started, '%Y-%m-%d %H:%M:%S') AS started FROM r JOIN b USING (run_id) WHERE status = 'w_toku' ORDER BY b.started DESC, run_id DESC LIMIT 20",
    "run_documents": _E + ", l AS (SELECT floor(value)::BIGINT AS doc_id, ts, event_id FROM e WHERE run_id = 7 QUALIFY row_number() OVER (PARTITION BY floor(value)::BIGINT ORDER BY ts, event_id) = 1), p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, doc_id)::INT AS position FROM l) SELECT doc_id, lang, position FROM documents JOIN p USING (doc_id)",
    "requests_by_channel": _E + "SELECT 'atlas' AS channel, event_type, count(*) AS n FROM e WHERE run_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-15' GROUP BY ALL",
    "capped_cost": "WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN count(*) % 5 > 0 THEN count(*) END AS listed, count(*) FILTER (o_orderpriority = '1-URGENT') AS known FROM orders GROUP BY 1), d AS (SELECT month, coalesce(least(listed, 500), 500) AS n, known FROM p), c AS (SELECT month, greatest(n - known, 0) AS docs_left, greatest(ceil(n / 100)::BIGINT - 1, 0) AS pages_left FROM d), q AS (SELECT *, docs_left + pages_left AS requests FROM c) SELECT *, round(greatest((requests - 1) * 0.2::DOUBLE, floor(greatest(requests - 1, 0) / 450) * 60.0::DOUBLE, floor(greatest(requests - 1, 0) / 1400) * 86400.0::DOUBLE, 0.0::DOUBLE), 6) AS least_seconds FROM q",
}
