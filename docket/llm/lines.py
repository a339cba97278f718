"""Line dedup by site-relative frequency: a line is boilerplate where too large a share of its host's pages hold it.

A line is what lies between line feeds; it is compared without white space around it. Blank lines are never boilerplate. A line is dropped where
at least min_pages of its host's pages hold it and they are more than max_ratio of all the host's pages. DataFrame functions only.

Defined results: a null text stays null and has no lines; an empty text stays empty. A null host is a host of its own. A line counts once for each page.
Repeated rows count as pages of their own. A text whose lines all go becomes empty; its row stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

MAX_RATIO, MIN_PAGES = 0.1, 10
WHITE = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    """64 bits for a line; null for a blank one."""
    bare = F.trim(line, F.lit(WHITE))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host, _lines: the keys of each host's boilerplate lines. Pages of m lines on average give a host at most m / max_ratio of them, however many its pages."""
    # Key 0 stands for the page itself, and so do its blank lines
    keys = F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.split(F.coalesce("_text", F.lit("")), "\n", -1), lambda x: F.coalesce(_key(x), F.lit(0).cast("long")))))
    pages = df.select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    held = pages.select("_host", F.explode(keys).alias("_key")).groupBy("_host", "_key").agg(F.count("*").alias("_pages"))
    held = stored(held.filter(F.col("_pages") >= F.when(F.col("_key") == 0, 1).otherwise(min_pages)), "lines")
    total = held.filter("_key = 0").select("_host", F.col("_pages").alias("_all"))
    lines = held.filter("_key <> 0").withColumnRenamed("_host", "_of")
    frequent = lines.join(total, F.col("_of").eqNullSafe(F.col("_host"))).filter(F.col("_pages") > F.lit(float(max_ratio)) * F.col("_all"))
    return frequent.groupBy("_host").agg(F.collect_list("_key").alias("_lines"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with the boilerplate lines gone from text, and n_lines and n_dropped for each row (columns of these names are replaced)."""
    its_host, its_lines, kept_lines = (unused(df, name) for name in ("_host", "_lines", "_kept"))
    found = stored(boilerplate(df, host, text, max_ratio, min_pages), "boilerplate")  # Spark broadcasts it only if its files are small
    found = found.select(F.col("_host").alias(its_host), F.col("_lines").alias(its_lines))
    joined = df.join(found, F.col(host).eqNullSafe(F.col(its_host)), "left")
    split = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col(its_lines).isNull(), split).otherwise(F.filter(split, lambda x: ~F.coalesce(F.array_contains(its_lines, _key(x)), F.lit(False))))
    joined = joined.withColumn(kept_lines, kept)
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long")
    left = F.when(F.col(text).isNull(), 0).otherwise(F.size(kept_lines)).cast("long")
    return joined.withColumns({"n_lines": lines, "n_dropped": lines - left, text: F.array_join(kept_lines, "\n")}).drop(its_host, its_lines, kept_lines)


ORACLE_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (SELECT DISTINCT r, source, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS x FROM pages)),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
found AS (
  SELECT source, list(k) AS ks FROM (
    SELECT l.source, k FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE k <> ''
    GROUP BY l.source, k, n HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO}::DOUBLE * n)
  GROUP BY source),
cut AS (
  SELECT doc_id, p.text AS was, string_split(p.text, chr(10)) AS parts,
    list_filter(string_split(p.text, chr(10)), lambda x: NOT coalesce(list_contains(ks, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), false)) AS kept
  FROM pages p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(parts) - len(kept), 0)::BIGINT AS n_dropped,
  CASE WHEN was IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
"""
