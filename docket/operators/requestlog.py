"""Audits of a request log: streaks of failures, rolling budgets, spacing, cool-down, stability of bytes, and what a load would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Requests allowed within so many seconds.
BUDGETS = ((450, 60), (1400, 86_400))
SPACING_S = 0.2


def micros(ts: str) -> Column:
    """Microseconds of a timestamp, read as UTC where it names no zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def scanned(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], cut: Column | None, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with values by what comes before each row of its group: name: (kind, of), kind being before (of the row just before), sum (with the row itself), or max (without it).

    cut: numbers that don't fall along order, such as hours or thousands of ids. A group is then scanned in parts that tasks share: each part is summed up, the sums are scanned, one row for each part, and
    what they come to is carried into the parts. So a group of any size is spread over as many tasks as it has parts. Null: groups are scanned whole.
    """
    keys, part = list(by), "_part"
    rows = df.withColumn(part, F.lit(0).cast("long") if cut is None else F.coalesce(cut.cast("long"), F.lit(-(1 << 62)))).withColumns({f"_of_{n}": of for n, (_, of) in values.items()})
    inner = W.partitionBy(*keys, part).orderBy(*order)
    above = inner.rowsBetween(W.unboundedPreceding, -1)
    own = {"before": lambda c: F.lag(F.struct(c)).over(inner), "sum": lambda c: F.sum(c).over(inner.rowsBetween(W.unboundedPreceding, 0)), "max": lambda c: F.max(c).over(above)}
    if cut is None:
        carried = rows.withColumns({f"_in_{n}": F.lit(None) for n in values})
    else:
        place = F.struct(*order)
        summed = {"before": lambda c: F.max_by(F.struct(c), place), "sum": F.sum, "max": F.max}
        parts = rows.groupBy(*keys, part).agg(*[summed[kind](F.col(f"_of_{n}")).alias(f"_in_{n}") for n, (kind, _) in values.items()])
        outer = W.partitionBy(*keys).orderBy(part)
        earlier = outer.rowsBetween(W.unboundedPreceding, -1)
        over = {"before": lambda c: F.lag(c).over(outer), "sum": lambda c: F.sum(c).over(earlier), "max": lambda c: F.max(c).over(earlier)}
        parts = parts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(part).alias("_of_part"), *[over[kind](f"_in_{n}").alias(f"_in_{n}") for n, (kind, _) in values.items()])
        same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col(part) == F.col("_of_part")]
        joined = same[0]
        for c in same[1:]:
            joined = joined & c
        carried = rows.join(parts, joined, "left").drop(*[f"_key_{k}" for k in keys], "_of_part")

    def value(name: str, kind: str) -> Column:
        here, before = own[kind](F.col(f"_of_{name}")), F.col(f"_in_{name}")
        if cut is None:
            return here.getField(f"_of_{name}") if kind == "before" else here
        if kind == "before":
            return F.coalesce(here, before).getField(f"_of_{name}")
        return F.coalesce(before, F.lit(0)) + here if kind == "sum" else F.greatest(before, here)  # greatest skips nulls

    out = carried.withColumns({n: value(n, kind) for n, (kind, _) in values.items()})
    return out.drop(part, *[f"{x}_{n}" for n in values for x in ("_of", "_in")])


def streaks(log: DataFrame, failed: Column, reset: Column, least: int, by: tuple[str, ...], order: tuple[str, ...], cut: Column | None = None) -> DataFrame:
    """by, first, last, length of runs of at least least failures; a reset ends one, rows that are neither don't matter. cut: as in scanned."""
    marked = scanned(log.withColumn("_f", failed), by, order, cut, {"_g": ("sum", reset.cast("int"))})
    return marked.filter("_f").groupBy(*by, "_g").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("_g")


def rolling(log: DataFrame, seconds: int, most: int, by: tuple[str, ...], ts: str = "ts", split: bool = False) -> DataFrame:
    """Requests of the seconds up to and including each one, and whether they are more than most. split: stretches of so many seconds are counted each on its own, with the one before it, so that a
    group is spread over tasks by time."""
    size = seconds * 1_000_000
    rows = log.withColumn("_us", micros(ts))
    if split:
        stretch = F.floor(F.col("_us") / F.lit(size)).cast("long")
        rows = rows.withColumn("_stretch", F.explode(F.when(stretch.isNull(), F.array(stretch)).otherwise(F.array(stretch, stretch + 1))))
        w = W.partitionBy(*by, "_stretch").orderBy("_us").rangeBetween(-(size - 1), 0)
        own = F.col("_stretch").eqNullSafe(stretch)
        return rows.withColumn("in_window", F.count("*").over(w)).filter(own).withColumn("over", F.col("in_window") > most).drop("_us", "_stretch")
    w = W.partitionBy(*by).orderBy("_us").rangeBetween(-(size - 1), 0)
    return rows.withColumn("in_window", F.count("*").over(w)).withColumn("over", F.col("in_window") > most).drop("_us")


def spacing(log: DataFrame, least_s: float, by: tuple[str, ...], order: tuple[str, ...], ts: str = "ts", cut: Column | None = None) -> DataFrame:
    """Seconds since the request before, and whether they are too few; null for the first. cut: as in scanned."""
    rows = scanned(log, by, order, cut, {"_last": ("before", micros(ts))})
    return rows.withColumn("gap_s", (micros(ts) - F.col("_last")) / 1e6).withColumn("too_close", F.col("gap_s") < least_s).drop("_last")


def cooldown(log: DataFrame, limited: Column, retry_after_s: Column, own_s: float, by: tuple[str, ...], order: tuple[str, ...], ts: str = "ts", cut: Column | None = None) -> DataFrame:
    """Whether a request came before the end of a cool-down: after a limited one, the longer of our own wait and the one it asked for. cut: as in scanned."""
    until = F.when(limited, micros(ts) + (F.greatest(F.lit(own_s), F.coalesce(retry_after_s, F.lit(0.0))) * 1e6).cast("long"))
    rows = scanned(log, by, order, cut, {"_until": ("max", until)})
    return rows.withColumn("blocked", F.coalesce(micros(ts) < F.col("_until"), F.lit(False))).drop("_until")


def stability(log: DataFrame, by: tuple[str, ...], order: tuple[str, ...], content: str, least_h: float, ts: str = "ts", cut: Column | None = None) -> DataFrame:
    """verdict on each read against the one before of the same address: first, too_early, stable, unstable, unknown_gap (no time), or not_comparable (no content). cut: as in scanned."""
    rows = scanned(log, by, order, cut, {"_was": ("before", F.struct(F.col(content).alias("content"), micros(ts).alias("us")))})
    before, hours = F.col("_was.content"), (micros(ts) - F.col("_was.us")) / 3.6e9
    verdict = (
        F.when(F.col("_was").isNull(), "first").when(F.col(content).isNull() | before.isNull(), "not_comparable").when(hours.isNull(), "unknown_gap")
        .when(F.col(content) != before, "unstable").when(hours < least_h, "too_early").otherwise("stable")
    )
    return rows.withColumn("verdict", verdict).drop("_was")


def profile(log: DataFrame, by: tuple[str, ...], status: str, ms: str) -> DataFrame:
    """by, status, n, mean and largest duration."""
    return log.groupBy(*by, status).agg(F.count("*").alias("n"), F.round(F.avg(ms), 6).alias("mean_ms"), F.max(ms).alias("max_ms"))


def load_cost(plan: DataFrame, page_size: int = 100, spacing_s: float = SPACING_S, budgets: tuple[tuple[int, int], ...] = BUDGETS, most_tries: int = 4, threshold: int = 50, most: int | None = None) -> DataFrame:
    """plan (listed, known, pages_read) with what is left: documents (of at most so many, where most says so), pages, requests, the least time in seconds by spacing and by every budget of
    requests within a time, and whether requests with all retries pass the threshold at which one asks first. Null counts give null costs."""
    floor0 = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0)))  # noqa: E731  greatest alone would skip the null
    documents = F.col("listed") if most is None else F.least("listed", F.lit(most))  # least skips a null: of an unknown number, the cap
    left = floor0(documents - F.col("known"))
    pages = floor0(F.ceil(documents / page_size) - F.col("pages_read"))
    priced = plan.withColumns({"docs_left": left, "pages_left": pages}).withColumn("requests", F.col("docs_left") + F.col("pages_left"))
    before = F.greatest(F.col("requests") - 1, F.lit(0))  # requests that the last one waits for
    waits = [F.floor(before / n) * float(s) for n, s in budgets]
    seconds = F.greatest(before * spacing_s, *waits)
    ceiling = F.col("requests") * most_tries
    return priced.withColumns({"least_seconds": F.when(F.col("requests").isNotNull(), F.round(seconds, 6)), "ceiling": ceiling, "ask_first": ceiling > threshold})
