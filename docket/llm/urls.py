"""URL filter: fixed rules first, then empirical-Bayes host reputation.

Labelled pages are good or bad. Bad shares shrink through beta-binomial priors: from the whole table to the suffix, to the registered domain, to the host.
A host is blocked when the lower posterior bound of its bad share passes a limit, that is, when by its beta posterior the share is over the limit with at least the wanted
probability. The beta distribution function is a continued fraction at all sizes; its steps grow with the square root of a host's pages, as its convergence takes.

A page's label comes through the document whose number its url's path ends in; pages without one count for nothing in the reputations, but are judged like the others.

Defined results: a null url, or one without ://, has an empty host and path; the empty host has a reputation of its own like any other. A host without labelled
pages has its domain's prior, and so on up; without any label at all everything is allowed. Repeated pages keep their rows; their outcomes count as often as
they occur. Equal rules are one. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, rule)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LEVELS = ("suffix", "domain", "host")
#: Public suffixes of two labels, under which a registered domain has three. A longer list may be given.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz", "co.za", "com.pl", "org.pl")
MAX_BAD = 0.5
SURE = 0.95  # probability with which the bound holds
STEPS, MORE = 200, 4  # of the continued fraction, and more for each square root of pages
STRENGTH = 20.0  # pages that the parent's share counts for, where the children's spread doesn't tell


def parts(url: Column) -> dict[str, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))}


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, or null, and its verdict."""
    fit, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(set(rules), key=lambda r: (len(r[1]), r[1])):  # the longest comes last and wins
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        fit, verdict = F.when(fits, F.lit(text)).otherwise(fit), F.when(fits, F.lit(what)).otherwise(verdict)
    return fit, verdict


def _names(host: Column, suffixes: Sequence[str]) -> dict[str, Column]:
    """The suffix is the last label, or the last two where they are listed; the registered domain has one label more."""
    last = lambda k: F.substring_index(host, ".", -k)
    double = last(2).isin(*suffixes) if suffixes else F.lit(False)
    return {"suffix": F.when(double, last(2)).otherwise(last(1)), "domain": F.when(double, last(3)).otherwise(last(2)), "host": host}


def _beyond_stirling(z: Column) -> Column:
    """log Gamma(z) less (z - 1/2) log z - z + log(2 pi) / 2: small at all sizes, so that sums of it keep their places. Stirling's series, taken eight steps up."""
    y = z + 8.0
    rest = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    up = F.lit(0.0)
    for k in range(8):
        up = up + F.log1p(k / z)  # log z(z+1)...(z+7) less 8 log z
    return rest + (y - 0.5) * F.log1p(8.0 / z) - 8.0 - up


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method. It converges within some square roots of a + b."""
    first = 1 / (1 - (a + b) * x / (a + 1))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(s: Column, t: Column) -> Column:
        d, c = 1 / (1 + t * s["d"]), 1 + t / s["c"]
        return state(c, d, s["h"] * d * c)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return half(half(s, even), odd)

    steps = F.transform(F.sequence(F.lit(1), F.lit(STEPS) + (MORE * F.ceil(F.sqrt(a + b))).cast("int")), lambda m: m.cast("double"))
    return F.aggregate(steps, state(F.lit(1.0), first, first), step)["h"]


def probability_over(mean: Column, n: Column, limit: float) -> Column:
    """The probability that a share with the posterior Beta(mean n, (1 - mean) n) is over the limit."""
    a, b, x = mean * n, (1 - mean) * n, F.lit(float(limit))
    # Of the logarithm, what grows with n is written by shares, where it loses no places
    log = -a * F.log(mean / limit) - b * F.log((1 - mean) / (1 - limit)) + 0.5 * F.log(n * mean * (1 - mean) / (2 * math.pi)) + _beyond_stirling(n) - _beyond_stirling(a) - _beyond_stirling(b)
    low = limit < (a + 1) / (n + 2)  # where the fraction converges fast; else it is that of the other side
    exact = F.when(low, 1 - F.exp(log) * _fraction(a, b, x) / a).otherwise(F.exp(log) * _fraction(b, a, 1 - x) / b)
    return F.when(a < 1e-9, 0.0).when(b < 1e-9, 1.0).otherwise(exact)


def reputation(outcomes: DataFrame, max_bad: float = MAX_BAD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """suffix, domain, host, n, bad, posterior mean, and probability of a bad share over max_bad for each host of outcomes (host, n, bad: labelled pages and bad ones among them)."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select("n", "bad", *[c.alias(k) for k, c in _names(F.col("host"), suffixes).items()])
    hosts = stored(hosts, "hosts")
    share = lambda n, bad, prior, strength: (bad + prior * strength) / (n + strength)

    def strength(children: DataFrame, of: list[str], prior: str) -> DataFrame:
        """Method of moments: how many pages the parent's share counts for, from the spread of the children's shares beyond that of binomial draws."""
        p = F.col(prior)
        spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)) / F.sum("n")
        drawn = F.first(p * (1 - p)) * F.sum(F.when(F.col("n") > 0, F.lit(1.0))) / F.sum("n")
        rho = F.try_divide(spread - drawn, F.first(p * (1 - p)) - drawn)
        moments = F.when((F.sum(F.when(F.col("n") > 0, 1)) > 1) & (F.first(p * (1 - p)) > drawn) & (rho > 0), F.least(F.greatest((1 - rho) / rho, F.lit(1.0)), F.lit(1e4)))
        return children.groupBy(*of).agg(F.coalesce(moments, F.lit(STRENGTH)).alias("strength"))

    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()  # two numbers
    top = (total.bad or 0) / total.n if total.n else 0.0
    level = None
    for k, name in enumerate(LEVELS):
        of = list(LEVELS[: k + 1])
        sums = hosts.groupBy(*of).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if level is None:
            rows = sums.withColumn("prior", F.lit(top))
            spread = strength(rows.filter("n > 0").withColumn("_all", F.lit(0)), ["_all"], "prior")
            rows = rows.join(F.broadcast(spread.drop("_all")), how="left")  # one row
        else:
            rows = sums.join(level.select(*of[:-1], F.col("mean").alias("prior")), of[:-1])
            rows = rows.join(strength(rows.filter("n > 0"), of[:-1], "prior"), of[:-1], "left")
        s = F.coalesce("strength", F.lit(STRENGTH))
        level = rows.select(*of, "n", "bad", "prior", s.alias("strength"), share(F.col("n"), F.col("bad"), F.col("prior"), s).alias("mean"))
        level = stored(level, f"reputation-{name}")
    return level.withColumn("over", probability_over(F.col("mean"), F.col("n") + F.col("strength"), max_bad))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, sure: float = SURE, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_share, bad_probability. labels: page_id, bad (0 or 1, null for none), a row for each labelled page.

    Hosts with a third of all pages are summed before they are shuffled; the pages join a row for each host, broadcast only if its files are small.
    """
    split = parts(F.col("url"))
    rows = pages.select("page_id", *[c.alias(k) for k, c in split.items()])
    known = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = rows.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stored(reputation(outcomes, max_bad, suffixes).select("host", F.col("mean").alias("bad_share"), F.col("over").alias("bad_probability")), "judged")
    fit, verdict = rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_probability") >= sure, "block").otherwise("allow")
    return rows.join(hosts, "host", "left").select("page_id", "host", "path", fit.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bad_share", 6).alias("bad_share"), F.round("bad_probability", 6).alias("bad_probability"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: a page is labelled through the document that its url's path ends in (its number); a document of quality 0, or a toxic one, is a bad page."""
    number = F.regexp_extract(parts(F.col("url"))["path"], r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    of = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select("page_id", number.try_cast("long").alias("doc_id")).join(of, "doc_id").select("page_id", "bad")


def _level_sql(name: str, above: str, of: str, group: str) -> str:
    """SQL of one level: sums, the parent's mean as the prior, the prior's strength by moments, and the shrunken mean. above: the parent's rows; group: what names a parent."""
    keys = ", ".join(x for x in (group, of) if x)
    by = f"GROUP BY {group}" if group else ""
    on = f"USING ({group})" if group else "ON true"
    return f"""
{name}_p AS (SELECT s.*, a.mean AS prior FROM (SELECT {keys}, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY {keys}) s JOIN {above} a {on}),
{name}_m AS (SELECT {group + ", " if group else ""}count(*) AS k, any_value(prior * (1 - prior)) AS v, sum(n * pow(bad / n - prior, 2)) / sum(n) AS spread, any_value(prior * (1 - prior)) * count(*)::DOUBLE / sum(n) AS drawn FROM {name}_p WHERE n > 0 {by}),
{name}_s AS (SELECT *, CASE WHEN k > 1 AND v > drawn AND (spread - drawn) / (v - drawn) > 0 THEN least(greatest((1 - (spread - drawn) / (v - drawn)) / ((spread - drawn) / (v - drawn)), 1.0), 1e4) ELSE {STRENGTH} END AS strength FROM {name}_m),
{name} AS (SELECT {keys}, n, bad, coalesce(strength, {STRENGTH})::DOUBLE AS strength, (bad + prior * coalesce(strength, {STRENGTH})::DOUBLE) / (n + coalesce(strength, {STRENGTH})::DOUBLE) AS mean FROM {name}_p LEFT JOIN {name}_s {on})"""


def _rule_sql(value: str) -> str:
    """CASE over the rules, the longest first."""
    cases = []
    for verdict, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        of, slash, start = text.partition("/")
        cases.append(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash + start}') THEN '{text if value == 'rule' else verdict}'")
    return f"CASE {' '.join(cases)} END"


_LISTED = ", ".join(f"'{x}'" for x in SUFFIXES)
_LAST = "array_to_string(list_slice(string_split(host, '.'), -{0}, -1), '.')"
ORACLE_SQL = f"""
WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) END AS rest FROM pages),
rows AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
outcomes AS (SELECT page_id, host, bad FROM rows LEFT JOIN known ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})([.][a-z]+)?/?$', 1) AS BIGINT)),
hosts AS (
  SELECT host, CASE WHEN {_LAST.format(2)} IN ({_LISTED}) THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END AS suffix,
    CASE WHEN {_LAST.format(2)} IN ({_LISTED}) THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END AS domain, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM outcomes GROUP BY host),
top AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0)::DOUBLE AS mean FROM hosts),
{_level_sql("suffixes", "top", "suffix", "")},
{_level_sql("domains", "suffixes", "domain", "suffix")},
{_level_sql("judged", "domains", "host", "suffix, domain")},
posterior AS (SELECT host, mean, n + strength AS m, mean * (n + strength) AS a, (1 - mean) * (n + strength) AS b FROM judged),
sides AS (SELECT *, {MAX_BAD} < (a + 1) / (m + 2) AS low FROM posterior),
given AS (SELECT host, CASE WHEN low THEN a ELSE b END AS a, CASE WHEN low THEN b ELSE a END AS b, CASE WHEN low THEN {MAX_BAD}::DOUBLE ELSE 1 - {MAX_BAD}::DOUBLE END AS x, {STEPS} + {MORE} * ceil(sqrt(m)) AS most FROM sides WHERE a >= 1e-9 AND b >= 1e-9),
lentz AS (
  SELECT host, a, b, x, most, 0::DOUBLE AS k, 1::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM given
  UNION ALL
  SELECT host, a, b, x, most, k + 1, 1 + t2 / c1, 1 / (1 + t2 * d1), h * d1 * c1 * (1 / (1 + t2 * d1)) * (1 + t2 / c1)
  FROM (SELECT *, 1 / (1 + t1 * d) AS d1, 1 + t1 / c AS c1 FROM (
    SELECT *, (k + 1) * (b - k - 1) * x / ((a + 1 + 2 * k) * (a + 2 + 2 * k)) AS t1, -(a + k + 1) * (a + b + k + 1) * x / ((a + 2 + 2 * k) * (a + 3 + 2 * k)) AS t2 FROM lentz WHERE k < most))),
fractions AS (SELECT host, h FROM lentz WHERE k = most),
bound AS (
  SELECT host, mean, CASE WHEN a < 1e-9 THEN 0.0 WHEN b < 1e-9 THEN 1.0
    WHEN low THEN 1 - exp(lgamma(m) - lgamma(a) - lgamma(b) + a * ln({MAX_BAD}::DOUBLE) + b * ln(1 - {MAX_BAD}::DOUBLE)) * h / a
    ELSE exp(lgamma(m) - lgamma(a) - lgamma(b) + a * ln({MAX_BAD}::DOUBLE) + b * ln(1 - {MAX_BAD}::DOUBLE)) * h / b END AS over FROM sides LEFT JOIN fractions USING (host))
SELECT page_id, host, path, {_rule_sql("rule")} AS rule, coalesce({_rule_sql("verdict")}, CASE WHEN over >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_share, round(over, 6)::DOUBLE AS bad_probability
FROM rows LEFT JOIN bound USING (host)
"""
