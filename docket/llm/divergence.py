"""Source divergence audit: how far the term shares of a language's sources lie apart, from hash-consed segment trees.

The terms of a language that enough of its documents hold are dealt to shards of some hundred; a term's id is its shard and its place there. In a shard, each source is a segment tree over the places, with counts
as leaves. Nodes are hash-consed: a subtree of the same counts is the same node, whichever source or place it stands at, so sources that share nothing but absent terms share most nodes.
Two trees are priced by walking both at once from their roots, level by level; a pair of nodes that comes up again is not walked again, so that each pair of equal nodes is priced once. Prices of
shards are summed by pairs of sources. Sources are dealt to blocks, and a task holds one shard of two blocks, so nothing but the answer grows with the square of the sources.

The price of a term between shares p and q in thousand millionths is floor((p - q)^2 / (p + q)), p = 1 + floor(10^9 (count + 2) / (N + 2 V)); all arithmetic is exact.

Defined results: null texts, languages and sources are empty strings. Each row counts as a document. A group without terms has counts of zero. A language without kept terms has pairs of value 0
and no terms; one with a single source has no pairs. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import prepare, stored, tidy

HELD = 10  # documents of a language that must hold a term
TOP = 10  # terms that are listed of a group
SHARD = 1024  # terms of a shard
BLOCK = 32  # sources of a block
SCALE = 1_000_000_000
#: What each byte of a text is to terms: letters of any kind stay, A-Z lower-cased, and all else parts them.
TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
KNOWN = 300_000  # terms and groups that a task counts before it sends them on
SENT = 50_000  # rows of a batch that is sent
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANG = 0  # stands for the language as a whole among the numbers of groups in a task


def share(count: int, total: int, terms: int) -> int:
    """The smoothed share of a term in thousand millionths."""
    return 1 + SCALE * (count + 2) // (total + 2 * terms)


class Trees:
    """Segment trees of one shard, level by level from the leaves; counts: a row for each group and a column for each place. Places beyond the shard's terms hold -1 and cost nothing."""

    def __init__(self, counts: np.ndarray):
        groups, places = counts.shape
        width = 1 << max(0, places - 1).bit_length()
        padded = np.full((groups, width), -1, np.int64)
        padded[:, :places] = counts
        self.leaves, at = np.unique(padded, return_inverse=True)
        at = at.reshape(padded.shape).astype(np.int64)
        #: For each level above the leaves, the children of each node: equal pairs of children are one node.
        self.children: list[np.ndarray] = []
        while at.shape[1] > 1:
            known = int(at.max()) + 1
            names, at = np.unique(at[:, ::2] * known + at[:, 1::2], return_inverse=True)
            at = at.reshape(groups, -1)
            self.children.append(np.stack([names // known, names % known], axis=1))
        self.roots = at[:, 0]

    def walk(self, one: np.ndarray, other: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
        """The price of each pair of groups. A pair of nodes is priced once for each pair of groups, as shares depend on their totals."""
        pair, left, right = np.arange(len(one)), self.roots[one], self.roots[other]
        ways = []
        for children in reversed(self.children):
            a, b = children[left], children[right]
            size = int(max(a.max(initial=0), b.max(initial=0))) + 1
            met = np.stack([np.repeat(pair, 2), a.ravel(), b.ravel()])
            # Nodes of a pair whose numbers don't fit one key are told apart by two
            name = (met[0] * size + met[1]) if len(one) * size < 1 << 31 else np.unique(met[0] * size + met[1], return_inverse=True)[1]
            _, first, way = np.unique(name * size + met[2], return_index=True, return_inverse=True)
            ways.append(way.reshape(-1, 2))
            pair, left, right = met[:, first]
        p, q = (self.shares(x, group[pair], totals, terms) for x, group in ((left, one), (right, other)))
        price = np.where((p < 0) | (q < 0), 0, (p - q) ** 2 // np.maximum(p + q, 1))
        for way in reversed(ways):
            price = price[way].sum(axis=1)
        return price

    def shares(self, leaf: np.ndarray, group: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
        """The share that each leaf stands for in its group; -1 where there is no term."""
        name, way = np.unique(leaf * len(totals) + group, return_inverse=True)
        counts, of = self.leaves[name // len(totals)].tolist(), totals[name % len(totals)].tolist()
        return np.array([-1 if c < 0 else share(c, n, terms) for c, n in zip(counts, of, strict=True)], np.int64)[way]


def priced(frame: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """The pairs of one task with their prices, and the best terms of each of its groups where it holds one block. frame: a row (idx -1, n: the group's total) for each group, and its counts."""
    lang, shard, one, other, terms, places = frame[["lang", "shard", "one", "other", "terms", "places"]].iloc[0]
    heads = frame[frame["idx"] < 0].sort_values("number").reset_index(drop=True)
    row = pd.Series(heads.index, index=heads["number"])
    counts = np.zeros((len(heads), int(places)), np.int64)
    held = frame[frame["idx"] >= 0]
    counts[row.loc[held["number"]].to_numpy(), held["idx"].to_numpy()] = held["n"].to_numpy()
    totals, source, number, block = heads["n"].to_numpy(), heads["source"].to_numpy(), heads["number"].to_numpy(), heads["block"].to_numpy()
    group = np.flatnonzero(number != LANG)
    a, b = (x.ravel() for x in np.meshgrid(group, group, indexing="ij"))
    # Of two blocks, pairs across them; of one, each pair once: the price is symmetric
    wanted = a < b if one == other else (block[a] == one) & (block[b] == other)
    a, b = a[wanted], b[wanted]
    trees = Trees(counts)
    price = trees.walk(a, b, totals, int(terms)) if int(places) and len(a) else np.zeros(len(a), np.int64)
    both = [{"source": source[x], "other": source[y], "idx": -1, "value": price} for x, y in ((a, b), (b, a))]
    whole = np.flatnonzero(number == LANG)
    if one == other and int(places) and len(whole):
        best = []
        for g in group:
            at = np.flatnonzero(counts[g] > 0)
            p = trees.shares(np.searchsorted(trees.leaves, counts[g, at]), np.full(len(at), g), totals, int(terms))
            q = trees.shares(np.searchsorted(trees.leaves, counts[whole[0], at]), np.full(len(at), whole[0]), totals, int(terms))
            more = p > q
            at, f = at[more], (p[more] - q[more]) ** 2 // (p[more] + q[more])
            first = np.lexsort((at, -f))[:top]
            best.append({"source": np.full(len(first), source[g], object), "other": np.full(len(first), "", object), "idx": at[first], "value": f[first]})
        both += best
    out = pd.concat([pd.DataFrame(x) for x in both], ignore_index=True)
    return out.assign(lang=lang, shard=int(shard))[["lang", "shard", "source", "other", "idx", "value"]]


def _sent(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, held) in counts.items():
        terms = list(n)
        for low in range(0, len(terms), SENT):
            part = terms[low : low + SENT]
            numbers = [pa.array([x[t] for t in part], pa.int64()) for x in (n, held)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), *numbers], names=["lang", "source", "term", "n", "held"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of terms and documents that hold them by group, added up over as many documents as memory is meant for. In UTF-8 all that is no term is a byte of its own."""
    tidy("divergence")
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    known, groups = 0, set()
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            group = (lang.as_py(), source.as_py())
            groups.add(group)
            n, held = counts.setdefault(group, (Counter(), Counter()))
            before = len(n)
            found = text.as_buffer().to_pybytes().translate(TERMS).split()
            n.update(found)
            held.update(set(found))
            known += len(n) - before
            if known >= KNOWN or len(groups) >= KNOWN:
                yield from _sent(counts)
                yield _heads(groups)
                counts, known, groups = {}, 0, set()
    yield from _sent(counts)
    yield _heads(groups)


def _heads(groups: set[tuple[str, str]]) -> pa.RecordBatch:
    none = pa.array([0] * len(groups), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.nulls(len(groups), pa.string()), none, none], names=["lang", "source", "term", "n", "held"])


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, held: occurrences of each term, and the documents that hold it, by group; a row with a null term for each group."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, held long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def diverge(docs: DataFrame, held: int = HELD, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of each group's language by divergence (part "pair"), and the terms that set the group apart from its language (part "term")."""
    prepare(docs.sparkSession)
    counts = stored(counted(docs), "terms")
    some = counts.filter("term is not null")
    kept = some.groupBy("lang", "term").agg(F.sum("held").alias("held"), F.sum("n").alias("all")).filter(F.col("held") >= held).drop("held")
    kept = stored(kept, "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("all"))
    groups = counts.filter("term is null").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(sizes, "lang", "left").na.fill(0, ["terms", "all"])
    up = lambda c, n: F.greatest(F.ceil(F.col(c) / n), F.lit(1)).cast("int")
    langs = stored(langs.select("*", up("terms", shard).alias("shards"), up("sources", block).alias("blocks")), "langs")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    placed = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", deal("term", "shards")).drop("shards")
    placed = stored(placed.withColumn("idx", F.row_number().over(W.partitionBy("lang", "shard").orderBy("term")) - 1), "placed")
    own = stored(some.drop("held").join(placed.drop("all"), ["lang", "term"]).select("lang", "source", "shard", "idx", "n"), "counts")
    totals = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").na.fill(0, ["n"])
    # Each source once for each shard and each block that it meets
    meets = F.inline(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("one"), F.greatest("block", x).alias("other"))))
    known = langs.join(placed.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("places")), "lang", "left").select("lang", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("places", F.lit(0)).alias("places"), "terms", "blocks", "all")
    numbered = F.xxhash64("source").bitwiseOR(F.lit(1))  # tells groups of a task apart; never LANG
    head = F.lit(-1).alias("idx")
    rows = totals.join(known, "lang").select("lang", "shard", "source", head, "n", "terms", "places", "blocks")
    rows = rows.unionByName(own.join(known.drop("all"), ["lang", "shard"]).select(*rows.columns))
    rows = rows.withColumn("block", deal("source", "blocks")).withColumn("number", numbered)
    tasks = rows.select("lang", "shard", "source", "number", "block", "idx", "n", "terms", "places", meets)
    whole = known.select("lang", "shard", head, F.col("all").alias("n"), "terms", "places", "blocks").unionByName(placed.select("lang", "shard", "idx", F.col("all").alias("n")).join(known.drop("all"), ["lang", "shard"]))
    whole = whole.withColumn("one", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other", F.col("one"))
    whole = whole.withColumns({"source": F.lit(""), "number": F.lit(LANG).cast("long"), "block": F.col("one")}).drop("blocks")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tidy("divergence")
        return priced(frame, top)

    found = tasks.unionByName(whole).groupBy("lang", "shard", "one", "other").applyInPandas(run, "lang string, shard int, source string, other string, idx int, value long")
    found = stored(found, "prices")
    pairs = found.filter("idx < 0").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = found.filter("idx >= 0").join(placed.select("lang", "shard", "idx", F.col("term").alias("item")), ["lang", "shard", "idx"]).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value")
    out = pairs.select(*columns).unionByName(terms.select(*columns))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= top))


_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{_TERMS}')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {HELD}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.n + 2 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q FROM k JOIN v USING (lang)),
o AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT o.lang, o.source, 'pair' AS part, o.item, coalesce(f.value, 0)::BIGINT AS value FROM o LEFT JOIN f USING (lang, source, item)
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM x
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}
"""
