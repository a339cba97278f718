"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

Each tree gives a vector a long string of bits, the signs of random projections, and holds the strings in a sorted array. A query descends each tree to its longest
prefix matches: the vectors that share the first d bits with it are a range of the array. All trees then ascend together, a bit at a time, until the ranges hold
enough candidates; those are compared exactly. Prefixes have no fixed length and ranges no cap, so equal or almost equal vectors all come along.

Spark deals the vectors to shards of bounded size; a task builds a shard's forest once, and all queries come to it sorted behind the vectors, a block at a time, so that it holds one forest and
one block, however many queries there are, and nothing depends on how vectors crowd.

Defined results: vectors that are null, zero, or that hold null or non-finite components take no part, nor do null ids. A query has neighbours among the vectors of its own length. It is never its own
neighbour; rows of one id are one candidate, with the best of their scores. Ties go to the smaller id. Without candidates a query has no rows; an empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import holding, stored, tidy

TREES, BITS = 128, 32
SHARE = 0.3  # of a shard's vectors that are candidates at least
LEAST = 64  # candidates at least, in a shard
SHARD, BLOCK = 4096, 1024
MOST_TASKS = 50_000  # with more shards, tasks take several, one after the other


@functools.lru_cache(maxsize=2)
def _planes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((dim, trees * bits))


holding("neighbours", _planes.cache_clear)


class Forest:
    """Sorted arrays of the bit strings of some vectors, one for each tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.bits, self.trees = bits, trees
        strings = self.strings(x)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """trees x vectors: the signs as integers, first projection in the highest bit."""
        signs = (x @ _planes(x.shape[1], self.trees, self.bits) > 0).reshape(len(x), self.trees, self.bits)
        return (signs @ (np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T.copy()

    def candidates(self, queries: np.ndarray, least: int, names: np.ndarray | None = None):
        """For each query, the places of its candidates: all vectors that share its first d bits in some tree, for the largest d that gives at least so many, trees counted apart.
        names: numbers of the vectors from 0; those with one number count as one."""
        count = np.count_nonzero if names is None else lambda met: np.count_nonzero(np.bincount(names[met]))
        strings = self.strings(queries)
        lo = np.zeros((self.bits + 1, self.trees, len(queries)), np.int64)
        hi = np.full_like(lo, self.sorted.shape[1])
        for d in range(1, self.bits + 1):
            low = strings >> (self.bits - d) << (self.bits - d)
            for t in range(self.trees):
                lo[d, t] = np.searchsorted(self.sorted[t], low[t], "left")
                hi[d, t] = np.searchsorted(self.sorted[t], low[t] + (1 << (self.bits - d)), "left")
        depth = np.full(len(queries), self.bits)
        met = np.zeros(self.sorted.shape[1], bool)
        for q in range(len(queries)):
            met[:] = False
            d = int(depth[q])
            sizes = (hi[:, :, q] - lo[:, :, q]).sum(axis=1)
            d = int(np.flatnonzero(sizes >= least)[-1]) if (sizes >= least).any() else 0
            while True:
                for t in range(self.trees):
                    met[self.order[t, lo[d, t, q] : hi[d, t, q]]] = True
                if d == 0 or count(met) >= least:
                    break
                d -= 1
            yield np.flatnonzero(met)


class Shard:
    """Vectors with their forest, which is built once for all blocks of queries. Where at least as many candidates are wanted as there are vectors, all are compared."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, share: float):
        self.ids, self.x, self.k = ids, x, k
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.unit = x / self.norms[:, None]
        names, self.name = np.unique(ids, return_inverse=True)
        self.n = len(names)
        self.least = max(LEAST, k + 1, int(share * self.n))  # the query itself may be among them
        self.forest = Forest(self.unit) if self.n > self.least else None

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray) -> pd.DataFrame:
        """query_id, vec_id, score of the k best candidates of each query."""
        ids, repeats = self.ids, self.n < len(self.ids)
        if self.forest is None:
            every = itertools.repeat(np.arange(len(ids)), len(queries))
        else:
            every = self.forest.candidates(queries / np.sqrt((queries * queries).sum(axis=1))[:, None], self.least, self.name if repeats else None)
        out = []
        for q, own, found in zip(queries, query_ids, every, strict=True):
            found = found[ids[found] != own]
            if not len(found):
                continue
            rough = self.unit[found] @ q
            of = rough
            if repeats:  # the best row of each id
                of = np.full(self.n, -np.inf)
                np.maximum.at(of, self.name[found], rough)
                of = of[of > -np.inf]
            if len(of) > self.k:  # near ties stay until the exact scores are known
                found = found[rough >= np.partition(of, -self.k)[-self.k] - 1e-9 * np.abs(rough).max()]
            score = (self.x[found] * q).sum(axis=1) / (self.norms[found] * np.sqrt((q * q).sum()))
            best = {}
            for i, s in zip(ids[found].tolist(), score.tolist(), strict=True):
                best[i] = max(s, best.get(i, s))
            out += [(own, i, s) for i, s in sorted(best.items(), key=lambda r: (-r[1], r[0]))[: self.k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> pd.DataFrame:
    """query_id, vec_id, score of the k best candidates of each query among some vectors."""
    return Shard(ids, x, k, share).nearest(query_ids, queries)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part; v holds doubles."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(finite & F.exists("v", lambda c: c != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries among vectors; both have vec_id and embedding."""
    held = stored(usable(vectors), "vectors")
    n = held.count()
    asked = stored(usable(queries).distinct(), "queries")
    shards = max(1, -(-n // shard))
    row = lambda df, own, of: df.select(own.alias("shard"), F.size("v").alias("dim"), F.lit(of).alias("asked"), "vec_id", "v")
    index = row(held, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), False)
    given = row(asked, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy("neighbours")
        at, vectors, built = None, [], None
        for batch in batches:
            for (own, dim, asks), part in batch.groupby(["shard", "dim", "asked"]):
                ids, x = part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy())
                if at != (own, dim):
                    at, vectors, built = (own, dim), [], None
                if not asks:
                    vectors.append((ids, x))
                elif vectors:
                    built = built or Shard(np.concatenate([i for i, _ in vectors]), np.concatenate([v for _, v in vectors]), k, share)
                    for lo in range(0, len(ids), block):
                        yield built.nearest(ids[lo : lo + block], x[lo : lo + block])

    # A shard's vectors come first, then all queries, block by block: a task holds one forest and one block
    dealt = index.unionByName(given).repartitionById(min(shards, MOST_TASKS), F.col("shard")).sortWithinPartitions("shard", "dim", "asked", "vec_id")
    found = dealt.mapInPandas(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
