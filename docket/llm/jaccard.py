"""Similarity join of documents by the Jaccard likeness of their five-word shingles, on count vectors in an R-tree.

Shingles are hashed into groups, and a document is the point of its counts by group. Two documents share at most the sum of the coordinate minima, and a box of points
and a document at most the sum of the minima with the box's upper corner; what this bound rules out is never compared. What it leaves is verified on the whole shingle sets.

One tree over all points can't cut the work: unrelated texts of like length have almost the same counts, so boxes of them overlap nearly everywhere (README). The
documents are therefore first dealt to tiles by banded minima of their shingles' hashes, so that a pair with a likeness of 0.8 misses all tiles with a probability of about
4e-12, and each tile has trees of its own. Equal sets meet first and go on as one; in a tile, each document is compared with the smallest id, and then only documents which no
chain of links joins yet. So copies are never expanded into pairs.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text of fewer than five words has its whole sequence as its one shingle; a null, empty or blank text has
none, links with nothing and is a component of its own. Repeated rows with one id are one document's rows if their texts are equal; of unequal texts with one id, each row
gets its own set, and the id is the name of both. A null id is kept, joins nothing and has a null component. An empty table gives an empty result.
Shingles are compared by 64-bit hashes. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.sources.tables import shared_folder

from .common import discard, stored, tidy

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
GROUPS = 128  # coordinates of a point
ROWS, BANDS = 4, 50  # minima of a band; bands
LEAF = 16  # points of a tree's leaf, and boxes of an inner node
BLOCK = 2048  # documents of a tile that meet in one task

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _BASE))])
    return _POWERS[:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte string, and the places where they start."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # Each byte is spread and weighted by a power of its place in the word
    size = ends - starts
    inside = ~blank
    word = np.cumsum(edge[:-1] == -1) - 1
    at = np.flatnonzero(inside)
    place = at - starts[word[at]]
    with np.errstate(over="ignore"):
        value = _SPREAD[raw[at]] * _powers(int(size.max()))[place]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        return _mixed(np.add.reduceat(value, first) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), starts


_SPREAD = _mixed(np.arange(1, 257, dtype=np.uint64))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one after the other, and the borders between texts."""
    parts = [t.encode() for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    hashes, starts = word_hashes(np.frombuffer(b" ".join([*parts, b""]), np.uint8)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    doc = np.searchsorted(ends, starts, "right")
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        # The last words of a text have no full shingle; a short text's first word stands for the whole sequence
        full = np.zeros(len(hashes), np.uint64)
        for k in range(SHINGLE):
            there = np.flatnonzero(doc[: max(0, len(doc) - k)] == doc[k:]) if k else np.arange(len(doc))
            full[there] = _mixed(full[there] * _BASE + hashes[there + k]) if k else hashes
        place = np.arange(len(hashes)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else [], n).astype(np.int64)
        left = np.repeat(n, n) - place
    keep = (left >= SHINGLE) | (place == 0)
    doc, full = doc[keep], full[keep]
    order = np.lexsort((full, doc))
    doc, full = doc[order], full[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (full[1:] != full[:-1])
    doc, full = doc[new], full[new]
    return full, np.searchsorted(doc, np.arange(len(texts) + 1))


_RNG = np.random.default_rng(7)
_SEEDS = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_FACTORS = _RNG.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)


def _batches(frames: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Frames cut so that about most characters are looked at together."""
    for b in frames:
        sizes = b["text"].str.len().fillna(0).to_numpy()
        part = (np.cumsum(sizes) // most).astype(int)
        for k in np.unique(part):
            yield b[part == k]


def points(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a name of the set), bands (a key of each band; none for empty sets), counts (the point)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in _batches(frames):
            full, cuts = shingle_sets([t or "" for t in b["text"]])
            n = np.diff(cuts)
            some = np.flatnonzero(n)
            out = pd.DataFrame({"doc_id": pd.array(b["doc_id"], "Int64"), "n_shingles": n})
            bands, counts = np.empty(len(b), object), np.empty(len(b), object)
            s1, s2 = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
            for i in range(len(b)):
                bands[i], counts[i] = np.zeros(0, np.int64), np.zeros(0, np.int32)
            if len(some):
                at = cuts[some]
                with np.errstate(over="ignore"):
                    s1[some] = np.add.reduceat(_mixed(full), at)
                    s2[some] = np.add.reduceat(_mixed(full ^ np.uint64(0x5851F42D4C957F2D)), at)
                    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(some), 1))
                    for f in range(ROWS * BANDS):
                        low = np.minimum.reduceat((full ^ _SEEDS[f]) * _FACTORS[f], at)
                        key[:, f // ROWS] = _mixed(key[:, f // ROWS] * _BASE + low)
                group = (full >> np.uint64(57)).astype(np.int64)
                point = np.bincount(np.repeat(np.arange(len(some)), n[some]) * GROUPS + group, minlength=len(some) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
                for row, i in enumerate(some):
                    bands[i], counts[i] = key[row].view(np.int64), point[row]
            out["s1"], out["s2"], out["bands"], out["counts"] = s1.view(np.int64), s2.view(np.int64), bands, counts
            yield out
        tidy()

    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, counts array<int>"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _least_overlap(a, b):
    """The overlap that sets of these sizes need."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


class Tree:
    """An R-tree over points of counts, loaded at once: points in the order of their sizes and first coordinates fill leaves, leaves fill nodes, up to one root."""

    def __init__(self, points: np.ndarray):
        size = points.sum(axis=1)
        self.order = np.lexsort((points[:, 0], size))
        self.levels = [(points[self.order], size[self.order], size[self.order])]  # upper corner, smallest and largest size
        while len(self.levels[-1][0]) > 1:
            upper, lo, hi = self.levels[-1]
            cuts = np.arange(0, len(upper), LEAF)
            self.levels.append((np.maximum.reduceat(upper, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)))

    def near(self, asked: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Rows of asked and of the tree's points between which the bound leaves a link possible."""
        size = asked.sum(axis=1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for first in range(0, len(asked), 256):
            q = np.arange(first, min(first + 256, len(asked)))
            node = np.zeros(len(q), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                upper, lo, hi = self.levels[depth]
                if depth < len(self.levels) - 1:  # from the boxes that were left to what is in them
                    q, node = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                    q, node = q[node < len(upper)], node[node < len(upper)]
                keep = []
                for i in range(0, len(q), step):
                    a, b = q[i : i + step], node[i : i + step]
                    most = np.minimum(asked[a], upper[b]).sum(axis=1)
                    keep.append((most >= _least_overlap(size[a], lo[b])) & (hi[b] * DENOMINATOR >= size[a] * NUMERATOR) & (size[a] * DENOMINATOR >= lo[b] * NUMERATOR))
                keep = np.concatenate(keep) if keep else np.zeros(0, bool)
                q, node = q[keep], node[keep]
            found.append((q, self.order[node]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tile_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs a < b of documents that share a tile, or a block pair of it, belong to different components and may link by the bound. Rows come sorted by tile; a pair that shares
    more tiles comes out of the first alone."""

    def pairs(tile: pd.DataFrame) -> pd.DataFrame:
        doc, part = tile["doc_id"].to_numpy(), tile["component"].to_numpy()
        points = np.stack(tile["counts"].to_numpy())
        x, y = Tree(points).near(points)
        keep = (doc[x] < doc[y]) & (part[x] != part[y])
        x, y = x[keep], y[keep]
        bands = np.stack(tile["bands"].to_numpy())
        band = int(np.flatnonzero(bands[0] == tile["key"].iloc[0])[0])
        block, i, j = tile["m"].to_numpy(), tile["i"].iloc[0], tile["j"].iloc[0]
        keep = ~(bands[x, :band] == bands[y, :band]).any(axis=1) & (doc[x] != tile["leader"].iloc[0]) & ((i == j) | (block[x] != block[y]))
        return pd.DataFrame({"a": doc[x[keep]], "b": doc[y[keep]]}).drop_duplicates()

    tidy()
    held, out, rows = None, [], 0
    for b in frames:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        new = np.flatnonzero((b[["key", "i", "j"]].to_numpy()[1:] != b[["key", "i", "j"]].to_numpy()[:-1]).any(axis=1)) + 1
        cuts = [0, *new.tolist()]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            out.append(pairs(b.iloc[lo:hi]))
            rows += len(out[-1])
            if rows > 50_000:
                yield pd.concat(out, ignore_index=True)
                out, rows = [], 0
        held = b.iloc[cuts[-1] :]
    if held is not None and len(held):
        out.append(pairs(held))
    if out:
        yield pd.concat(out, ignore_index=True)
    tidy()


def components(edges: DataFrame, within: str | None = None) -> DataFrame:
    """id, component (the smallest id that edges lead to) of every end of edges a, b. Each round points every id at its smallest neighbour, follows the pointers to
    their ends, and goes on with the edges between different ends; each round's tables are stored (in the folder within)."""
    rest = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges", within)
    total = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to")), "pointers", within)
        while True:
            ahead = to.select(F.col("id").alias("to"), F.col("to").alias("then"))
            far = stored(to.join(ahead, "to").select("id", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")), "pointers", within)
            to, moved = far.select("id", "to"), not far.filter("moved").isEmpty()
            if not moved:
                break
        of = lambda c: to.select(F.col("id").alias(c), F.col("to").alias(f"_{c}"))
        rest = stored(rest.join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct(), "edges", within)
        if total is None:
            total = to
        else:
            total = stored(total.join(to.select(F.col("id").alias("to"), F.col("to").alias("then")), "to", "left").select("id", F.coalesce("then", "to").alias("to")), "pointers", within)
    if total is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return total.select("id", F.col("to").alias("component"))


def _sets(docs: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in _batches(frames):
            full, cuts = shingle_sets([t or "" for t in b["text"]])
            yield pd.DataFrame({"id": b["doc_id"].to_numpy(), "set": [full[x:y].view(np.int64) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]})

    return docs.select("doc_id", "text").mapInPandas(run, "id long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose whole sets are alike enough."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared, sizes = F.size(F.array_intersect("_a", "_b")), F.size("_a") + F.size("_b")
    return both.filter(DENOMINATOR * shared >= NUMERATOR * (sizes - shared)).select("a", "b").distinct()


@dataclass
class _Join:
    """The stored tables of one join, all in one folder."""

    where: str
    known: DataFrame  # every row: doc_id, n_shingles, s1, s2
    named: DataFrame  # s1, s2, rep of each distinct set
    tiles: DataFrame  # key, doc_id, leader, n: representatives of tiles with more than one
    counted: DataFrame  # doc_id, counts, bands of those
    sets: DataFrame  # id, set of those
    met: DataFrame  # a, b: pairs of a tile's smallest id and another one
    links: DataFrame  # a, b: those of them that link

    def grid(self, marked: DataFrame) -> DataFrame:
        """Links that the trees of the tiles find between documents of different components. marked: the tiles with a component for each row."""
        split = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        blocks = F.ceil(F.col("n") / BLOCK)
        mine = F.pmod(F.xxhash64("doc_id"), blocks)
        rest = marked.join(split, "key", "left_semi").join(self.counted, "doc_id").select("key", "doc_id", "leader", "component", "counts", "bands", mine.alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_o"))
        rest = rest.select("key", F.least("m", "_o").alias("i"), F.greatest("m", "_o").alias("j"), "m", "leader", "doc_id", "component", "counts", "bands")
        more = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_tile_pairs, "a long, b long").distinct()
        more = stored(more.join(self.met.select("a", "b"), ["a", "b"], "left_anti"), "pairs", self.where)
        return stored(verified(more, self.sets), "links", self.where)


def _joined(docs: DataFrame) -> _Join:
    """Copies collapsed, tiles dealt, and each tile's documents compared with its smallest id."""
    where = shared_folder(docs.sparkSession, "jaccard")
    known = stored(points(docs), "points", where)
    some = known.filter("n_shingles > 0 and doc_id is not null")
    named = stored(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "sets", where)
    # One document for each distinct set goes on
    reps = some.join(named.select("s1", "s2", F.col("rep").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    # A tile with a large share of the rows is summed before it is shuffled, and Spark may split it in the join
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    tiles = stored(keyed.join(shared, "key").select("key", "doc_id", "leader", "n"), "tiles", where)
    met = stored(tiles.select("doc_id").distinct(), "met", where)
    counted = stored(reps.join(met, "doc_id", "left_semi").select("doc_id", "counts", "bands"), "counts", where)
    sets = stored(_sets(docs.select("doc_id", "text").join(met, "doc_id", "left_semi")), "shingles", where)

    of = lambda c: counted.select(F.col("doc_id").alias(c), F.col("counts").alias(f"_{c}"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    first = tiles.filter("doc_id > leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    bound = total(F.zip_with("_a", "_b", lambda x, y: F.least(x, y))) * (NUMERATOR + DENOMINATOR) >= (total(F.col("_a")) + total(F.col("_b"))) * NUMERATOR
    first = stored(first.join(of("a"), "a").join(of("b"), "b").withColumn("may", bound).select("a", "b", "may"), "pairs", where)
    links = stored(verified(first.filter("may").select("a", "b"), sets), "links", where)
    return _Join(where, known.select("doc_id", "n_shingles", "s1", "s2"), named, tiles, counted, sets, first, links)


def _named(join: _Join, of: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the columns that of has for rep, for each row."""
    names = [c for c in of.columns if c != "rep"]
    out = join.known.join(join.named.join(of, "rep", "left"), ["s1", "s2"], "left")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", *[F.when(own, F.coalesce(c, "rep")).otherwise(F.col("doc_id")).alias(c) for c in names])


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    join = _joined(docs)
    grouped = components(join.links, join.where)
    marked = join.tiles.join(grouped.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "leader", "n", F.coalesce("component", "doc_id").alias("component"))
    links = join.links.unionByName(join.grid(marked))
    out = stored(_named(join, components(links, join.where).select(F.col("id").alias("rep"), F.col("component").alias("component_id"))), "components")
    discard(docs.sparkSession, join.where)
    return out


def similarity_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links a < b between the smallest ids of different sets, and doc_id, n_shingles, class_id (the smallest id with the same set) of each document. Every link is verified, whether
    or not others join its ends; links between equal sets are those of one class and aren't listed."""
    join = _joined(docs)
    links = stored(join.links.unionByName(join.grid(join.tiles.withColumn("component", F.col("doc_id")))).distinct(), "similar")
    members = stored(_named(join, join.named.select("rep", F.col("rep").alias("class_id"))), "classes")
    discard(docs.sparkSession, join.where)
    return links, members
