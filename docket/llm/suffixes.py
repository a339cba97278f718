"""Suffix-array dedup: bytes that an earlier string of the table already holds go, by longest-previous-factor arrays.

A byte goes where it lies in a string of LENGTH bytes that also starts earlier: in a document of a smaller id, or before it in the same one. A suffix array of the whole table can't be held by a task,
so suffixes are first brought together by what they must share. Each string of LENGTH bytes has an anchor, the leftmost of its KMER-byte strings of the least hash, so equal strings have equal anchors; the
strings next to each other that have one anchor in common are handled as one run. Runs are grouped by anchor:

1. Equal runs of an anchor stand next to each other in suffix order with all their strings in common: the first of them in the order of documents is the previous smaller position of the others, which
   therefore go whole. This needs hashes alone. Tasks do it over what they have read before anything is shuffled, so copies hardly travel.
2. The unequal runs of an anchor send their bytes. A block of them is a generalised suffix array: its suffixes are sorted, previous and next smaller positions in that order give the longest previous
   factor of each, and those of LENGTH or more go. Anchors with more runs than a block holds are dealt to many blocks, and the strings that are first in their block are compared across blocks by hashes
   of the whole string.

Anchors that hold a large share of all runs are salted by the run, so no task gets all rows of a common passage. Hashes are of 64 bits, and strings are told apart by two of them.

Defined results: a null text is an empty one. Rows that share id and text are one document and all get its result; of rows that share an id but not the text, that of the smaller text hash comes first. A null id
comes after all others. Bytes of a character may go without its other bytes, so what is kept is binary. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docket.sources.tables import shared_folder

from .common import discard, prepare, stored, tidy

LENGTH, KMER = 100, 32
SLICE = 1 << 16  # positions that are hashed at once: their arrays fit a core's cache
RUNS = 1 << 20  # runs that a task brings together before it sends them on
BLOCK = 2048  # runs of an anchor that are sorted together
SORTED = 1 << 18  # strings that are sorted at once, blocks being whole
SALTS, SHARE, FEW = 256, 4096, 1000
LAST = (1 << 63) - 1  # stands for a null id
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x7FB5D329728EA185)
_RUN = "kind byte, h long, c long, id long, copy long, start int, n int"
CANDIDATE, GONE, COMMON, FIRST = 0, 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(27))


def string_hashes(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, a hash of each string of so many bytes; strings of powers of two are hashed from their halves, others from the powers that make them up."""
    powers, size = {1: _mixed((data.astype(np.uint64) + np.uint64(1)) * _A)}, 1
    while 2 * size <= max(lengths):
        half = powers[size]
        powers[2 * size] = _mixed(half[:-size] * _B + half[size:])
        size *= 2
    out = []
    for length in lengths:
        parts, at, h = [1 << i for i in reversed(range(length.bit_length())) if length >> i & 1], 0, None
        for part in parts:
            own = powers[part][at : len(data) - length + 1 + at]
            h, at = own if h is None else _mixed(h * _B + own), at + part
        out.append(h)
    return out


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many values, where its least one stands, the leftmost of equal ones."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    keep = lambda v, x, step: (np.minimum(v[:-step], v[step:]), np.where(v[step:] < v[:-step], x[step:], x[:-step]))
    while 2 * size <= width:
        values, at = keep(values, at, size)
        size *= 2
    return keep(values, at, width - size)[1] if width > size else at


def runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the run, first string and number of strings of each run of the texts that lie between begin and end in data."""
    inside = np.zeros(len(data) + 1, np.int8)
    long_enough = end - begin >= length
    np.add.at(inside, begin[long_enough], 1)
    np.add.at(inside, end[long_enough] - length + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8)[: max(0, len(data) - length + 1)].astype(bool)
    found = []
    for low in range(0, len(inside), SLICE):
        part = np.flatnonzero(inside[low : low + SLICE])
        if not len(part):
            continue
        short, whole = string_hashes(data[low : low + SLICE + length - 1], (kmer, length))
        anchor = leftmost_least(short, length - kmer + 1)[part]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(part) != 1)]))
        last = np.append(new[1:], len(part)) - 1
        found.append((anchor[new] + np.int64(low), part[new] + low, part[last] + low, whole[part[new]], whole[part[last]], short[anchor[new]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    anchor, first, last, left, right, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # A run that two slices share is one
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (first[1:] != last[:-1] + 1)]))
    end_of = np.append(new[1:], len(anchor)) - 1
    n = last[end_of] - first[new] + 1
    return h[new], _mixed(left[new] * _A + right[end_of]) + n.astype(np.uint64) * _B, first[new], n


def _batch(kind: int, h: np.ndarray, c: np.ndarray, who: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """who: id and copy by column."""
    as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    columns = [pa.array(np.full(len(start), kind, np.int8)), as_long(h.astype(np.uint64)), as_long(c.astype(np.uint64)), as_long(who[:, 0]), as_long(who[:, 1]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "h", "c", "id", "copy", "start", "n"])


def _joined(who: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of one document as one; they are in order."""
    if not len(start):
        return who, start, n
    new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]).any(axis=1) | (start[1:] > start[:-1] + n[:-1])]))
    stop = np.maximum.reduceat(start + n, new)
    return who[new], start[new], stop - start[new]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, and where each begins and the last one ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def combined(h: np.ndarray, c: np.ndarray, who: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of equal runs that a task has met, the first alone is sent on; the strings of the others go already. Anchors of a large share of the runs are named."""
    key = h * _A + c
    order = np.lexsort((start, who[:, 1], who[:, 0], key))
    h, c, who, start, n = h[order], c[order], who[order], start[order], n[order]
    head = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (who != who[first]).any(axis=1) | (start != start[first])
    yield _batch(CANDIDATE, h[head], c[head], who[head], start[head], n[head])
    gone = np.flatnonzero(later)
    gone = gone[np.lexsort((start[gone], who[gone, 1], who[gone, 0]))]
    own, begin, size = _joined(who[gone], start[gone], n[gone])
    none = np.zeros(len(begin), np.uint64)
    yield _batch(GONE, none, none, own, begin, size)
    name, count = np.unique(h[head], return_counts=True)
    common = count >= max(8, len(h) // SHARE)
    none = np.zeros(common.sum(), np.uint64)
    yield _batch(COMMON, name[common], none, np.zeros((len(none), 2), np.int64), np.zeros(len(none), np.int64), count[common])


def find_runs(length: int, kmer: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy("suffixes")
        held, size = [], 0
        for batch in batches:
            data, at = _texts(batch.column("text"))
            h, c, start, n = runs(data, at[:-1], at[1:], length, kmer)
            doc = np.searchsorted(at, start, side="right") - 1
            who = np.stack([batch.column(x).to_numpy() for x in ("id", "copy")], axis=1)[doc]
            held.append((h, c, who, start - at[doc], n))
            size += len(h)
            if size >= RUNS:
                yield from combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from combined(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return find


def _smaller_before(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix of an order, how much it shares with the nearest suffix before it in the order that stands earlier in the text; lcp: with the suffix before it, 0 for the first."""
    at, shared = np.arange(len(position)) - 1, lcp.copy()
    active = np.flatnonzero((shared > 0) & (position[at] >= position))
    while len(active):
        over = at[active]
        shared[active] = np.minimum(shared[active], shared[over])  # what lies between stands later in the text
        at[active] = at[over]
        active = active[(shared[active] > 0) & (position[at[active]] >= position[active])]
    return shared


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, from the suffix order and what each shares with the one before it in that order (0 for the first).
    Of the suffixes that stand earlier in the text, those next to it on either side in suffix order share most with it."""
    before = _smaller_before(order, lcp)
    after = _smaller_before(order[::-1], np.append(lcp[1:], 0)[::-1])[::-1]
    out = np.empty(len(order), lcp.dtype)
    out[order] = np.maximum(before, after)
    return out


def repeated(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether each of the strings that begin at these places, which are in the order of the text, has an earlier equal one of its group."""
    named = np.empty((len(at), 4 + length), np.uint8)
    named[:, :4] = group.astype(">u4")[:, None].view(np.uint8)
    named[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    order = np.argsort(named.view(f"S{4 + length}").ravel(), kind="stable")
    differ = named[order[1:]] != named[order[:-1]]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), 4 + length)
    shared = np.concatenate([[0], np.maximum(lcp - 4, 0)])  # another group's string shares nothing
    return previous_factors(order, shared) >= length


def compare(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of whole blocks, of some SORTED strings or of one block."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, block = batch.column("h").to_numpy(), batch.column("block").to_numpy()
            if held:
                last = held[-1]
                same = int(np.argmin(np.append((h == last.column("h")[-1].as_py()) & (block == last.column("block")[-1].as_py()), False)))
                held.append(batch.slice(0, same))
                size += int(held[-1].column("n").to_numpy().sum())
                if same == batch.num_rows:
                    continue
                if size >= SORTED:
                    yield pa.Table.from_batches([x for x in held if x.num_rows])
                    held, size = [], 0
                batch, h, block = batch.slice(same), h[same:], block[same:]
            cuts = np.flatnonzero((h[1:] != h[:-1]) | (block[1:] != block[:-1])) + 1
            total = np.cumsum(batch.column("n").to_numpy())
            low, done = 0, 0
            for cut in cuts:
                if size + total[cut - 1] - done >= SORTED:
                    yield pa.Table.from_batches([x for x in [*held, batch.slice(low, cut - low)] if x.num_rows])
                    held, size, low, done = [], 0, cut, total[cut - 1]
            held.append(batch.slice(low))
            size += int(total[-1] - done)
        if held:
            yield pa.Table.from_batches([x for x in held if x.num_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy("suffixes")
        for rows in blocks(batches):
            who = np.stack([rows.column(x).to_numpy() for x in ("id", "copy")], axis=1)
            start, n, h, block, wide = (rows.column(x).to_numpy() for x in ("start", "n", "h", "block", "wide"))
            order = np.lexsort((start, who[:, 1], who[:, 0]))
            data, at = _texts(rows.column("data").combine_chunks() if rows.column("data").num_chunks != 1 else rows.column("data").chunk(0))
            _, group = np.unique(np.stack([h, block.astype(np.int64)], axis=1), axis=0, return_inverse=True)
            who, start, n, h, wide, at, group = who[order], start[order], n[order].astype(np.int64), h[order], wide[order], at[:-1][order], group.reshape(-1)[order]
            own = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            gone = repeated(data, at[own] + place, group[own], length)
            # A row that is there twice is no match for itself
            again = np.concatenate([[False], (who[1:] == who[:-1]).all(axis=1) & (start[1:] == start[:-1])])
            gone &= ~again[own]
            x = np.flatnonzero(gone)
            out, begin, size = _joined(who[own[x]], start[own[x]] + place[x], np.ones(len(x), np.int64))
            none = np.zeros(len(begin), np.uint64)
            yield _batch(GONE, none, none, out, begin, size)
            x = np.flatnonzero(~gone & wide[own])
            if len(x):
                (name,) = string_hashes(data, (length,))
                yield _batch(FIRST, h[own[x]].view(np.uint64), name[at[own[x]] + place[x]], who[own[x]], start[own[x]] + place[x], np.ones(len(x), np.int64))

    return run


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job go when it has ended: what the next one needs is written."""
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, id, copy, text: copy tells apart rows that share an id, and is 0 for all others."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = stored(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit(True).alias("twice")), "twice")
    if twice.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    return rows.join(twice, "id", "left").withColumn("copy", F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("twice")


def covered(rows: DataFrame, length: int = LENGTH, kmer: int = KMER, block: int = BLOCK) -> DataFrame:
    """id, copy, start, n: strings of the documents that also start earlier, n of them one after the other from start; rows of a document may touch or overlap."""
    spark, own = rows.sparkSession, ("id", "copy", "start")
    while_needed = shared_folder(spark, "suffixes")
    found = stored(rows.select("id", "copy", "text").mapInArrow(find_runs(length, kmer), _RUN), "runs", while_needed)
    candidates = found.filter(F.col("kind") == CANDIDATE)
    # An anchor with over 1 / 2048 of all runs is named by tasks with at least half of them, so it has over 1 / 8192 here, and at most 8192 have
    least = max(FEW, candidates.count() // (2 * SHARE))
    common = found.filter(F.col("kind") == COMMON).groupBy("h").agg(F.sum("n").alias("common")).filter(F.col("common") >= least)
    dealt = candidates.join(F.broadcast(common), "h", "left").withColumn("salt", F.when(F.col("common").isNotNull(), F.pmod("c", F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    w = W.partitionBy("h", "salt").orderBy("c", *own)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = dealt.select("*", F.count("*").over(whole).alias("met"), (F.first("c").over(whole) != F.last("c").over(whole)).alias("unequal"))
    met = met.filter((F.col("met") > 1) | F.col("common").isNotNull())
    equal = W.partitionBy("h", "salt", "c").orderBy(*own)
    met = met.withColumn("later", F.struct(*own) != F.first(F.struct(*own)).over(equal))
    met = stored(met.filter("later or unequal or common is not null").select("h", *own, "n", "later"), "met", while_needed)
    # Unequal runs, by documents
    left = met.filter("not later").select("h", *own, "n")
    many = left.groupBy("h").agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1")
    left = left.join(many, "h", "left").withColumns({"wide": F.col("blocks").isNotNull(), "block": F.coalesce(F.pmod(F.xxhash64(*own), F.col("blocks")), F.lit(0)).cast("int")})
    asked = left.groupBy("id", "copy").agg(F.collect_list(F.struct("h", "block", "wide", "start", "n")).alias("runs"))
    cut = lambda data: F.transform("runs", lambda r: F.struct(r["h"].alias("h"), r["block"].alias("block"), r["wide"].alias("wide"), r["start"].alias("start"), r["n"].alias("n"), F.substring(data, r["start"] + 1, r["n"] + (length - 1)).alias("data")))
    # The array of one makes Spark take the bytes of a text once
    data = F.flatten(F.transform(F.array(F.col("text").cast("binary")), cut))
    sent = rows.select("id", "copy", "text").join(asked, ["id", "copy"]).select("id", "copy", F.inline(data))
    compared = sent.repartition("h", "block").sortWithinPartitions("h", "block").mapInArrow(compare(length), _RUN)
    compared = stored(compared, "compared", while_needed)
    first = compared.filter(F.col("kind") == FIRST)
    earliest = first.groupBy("h", "c").agg(F.min(F.struct(*own)).alias("earliest"))
    across = first.join(earliest, ["h", "c"]).filter(F.struct(*own) > F.col("earliest"))
    parts = [found.filter(F.col("kind") == GONE), met.filter("later"), compared.filter(F.col("kind") == GONE), across]
    out = parts[0].select(*own, "n")
    for part in parts[1:]:
        out = out.unionByName(part.select(*own, "n"))
    out = stored(out, "covered")
    discard(spark, while_needed)
    return out


def kept(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, left, sizes = [], [], []
            for text, starts, counts in zip(*(batch.column(x) for x in ("text", "starts", "counts")), strict=True):
                data = text.as_buffer().to_pybytes()
                own: list[list[int]] = []
                if starts.is_valid:
                    begin, n = starts.values.to_numpy(), counts.values.to_numpy()
                    order = np.argsort(begin)
                    for b, e in zip(begin[order].tolist(), (begin + n + (length - 1))[order].tolist(), strict=True):
                        if own and b <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], e)
                        else:
                            own.append([b, e])
                edges = [0, *(x for span in own for x in span), len(data)]
                left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in own])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return cut


def drop_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the maximal runs of bytes that go), kept (the bytes that stay), a row for each row of docs (doc_id, text). length has to be over kmer."""
    spark = docs.sparkSession
    prepare(spark)
    with _freed(spark):
        rows = identified(docs)
        gone = covered(rows, length, kmer, block)
        gone = stored(gone.groupBy("id", "copy").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts")), "spans")
    joined = rows.join(gone, ["id", "copy"], "left").select("doc_id", "text", "starts", "counts")
    return joined.mapInArrow(kept(length), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digests(kept_rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what drop_repeats gives."""
    return kept_rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substring(x, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH} + 1)) AS i FROM d)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY s) AS first FROM w) WHERE (doc_id, i) > first),
e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, true)::INT AS new FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM s),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z, string_agg(substring(x, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN x ELSE kept || substring(x, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
