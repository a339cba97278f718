"""One ruling that came by two channels: candidates by case number, likeness by min-hash signatures, and decisions that only a reader takes.

Documents are compared where they share a case number and come from different channels, and nowhere else. The likeness of two is the share of equal entries of their signatures, which estimates the Jaccard
likeness of their sets of three-word shingles with a standard error of at most 1 / (2 sqrt(SIGNATURE)). Nothing is ever merged: a pair is a proposal until the table of decisions holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.text import let, tokens

SIGNATURE, WORDS, ALIKE = 64, 3, 0.6
DECISIONS = "doc_a string, doc_b string, same boolean, who string, on string"


def shingles(text: Column) -> Column:
    """Hashes of the sets of three words in a row; of a shorter text, of all its words; none where it has no word."""
    rows = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, WORDS), " ")))
    return let(tokens(text), lambda w: F.when(F.size(w) > 0, F.array_distinct(rows(w))))


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
BLOCK = 1 << 15  # shingles that are hashed together, which a core's cache holds with what becomes of them


def _least() -> Callable[[pa.Array], pa.Array]:
    """A function of lists of hashes: the least of each of SIGNATURE hashes over each list, as by xxhash64 of an entry and the number of the hash. It needs no module of ours."""
    n, block, first, second, third, fourth, fifth = SIGNATURE, BLOCK, *(np.uint64(p) for p in (_P1, _P2, _P3, _P4, _P5))

    def mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(33)
        x *= second
        x ^= x >> np.uint64(29)
        x *= third
        x ^= x >> np.uint64(32)
        return x

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def of_longs(h: np.ndarray) -> np.ndarray:
        x = (np.uint64(42) + fifth + np.uint64(8)) ^ (turned(h * second, 31) * first)
        return mixed(turned(x, 27) * first + fourth)

    def least(lists: pa.Array) -> pa.Array:
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        values, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(sizes)
        held = np.flatnonzero(sizes)
        out, lo = np.empty((len(held), n), np.int64), 0
        with np.errstate(over="ignore"):
            while lo < len(held):
                start = ends[held[lo]] - sizes[held[lo]]
                hi = max(lo + 1, int(np.searchsorted(ends[held], start + block, side="right")))
                seeds = of_longs(values[start : ends[held[hi - 1]]]) + fifth + np.uint64(4)
                at = ends[held[lo:hi]] - sizes[held[lo:hi]] - start
                for k in range(n):
                    x = turned(seeds ^ (np.uint64(k + 1) * first), 23) * second + third
                    out[lo:hi, k] = np.minimum.reduceat(mixed(x).view(np.int64), at)
                lo = hi
        offsets = np.append(0, np.cumsum(np.where(sizes > 0, n, 0))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=pa.array(sizes == 0))

    return least


def signed(rows: DataFrame, name: str) -> DataFrame:
    """rows with their shingles, which a column holds, replaced by the signature: the least of each of SIGNATURE hashes over them; null where there are none. The hashes are made in numpy, over Arrow batches: as an expression, a lambda
    in a lambda, Spark interprets each of them."""
    least = _least()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(name)
            columns = [least(c) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return rows.mapInArrow(each, rows.schema)


def proposals(docs: DataFrame, channel: str = "channel", key: str = "doc_id", numbers: str = "numbers", text: str = "text", alike: float = ALIKE, path: str | None = None) -> DataFrame:
    """doc_a, doc_b, likeness, alike of documents of two channels that share a case number; the channel that sorts first is a. Texts are read once and only signatures are joined. path: a new folder that signatures
    are written to, which the two sides of the join else make each."""
    own = signed(docs.select(F.col(channel).alias("_channel"), F.col(key).alias("_key"), F.col(numbers).alias("_numbers"), shingles(F.col(text)).alias("_s")), "_s")
    if path:
        own.write.parquet(path)
        own = docs.sparkSession.read.parquet(path)
    rows = own.select("_channel", "_key", "_s", F.explode(F.array_distinct("_numbers")).alias("_number"))
    other = rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns])
    met = rows.join(other, (F.col("_number") == F.col("_number_b")) & (F.col("_channel") < F.col("_channel_b")))
    equal = F.size(F.filter(F.zip_with("_s", "_s_b", lambda x, y: x == y), lambda e: e))
    likeness = F.when(F.col("_s").isNull() | F.col("_s_b").isNull(), F.lit(0.0)).otherwise(equal / SIGNATURE)
    pairs = met.groupBy(F.col("_key").alias("doc_a"), F.col("_key_b").alias("doc_b")).agg(F.max(likeness).alias("likeness"))  # once, however many numbers they share
    return pairs.withColumn("alike", F.col("likeness") >= alike)


def undecided(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals that no one has decided on yet."""
    return pairs.join(decisions.select("doc_a", "doc_b"), ["doc_a", "doc_b"], "left_anti")


def equivalent(decisions: DataFrame) -> DataFrame:
    """doc_a, doc_b of the pairs that a reader took for one ruling; a no takes precedence over a yes."""
    return decisions.groupBy("doc_a", "doc_b").agg(F.min("same").alias("same")).filter("same").drop("same")
