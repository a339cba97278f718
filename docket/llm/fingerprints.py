"""SimHash fingerprints of documents, and search within a Hamming radius by block tables with probes.

Terms of a text are its distinct words and its distinct five-word shingles. A word weighs its length, at most 8, a shingle 8. Each term's
128 hash bits vote with the weight; a fingerprint bit is the sign of its votes. DataFrame functions only.

Defined results: null and empty texts, and texts without words, have the all-zero fingerprint. A text of fewer than five words has its whole
sequence of words as its one shingle. Repeated rows stay rows of their own; rows with one id follow each other in the order of their texts;
a null id comes first. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions, stored, words

SHINGLE = 5
MAX_WEIGHT = 8
RADIUS = 26  # measured: holds 99.7 % of planted copies with a Jaccard likeness of 0.8 or more; unrelated texts begin at about 46
FLIPS = 2  # bits of a block that a query changes to look its near ones up
CHUNK = 512
BUCKET, MOST_BUCKETS = 20_000, 65_536  # rows of a range of ids, and ranges at most
CELLS = 65_536  # counts of ids that the driver looks at together


def _terms(hashes: Column) -> Column:
    """Distinct term codes of an array of word codes. The low three bits of a code hold its weight less one."""
    shingle = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)]).bitwiseOR(F.lit(MAX_WEIGHT - 1))
    last = F.greatest(F.size(hashes) - SHINGLE, F.lit(0))
    return F.array_distinct(F.concat(hashes, F.transform(F.sequence(F.lit(0), last), shingle)))


def simhash(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, f1, f2: the two halves of the fingerprint of each row's text. keys must name rows; where df is partitioned by some of them, nothing is shuffled."""
    code = lambda w: F.xxhash64(w).bitwiseAND(F.lit(~7)).bitwiseOR((F.least(F.length(w), F.lit(MAX_WEIGHT)) - 1).cast("long"))
    coded = df.select(*keys, F.transform(words(F.col(text)), code).alias("_h"))
    terms = coded.select(*keys, F.explode_outer(F.when(F.size("_h") > 0, _terms(F.col("_h")))).alias("_t"))
    votes = terms.select(*keys, F.xxhash64("_t").alias("_a"), F.xxhash64("_t", F.lit(1)).alias("_b"), (F.col("_t").bitwiseAND(F.lit(7)) + 1).alias("_w"))
    # Bits i and i + 32 are counted in the two halves of one long
    lane = lambda h, i: F.sum(F.shiftright(h, i).bitwiseAND(F.lit((1 << 32) | 1)) * F.col("_w")).alias(f"{h}{i}")
    summed = votes.groupBy(*keys).agg(F.sum("_w").alias("_n"), *[lane(h, i) for h in ("_a", "_b") for i in range(32)])

    def half(h: str) -> Column:
        bit = lambda votes, i: F.when(votes * 2 > F.col("_n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = [bit(F.col(f"{h}{i}").bitwiseAND(F.lit((1 << 32) - 1)), i) for i in range(32)] + [bit(F.shiftrightunsigned(f"{h}{i}", 32), i + 32) for i in range(32)]
        return F.coalesce(reduce(lambda x, y: x.bitwiseOR(y), bits), F.lit(0).cast("long"))

    return summed.select(*keys, half("_a").alias("f1"), half("_b").alias("f2"))


def text_of(f1: str, f2: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (f1, f2)]))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits."""
    return 1 - sum(F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)) / 128.0


def _between(ids: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below ids: first among every so many, then among those that follow. The plan holds the bounds as one constant, however many."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    given = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    below = lambda array: F.size(F.filter(array, lambda b: b <= ids))
    block = F.greatest(below(given(bounds[::step])) - 1, F.lit(0)) * step
    return block + below(F.slice(given(bounds), block + 1, F.lit(step)))


def _cuts(docs: DataFrame, n: int, low: int, high: int, rows: int) -> list[int]:
    """Ids that cut the rows into about n ranges of about equal counts. Counts of cells of ids with equal leading bits come to the driver, at most CELLS at a time; a cell with more
    rows than a range is cut again by more bits, down to single ids."""
    bits = 0
    while (high >> bits) - (low >> bits) >= CELLS:
        bits += 1
    cell = lambda: F.shiftright("doc_id", bits)
    todo, done = docs.filter("doc_id is not null"), []
    while True:
        got = [(r.c << bits, r.n) for r in todo.groupBy(cell().alias("c")).agg(F.count("*").alias("n")).collect()]
        heavy = [c for c, k in got if bits and k > rows / n]
        done += [(c, k) for c, k in got if not bits or k <= rows / n]
        if not heavy:
            break
        todo = todo.filter(cell().isin([c >> bits for c in heavy]))
        bits -= min(bits, max(1, (CELLS // len(heavy)).bit_length() - 1))
    cuts, held = [], 0
    for c, k in sorted(done):
        if held >= rows / n:
            cuts.append(c)
            held = 0
        held += k
    return cuts


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows _bucket, _rn, doc_id, text, next: next is the text of the row that follows by doc_id, for the last the first.

    Ids are cut into buckets of about equal row counts, and each bucket also gets the first row of the one after it, marked _halo. So whole texts
    are shuffled once, and only counts of ranges of ids and one id for each bucket go to the driver. Buckets grow in number with the rows, to about BUCKET rows each.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    n = buckets or min(MOST_BUCKETS, max(4 * partitions(spark), rows.n // BUCKET))
    cuts = _cuts(docs.select("doc_id"), n, rows.low, rows.high, rows.n) if rows.n else []
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_between(F.col("doc_id"), cuts))
    firsts = sorted(docs.groupBy(bucket.alias("b")).agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("id"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).collect())
    to = [(r.id, bool(r.nulls), firsts[i - 1].b) for i, r in enumerate(firsts)]
    halo = spark.createDataFrame(to, "_id long, _null boolean, _to int")
    on = F.when(F.col("_null"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("_id"))
    rows = docs.withColumn("_own", bucket.cast("int")).withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = rows.join(F.broadcast(halo.withColumnRenamed("_id", "_key")), "_key", "left")  # a row for each bucket
    places = F.array(F.struct(F.col("_own").alias("_bucket"), F.lit(False).alias("_halo")), F.struct(F.col("_to").alias("_bucket"), F.lit(True).alias("_halo")))
    rows = rows.select("doc_id", "text", F.inline(F.filter(places, lambda p: p["_bucket"].isNotNull())))
    w = W.partitionBy("_bucket").orderBy("_halo", "doc_id", "text")
    return rows.select("_bucket", "_halo", F.row_number().over(w).alias("_rn"), "doc_id", "text", F.lead("text").over(w).alias("next"))


def edited_likeness(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Of each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, f1, f2.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next document.
    """
    rows = with_next(docs, buckets)
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.coalesce(F.expr("substring(next, 1, cast(floor(length(text) / 4) as int))"), F.lit("")))
    own = F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"), F.lit(None).cast("string").alias("sha"))
    cut = F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"), F.sha2("edited", 256).alias("sha"))
    rows = rows.select("_bucket", "_halo", "_rn", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("_halo"), edited).alias("edited"), (k * 0).alias("_k"))
    both = rows.select("_bucket", "_halo", "_rn", "doc_id", "n_chars", F.inline(F.when(F.col("_halo"), F.array(own)).otherwise(F.array(own, cut))))
    keys = ["_bucket", "_halo", "_rn", "doc_id", "n_chars", "kind", "sha"]
    prints = simhash(both, keys, "body")
    row = ["_bucket", "_halo", "_rn", "doc_id", "n_chars"]
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = prints.groupBy(*row).agg(of(0, "f1").alias("f1"), of(0, "f2").alias("f2"), of(1, "f1").alias("e1"), of(1, "f2").alias("e2"), F.max("sha").alias("edited_sha256"))
    w = W.partitionBy("_bucket").orderBy("_halo", "_rn")
    wide = wide.withColumns({"n1": F.lead("f1").over(w), "n2": F.lead("f2").over(w)}).filter(~F.col("_halo"))
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", text_of("f1", "f2").alias("fingerprint"), text_of("e1", "e2").alias("edited_fingerprint"),
        likeness(("f1", "f2"), ("e1", "e2")).alias("near_edited"), likeness(("f1", "f2"), ("n1", "n2")).alias("near_next"), "f1", "f2",
    )


def _block(half: tuple[Column, Column], lo: int, hi: int) -> Column:
    """Bits lo to hi, fewer than 64, of the two halves."""
    cut = lambda c, a, b: F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << b - a) - 1).cast("long"))
    if hi <= 64 or lo >= 64:
        return cut(half[lo // 64], lo % 64, (hi - 1) % 64 + 1)
    return cut(half[0], lo, 64).bitwiseOR(F.shiftleft(cut(half[1], 0, hi - 64), 64 - lo))


def within_radius(index: DataFrame, queries: DataFrame, radius: int = 6) -> DataFrame:
    """f1, f2, n_near, near_min: for each fingerprint of queries, the rows of index within the radius, itself included, and the smallest of their ids.

    index: f1, f2, n (rows with it), id (their smallest). queries: distinct f1, f2. The bits are cut into so many blocks that within the radius one of them differs in
    at most FLIPS bits; a table for each block holds the index by the block's bits, and a query asks for its own bits with up to FLIPS of them changed. A pair counts
    only in the first table that shows it. Large buckets are cut into chunks, so that no task gets an unbounded bucket; a bucket joins chunks and not pairs.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be from 0 to {RADIUS}")
    n = max(3, radius // (FLIPS + 1) + 1)
    blocks = [(128 * t // n, 128 * (t + 1) // n) for t in range(n)]
    halves = (F.col("f1"), F.col("f2"))

    def probes(t: int) -> Column:
        lo, hi = blocks[t]
        masks = [sum(1 << b for b in bits) for k in range(FLIPS + 1) for bits in combinations(range(hi - lo), k)]
        return F.transform(F.expr(f"array({', '.join(f'{m}L' for m in masks)})"), lambda m: F.struct(F.lit(t).alias("t"), _block(halves, lo, hi).bitwiseXOR(m).alias("k")))

    own = F.array(*[F.struct(F.lit(t).alias("t"), _block(halves, lo, hi).alias("k")) for t, (lo, hi) in enumerate(blocks)])
    asked = queries.select("f1", "f2", F.inline(F.flatten(F.array(*map(probes, range(n))))))
    held = index.select("f1", "f2", "n", "id", F.inline(own))
    sized = held.join(held.groupBy("t", "k").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks")), ["t", "k"])
    sized = sized.withColumn("_chunk", F.pmod(F.xxhash64("f1", "f2"), F.col("_chunks")))
    chunks = sized.groupBy("t", "k", "_chunk").agg(F.collect_list(F.struct("f1", "f2", "n", "id")).alias("_held"))

    def match(x: Column) -> Column:
        a, b = x["f1"].bitwiseXOR(F.col("f1")), x["f2"].bitwiseXOR(F.col("f2"))
        shown = [F.bit_count(_block((a, b), lo, hi)) <= FLIPS for lo, hi in blocks]
        first = reduce(lambda out, t: out.when(shown[t], t), range(1, n), F.when(shown[0], 0))
        return (F.bit_count(a) + F.bit_count(b) <= radius) & (first == F.col("t"))

    # Spark takes the probes' size for that of the queries and would broadcast them
    found = asked.hint("merge").join(chunks, ["t", "k"]).select("f1", "f2", F.filter("_held", match).alias("_near"))
    total = F.aggregate("_near", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    near = found.select("f1", "f2", total.alias("n"), F.array_min(F.transform("_near", lambda x: x["id"])).alias("id"))
    return near.groupBy("f1", "f2").agg(F.sum("n").alias("n_near"), F.min("id").alias("near_min")).filter("n_near > 0")


def fingerprint_documents(docs: DataFrame, query_every: int = 50, radius: int = RADIUS) -> DataFrame:
    """Fingerprints and likenesses of all documents; those whose id is divisible by query_every also get n_near, the other rows within the radius, and near_min, the smallest id within it (their own counts)."""
    rows = stored(edited_likeness(docs), "fingerprints")
    classes = rows.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"))
    asked = rows.filter(F.col("doc_id") % query_every == 0).select("f1", "f2").distinct()
    near = within_radius(classes, asked, radius).select(F.col("f1").alias("_q1"), F.col("f2").alias("_q2"), (F.col("n_near") - 1).alias("n_near"), "near_min")
    queries, rest = (F.col("doc_id") % query_every == 0), ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found = rows.filter(queries).join(near, (F.col("f1") == F.col("_q1")) & (F.col("f2") == F.col("_q2")), "left").select(*rest, "n_near", "near_min")
    others = rows.filter(~F.coalesce(queries, F.lit(False))).select(*rest, F.lit(None).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_min"))
    return found.unionByName(others)
