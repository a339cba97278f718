"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docket.llm import bpe, fingerprints, jaccard, lines, neighbours, packing, pii, tokens, toxicity, urls

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdeiorst"), RNG.integers(2, 9))) for _ in range(300)]
prose = lambda n: " ".join(RNG.choice(WORDS, n))
LONG = prose(6000)
SHARED = prose(60)
TEXTS = [None, "", " \n\t", "one", "One two", prose(40), prose(200), LONG, LONG + " end", SHARED, SHARED.upper(), SHARED + " tail", "Ünïcode 🙂 漢字 " * 30, "x" * 3000, SHARED]
ROWS = [*enumerate(TEXTS), (3, "one"), (None, prose(12)), (None, None)]
CLASH = ("_h", "n_chars", "f1", "key", "component", "kind", "score", "rank", "length", "_text")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with every odd case, in several partitions, with more columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(docs, empty):
    rows = fingerprints.fingerprint_documents(docs, query_every=2).collect()
    assert len(rows) == len(ROWS) and fingerprints.fingerprint_documents(empty).count() == 0
    ordered = sorted(((i, t or "") for i, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        cut, after = len(t) // 4, ordered[(k + 1) % len(ordered)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    none_first = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=none_first) == sorted(want, key=none_first)
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert of[9].fingerprint == of[10].fingerprint == of[14].fingerprint and of[1].fingerprint == "0" * 32 and len(of[5].fingerprint) == 32
    long = [r for r in rows if r.n_chars > 100]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.1
    ints = [int(r.fingerprint, 16) for r in rows]
    for r, a in zip(rows, ints):
        if r.doc_id is not None and r.doc_id % 2 == 0:
            assert r.n_near == sum((a ^ b).bit_count() <= fingerprints.RADIUS for b in ints) - 1
        else:
            assert r.n_near is None


def test_fingerprints_equal_a_brute_force_version(spark, docs):
    def hashes(values):
        """xxhash64 by Spark of rows of columns, as the votes are its bits."""
        n = len(values[0])
        df = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], ", ".join(["k long", *(f"c{i} {'string' if isinstance(values[0][0], str) else 'long'}" for i in range(n))]))
        return [r[0] for r in df.orderBy("k").select(F.xxhash64(*[f"c{i}" for i in range(n)])).collect()]

    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    texts = [t for t in TEXTS if words(t)]
    some = sorted({w for t in texts for w in lower(t)})
    code = {w: h & ~7 | min(len(w), 8) - 1 for w, h in zip(some, hashes([(w,) for w in some]))}
    want = {}
    for t in texts:
        w = [code[x] for x in lower(t)]
        grams = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        full, short = [g for g in grams if len(g) == 5], [g for g in grams if len(g) < 5]
        terms = set(w) | {h | 7 for h in (hashes(full) if full else [])} | {h | 7 for h in (hashes(short) if short else [])}
        votes = np.zeros(128, np.int64)
        terms = sorted(terms)
        first = hashes([(x,) for x in terms])
        df = spark.createDataFrame([(k, x) for k, x in enumerate(terms)], "k long, x long")
        second = [r[0] for r in df.orderBy("k").select(F.xxhash64("x", F.lit(1))).collect()]
        for x, a, b in zip(terms, first, second):
            bits = [(h >> i) & 1 for h in (a, b) for i in range(64)]
            votes += (2 * np.array(bits) - 1) * ((x & 7) + 1)
        half = lambda v: sum(1 << i for i in range(64) if v[i] > 0)
        want[t] = f"{half(votes[:64]):016x}{half(votes[64:]):016x}"
    rows = fingerprints.fingerprint_documents(docs, query_every=2).collect()
    of = {i: t for i, t in ROWS if i is not None}
    for r in rows:
        if r.doc_id is not None and words(of[r.doc_id]) and r.n_chars == len(of[r.doc_id]):
            assert r.fingerprint == want[of[r.doc_id]]
    # Likenesses, row by row
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    alike = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    assert all(r.near_edited == alike(r.fingerprint, r.edited_fingerprint) for r in rows)
    single = [k for k, r in enumerate(ordered) if [x.doc_id for x in ordered].count(r.doc_id) == 1 and [x.doc_id for x in ordered].count(ordered[(k + 1) % len(ordered)].doc_id) == 1]
    assert len(single) > 8 and all(ordered[k].near_next == alike(ordered[k].fingerprint, ordered[(k + 1) % len(ordered)].fingerprint) for k in single)


@pytest.mark.parametrize("ids", [[7] * 50 + [8], [-(2**63), 2**63 - 1, 0], list(range(1000)), [k * 10**15 for k in range(-500, 500)], [0] * 300 + list(range(10**12, 10**12 + 300))])
def test_ranges_of_ids_are_even(spark, ids, monkeypatch):
    monkeypatch.setattr(fingerprints, "CELLS", 64)
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long")
    cuts = fingerprints._cuts(df, 10, min(ids), max(ids), len(ids))
    assert cuts == sorted(set(cuts)) and len(cuts) < 11
    got = {r.doc_id: r.b for r in df.filter("doc_id is not null").select("doc_id", fingerprints._between(F.col("doc_id"), cuts).alias("b")).collect()}
    assert all(got[i] == sum(c <= i for c in cuts) for i in ids)
    most = max(map(ids.count, set(ids)))
    assert max(sum(got[i] == b for i in ids) for b in set(got.values())) <= max(2 * len(ids) / 10, most + len(ids) / 10) + 1


def test_radius_search_finds_all(spark):
    base = int(RNG.integers(0, 2**62)) | int(RNG.integers(0, 2**62)) << 64
    flip = lambda n: base ^ sum(1 << int(b) for b in RNG.choice(128, n, replace=False))
    values = sorted({base, *(flip(n) for n in range(1, 12) for _ in range(20))})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    index = spark.createDataFrame([(signed(v & (2**64 - 1)), signed(v >> 64), 1, k) for k, v in enumerate(values)], "f1 long, f2 long, n long, id long")
    got = {r.f1 % 2**64 | (r.f2 % 2**64) << 64: r.n_near for r in fingerprints.within_radius(index, index.select("f1", "f2")).collect()}
    assert got == {v: sum((v ^ x).bit_count() <= 6 for x in values) for v in values}


def test_fingerprints_find_near_copies(spark):
    rows, near = [], 0
    for k in range(40):
        base = prose(300).split()
        copy = list(base)
        for at in RNG.choice(300, 6, replace=False):
            copy[at] = "edited"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        near += len(a & b) >= 0.8 * len(a | b)
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), query_every=2).collect()}
    ints = {i: int(r.fingerprint, 16) for i, r in out.items()}
    assert near >= 30 and sum(out[2 * k].n_near >= 1 for k in range(40)) >= 39
    assert all(out[2 * k].n_near == sum((ints[2 * k] ^ x).bit_count() <= fingerprints.RADIUS for x in ints.values()) - 1 for k in range(40))


@pytest.mark.parametrize("radius", [0, 13, 26])
def test_wide_radius_search_finds_all(spark, radius):
    values = [int(RNG.integers(0, 2**62)) << 66 | int(RNG.integers(0, 2**62)) << 2 for _ in range(4)]
    values = sorted({*values, *(v ^ sum(1 << int(b) for b in RNG.choice(128, n, replace=False)) for v in values for n in (1, 12, 13, 14, 25, 26, 27) for _ in range(8))})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    index = spark.createDataFrame([(signed(v & (2**64 - 1)), signed(v >> 64), 1, k) for k, v in enumerate(values)], "f1 long, f2 long, n long, id long")
    got = {r.f1 % 2**64 | (r.f2 % 2**64) << 64: (r.n_near, r.near_min) for r in fingerprints.within_radius(index, index.select("f1", "f2"), radius).collect()}
    assert got == {v: (len(near := [k for k, x in enumerate(values) if (v ^ x).bit_count() <= radius]), near[0]) for v in values}


def test_lines(spark, empty):
    rows = [(k, "h" if k else None, f"Menu\n{prose(3)}\n \tMenu\nown {k}\n") for k in range(30)] + [(99, "h", None), (98, "h", ""), (97, "one", "Menu")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_host", F.lit("clash"))
    out = {r.doc_id: r for r in lines.drop_boilerplate(df, min_pages=5).collect()}
    assert len(out) == len(rows) and out[1].text == rows[1][2].replace("Menu\n", "").replace(" \t", "") and (out[1].n_lines, out[1].n_dropped) == (5, 2)
    assert out[0].text == rows[0][2] and out[99].text is None and out[98].text == "" and out[97].text == "Menu"
    assert lines.drop_boilerplate(empty.withColumn("source", F.lit("h"))).count() == 0


def test_lines_take_clashing_names_and_repeated_rows(spark):
    """Against a version without Spark: hosts of one page and of many, repeated rows and ids, null hosts and ids, very long lines, and all names that the operator uses itself."""
    own = np.random.default_rng(17)
    menu = ["Menu", "\tMenu ", "About us", "x" * 100_000, "", " "]
    rows = [(own.choice([k, 1, None]), own.choice(["h", "h", "h", "small", None]), "\n".join(own.choice([*menu, f"own {own.integers(60)}"]) for _ in range(int(own.integers(0, 7))))) for k in range(120)]
    rows = [(None if k is None else int(k), None if h is None else str(h), str(t)) for k, h, t in rows] + [(7, "h", "Menu\nsame")] * 20 + [(8, "h", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("clash") for c in ("_host", "_lines", "_kept", "_text", "_key", "_pages", "_all", "_of", "n_lines", "n_dropped", "__host")})
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    pages, holding = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        holding.update({(h, bare(x)) for x in (t or "").split("\n")} - {(h, "")})
    gone = {(h, x) for (h, x), n in holding.items() if n >= 5 and n > 0.2 * pages[h]}
    want = []
    for k, h, t in rows:
        kept = [x for x in (t or "").split("\n") if (h, bare(x)) not in gone]
        want.append((k, h, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(kept), "clash"))
    out = lines.drop_boilerplate(df, max_ratio=0.2, min_pages=5)
    assert sorted(out.columns) == sorted(df.columns) and len(gone) > 2
    assert Counter(map(tuple, out.select("doc_id", "source", "text", "n_lines", "n_dropped", "_kept").collect())) == Counter(want)


def test_neighbours(spark):
    x = RNG.standard_normal((700, 16)).astype("float32")
    x[5], x[6] = x[4], x[4]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = neighbours.search(df, df.filter("vec_id % 50 = 0 or vec_id = 4"), shard=200, block=8).collect()
    d = x.astype(float)
    norms, hits, best = np.sqrt((d * d).sum(axis=1)), 0, defaultdict(list)
    for r in got:
        best[r.query_id].append(r)
        assert r.score == (d[r.vec_id] * d[r.query_id]).sum() / (norms[r.vec_id] * np.sqrt((d[r.query_id] * d[r.query_id]).sum()))
    for q, found in best.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(found, found[1:]))
        s = d @ d[q] / norms
        s[q] = -9
        hits += len({r.vec_id for r in found} & set(np.argsort(-s)[:5].tolist()))
    assert len(best) == 15 and [r.vec_id for r in best[4]][:2] == [5, 6] and hits / (5 * len(best)) >= 0.9
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0 and neighbours.search(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0


def test_neighbours_with_repeated_ids_and_other_lengths(spark):
    x = RNG.standard_normal((400, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1 + k % 3, (x[0] + 0.01 * RNG.standard_normal(8)).tolist()) for k in range(150)]  # three near ids many times
    rows += [(1000 + k, RNG.standard_normal(20).tolist()) for k in range(3)]  # over-long ones
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(df, df.filter("vec_id in (0, 1000)"), share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    best = defaultdict(lambda: -2.0)
    for i, v in rows:
        if len(v) == 8 and i:
            v = np.array(v)
            best[i] = max(best[i], v @ x[0] / np.sqrt((v @ v) * (x[0] @ x[0])))
    assert got[0] == sorted(best, key=lambda i: -best[i])[:5] and set(got[1000]) == {1001, 1002}
    few = df.filter("vec_id < 6")
    assert neighbours.search(few, few.filter("vec_id = 0").limit(1)).count() == 5
    names = np.array([k if k < 400 else 1 + (k - 400) % 3 for k in range(550)])
    found = neighbours.nearest(names, np.array([v for _, v in rows[:550]]), np.array([0]), x[:1], 100, 0.01)
    assert len(set(found["vec_id"])) == len(found) == 100


def test_neighbours_take_clashing_names_and_queries_in_many_blocks(spark):
    """Two lengths, more shards than tasks, blocks of three; columns with the names that the operator uses itself."""
    own = np.random.default_rng(17)
    x = {k: own.standard_normal(6 if k % 5 else 9) for k in range(300)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "vec_id long, embedding array<double>")
    clash = df.withColumns({c: F.lit("clash") for c in ("rank", "score", "query_id", "shard", "dim", "asked", "v")})
    got = defaultdict(list)
    for r in neighbours.search(clash, clash.filter("vec_id % 7 = 0"), share=1.0, shard=40, block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    assert len(got) == 43
    for q, found in got.items():
        assert found == sorted((k for k in x if k != q and len(x[k]) == len(x[q])), key=lambda k: -cos(x[k], x[q]))[:5]
    both = neighbours.search(df.limit(0), df.filter("vec_id = 0"))
    assert both.count() == 0 and both.columns == ["query_id", "rank", "vec_id", "score"]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, length=256, max_docs=8, shard=6).collect()
    want = sorted((zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()), a, len(ids[a : a + 256])) for _, t in ROWS for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [0]] for a in range(0, len(ids), 256))
    assert sorted((r.ids_crc32, r.start, r.length) for r in rows) == want and all(r.start == r.piece * 256 for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256 and len(parts) <= 8
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_ids_equal_the_library(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "'s", "'LL", "!?", "...", "12", "İ", "ſ", "é", "e\u0301", "ﬁ", "漢字", "🙂", "\u200b", "\xa0", "\t", "\r\n", "\x1c", "Straße", "ŉ", "ǅ", "Ω"]
    texts = []
    for _ in range(20_000):
        some = [str(RNG.choice(marks)) if RNG.random() < 0.5 else str(RNG.choice(WORDS)) for _ in range(int(RNG.integers(1, 7)))]
        texts.append("".join(w + str(RNG.choice(["", " ", "\n", "  "])) for w in some))
    assert sum("<|endoftext|>" in t for t in texts) > 100 and sum("<|startoftext|>" in t for t in texts) > 100
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "KNOWN", 20_000)
    words = packing.Words(path)
    got = [ids[a:b].tolist() for lo in range(0, len(texts), 500) for ids, n in [words(pa.array(texts[lo : lo + 500]))] for a, b in zip(np.cumsum(n) - n, np.cumsum(n))]
    assert words.plain and got == want
    words.plain = False  # as for a file with other rules
    ids, n = words(pa.array(texts[:500]))
    assert ids.tolist() == [k for x in want[:500] for k in x] and n.tolist() == [len(x) for x in want[:500]]
    # Texts longer than a block, alone and in a row
    monkeypatch.setattr(packing, "BLOCK", 300)
    words.plain, given = True, [prose(200), prose(150), "short", "", prose(3), prose(400) + "\n" + "y" * 700, prose(90)]
    rows = [(first + k, ids[a : a + c].tolist()) for first, ids, n in packing._encoded(words, pa.array(given)) for k, (a, c) in enumerate(zip(np.cumsum(n) - n, n))]
    assert rows == [(k, tokenizer.encode(t, add_special_tokens=False).ids) for k, t in enumerate(given)]


def test_best_fit_uses_few_sequences_under_every_constraint():
    sizes = RNG.integers(1, 1500, 3000)
    for rule in ("norm", "dot"):
        sequence, offset = packing.best_fit(sizes, 2048, 2048, 2048.0**2, rule=rule)
        assert np.bincount(sequence, sizes).max() <= 2048 and sequence.max() + 1 <= 1.02 * sizes.sum() / 2048 + 1
        sequence, _ = packing.best_fit(sizes, 2048, 3, 1500.0**2, rule=rule)
        assert np.bincount(sequence).max() <= 3 and np.bincount(sequence, sizes.astype(float) ** 2).max() <= 1500.0**2 + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([9]), 8, 8, 64.0)


def test_bpe_equals_the_reference_encoder(docs, empty):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rows = bpe.encode_documents(docs, path, pattern).collect()
    want = [(len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in ROWS for ids in [encoder.encode_ordinary(t or "")]]
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want) and bpe.encode_documents(empty, path, pattern).count() == 0
    odd = [" " * 500 + "x", "=" * 301, "aab" * 100, "".join(RNG.choice(list("abc"), 400)), "<|endoftext|> it's", "é" * 90]
    got = list(bpe.Codec(path, pattern)(odd))
    assert [np.frombuffer(a, "<u4").tolist() for a, _ in got] == [encoder.encode_ordinary(t) for t in odd] and [b.decode() for _, b in got] == odd


PERSONAL = [
    ("mail bob.smith [at] example [dot] com now", ["email:bob.smith [at] example [dot] com"]), ("bob at example dot com", ["email:bob at example dot com"]),
    ("jane ＠ example．com", ["email:jane ＠ example．com"]), ("al​ice@exam​ple.com", ["email:al​ice@exam​ple.com"]),
    ("plus four nine one seven one two three four five six seven", ["phone:plus four nine one seven one two three four five six seven"]),
    ("４２７９０５５８９０７６４９１３", ["card:４２７９０５５８９０７６４９１３"]), ("192 dot 168 dot 1 dot 1", ["ip:192 dot 168 dot 1 dot 1"]),
    ("a.b@c-d.org, +49 (171) 234-5678, 10.0.0.255, 4279 0558 9076 4913", ["email:a.b@c-d.org", "phone:+49 (171) 234-5678", "ip:10.0.0.255", "card:4279 0558 9076 4913"]),
    ("Look at the dot on the wall. We met at noon", []), ("999.1.1.1 1234567890123456", []), ("un deux trois quatre chats", []),
]


@pytest.mark.parametrize(("text", "want"), PERSONAL)
def test_pii_finds(text, want):
    assert [f"{k}:{text[a:b]}" for k, a, b in pii.spans(text)[1]] == want


def test_pii_looks_at_every_character_it_can_map():
    mapped = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if pii._plain_letter(c) is not None]
    assert {*pii.INVISIBLE, *pii.LOOKALIKES} <= set(mapped) and all(map(pii.ODD.fullmatch, mapped))
    for c in pii.INVISIBLE:
        assert pii.written(pii.spans(f"to al{c}ice@exam{c}ple.com")[1]) == "email:3:22"
    for c, sign in pii.LOOKALIKES.items():
        text = f"xy@exam{c}ple" + (f"{c}com" if sign == "." else ".com") if sign != "@" else f"xy{c}example.com"
        assert ("email", 0, len(text)) in pii.spans(text)[1], c
    card = "①②③④⑤⑥⑦⑧①②③④⑤⑥⑧"
    digit = next(d for d in "①②③④⑤⑥⑦⑧⑨" if pii.luhn("".join(str("①②③④⑤⑥⑦⑧⑨".index(x) + 1) for x in card + d)))
    assert pii.written(pii.spans(card + digit)[1]) == "card:0:16"
    text = "mail a.b@example․com"
    assert pii.redacted(text, pii.spans(text)[1]) == "mail <EMAIL>"


@pytest.mark.parametrize(("text", "want"), [
    ("anna at example\tdot\tcom", ["email:anna at example\tdot\tcom"]), ("anna@example\tDOT\tcom", ["email:anna@example\tDOT\tcom"]), ("plus four.nine.one.seven.one.two.three.four.five.six.seven", ["phone:plus four.nine.one.seven.one.two.three.four.five.six.seven", "ip:four.nine.one.seven", "ip:one.two.three.four"]),
    ("(plus 49 171 2 3 4 five six seven)", ["phone:plus 49 171 2 3 4 five six seven"]), ("192\tdot\t168\tdot\t1\tdot\t1", ["ip:192\tdot\t168\tdot\t1\tdot\t1"]), ("plus four nine one seven one two three four five s\u0130x seven", ["phone:plus four nine one seven one two three four five s\u0130x seven"]),
])
def test_pii_gate_lets_disguises_through(text, want):
    assert [f"{k}:{text[a:b]}" for k, a, b in pii.spans(text)[1]] == want


def test_pii_gate_changes_nothing(monkeypatch):
    pick = lambda x: x[int(RNG.integers(len(x)))]
    blank, texts = lambda: pick([" ", "\t", "  ", " \t"]), []
    case = lambda w: pick([w, w.upper(), w.title(), w.replace("i", "\u0130")])
    dot, at, digit = (lambda: case(pick(pii.DOT.split("|")))), (lambda: case(pick(pii.AT.split("|")))), (lambda: case(pick([*pii.DIGITS])))
    for _ in range(1500):
        about = pick([("", ""), ("(", ")"), ("see\n", "."), ('"', '"'), ("x ", " y")])
        sign = lambda w, s: pick([lambda: blank() + w + blank(), lambda: f"[{w}]", lambda: f" ( {s} ) ", lambda: s, lambda: blank() + s + blank()])()
        mail = "anna" + sign(at(), "@") + "example" + sign(dot(), ".") + "com"
        gap = pick([" ", "\t", ".", ",", "-", " - ", ". ", f" {pick(['dot', 'dash', 'punkt'])} "])
        number = pick(["plus ", "", "+"]) + gap.join(pick([digit(), digit(), str(int(RNG.integers(300)))]) for _ in range(int(RNG.integers(3, 17))))
        ip = (blank() + dot() + blank()).join(pick([str(int(RNG.integers(256))), digit()]) for _ in range(4))
        texts.append(about[0] + pick([mail, number, ip]) + about[1])
    gated = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "_suspect", lambda *_: True)
    assert gated == [pii.spans(t) for t in texts] and sum(len(every) > len(base) for base, every in gated) > 300


def test_pii_base(docs, empty):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def base(t):
        out = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 14 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
        out += [("phone", *m.span()) for m in phone.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    some = lambda n, of: ["".join(RNG.choice(list(of), int(RNG.integers(1, 40)))) for _ in range(n)]
    odd = [*some(3000, "a1@.-_+ "), *some(3000, "0123 .-"), *some(2000, "+1 ().-23456789x"), "@@a@b.c@d.e", "x" * 2000 + "@a.b", "1.2.3.4.5.6.7.8", "+1 2", "+12345678901 +1(23)456.78-90", *[t for t, _ in PERSONAL], *(t or "" for t in TEXTS)]
    assert all(pii.plain(t) == base(t) for t in odd)
    rows = pii.find(docs).collect()
    assert len(rows) == len(ROWS) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.spans) and pii.find(empty).count() == 0
    masked = pii.redact(docs.withColumn("text", F.when(F.col("doc_id") == 3, "to a@b.c!").otherwise(F.col("text")))).collect()
    assert {r.text for r in masked if r.doc_id == 3} == {"to <EMAIL>!"} and any(r.text is None for r in masked)


LONG_TEXTS = {
    "word": "x" * 1_000_000 + "\u200b", "digits": "1" * 1_000_000 + " one two three", "dots": "a." * 500_000 + "\u200b", "spelled": "one " * 50_000 + "onex", "blanks": "x" + " " * 1_000_000 + "\u200b",
    "name": "x" * 1_000_000 + "@!", "words": "a dot " * 160_000, "ats": "@ " * 500_000, "numbers": "1.2.3.4.5.6 " * 80_000, "at": "a at " * 200_000,
}


@pytest.mark.parametrize("name", LONG_TEXTS)
def test_pii_takes_long_texts(name):
    began = time.process_time()
    base, every = pii.spans(LONG_TEXTS[name])
    assert time.process_time() - began < 8 and len(every) == len(base) == (80_000 if name == "numbers" else 0)


def test_jaccard(spark, docs, empty):
    more = []
    for k in range(40):  # chains of edits, copies, and a passage that many share
        base = prose(120).split()
        for e in range(4):
            more.append((1000 + 10 * k + e, " ".join(base[: 100 + 5 * e] + [SHARED] * (k % 2))))
            base[int(RNG.integers(len(base)))] = "edited"
    df = docs.select("doc_id", "text", "key", "component").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumns({"key": F.lit(""), "component": F.lit("")}))
    rows = [*ROWS, *more]
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    none_first = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_components(df).collect()]
    assert sorted(got, key=none_first) == sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=none_first)
    assert jaccard.similarity_components(empty).count() == 0
    # All links between classes of equal sets, also within a component
    links, classes = jaccard.similarity_links(df)
    first = {}
    for i, a in sets:
        if i is not None and a:
            first[frozenset(a)] = min(i, first.get(frozenset(a), i))
    reps = [(i, set(a)) for a, i in first.items()]
    want = {(min(i, j), max(i, j)) for n, (i, a) in enumerate(reps) for j, b in reps[:n] if 100 * len(a & b) >= 80 * len(a | b)}
    assert sorted(map(tuple, links.collect())) == sorted(want) and len(want) > 60
    got = [(r.doc_id, r.class_id) for r in classes.collect()]
    assert sorted(got, key=none_first) == sorted(((i, first[frozenset(a)] if i is not None and a else i) for i, a in sets), key=none_first)
    assert jaccard.similarity_links(empty)[0].count() == 0


def test_jaccard_takes_large_groups(spark, monkeypatch):
    """A passage that many short documents share makes tiles of many unlike documents; a large group of near copies makes tiles of like ones."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    rows = [(k, SHARED + " " + prose(30)) for k in range(400)]
    base = prose(150).split()
    for k in range(400):
        copy = list(base)
        for at in RNG.choice(150, 2, replace=False):
            copy[at] = f"edit{k}"
        rows.append((1000 + k, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if abs(i - j) < 500 and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    assert got == {i: top(i) for i, _ in rows}


def test_tree_bound_loses_nothing():
    points = RNG.poisson(1.2, (300, jaccard.GROUPS)).astype(np.int32)
    points[100:200] = np.maximum(points[:100] + RNG.integers(-1, 2, (100, jaccard.GROUPS)) * (RNG.random((100, jaccard.GROUPS)) < 0.08), 0)
    x, y = jaccard.Tree(points).near(points)
    size = points.sum(axis=1)
    want = {(i, j) for i in range(300) for j in range(300) if np.minimum(points[i], points[j]).sum() * 180 >= 80 * (size[i] + size[j]) and min(size[i], size[j]) * 100 >= 80 * max(size[i], size[j])}
    assert set(zip(x.tolist(), y.tolist())) == want


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in jaccard.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_toxicity(spark, docs, empty, monkeypatch):
    bad = ["vilexa", "vilexon", "gromptar"]
    rows = [(2000 + k, prose(60) + (" " + " ".join(RNG.choice(bad, 3)) + "\n" + prose(20) if k % 3 == 0 else "\n" + prose(20))) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 2)) for i, _ in rows] + [(2000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").unionByName(spark.createDataFrame([(2002, 1, 1)], "doc_id long, quality int, toxic int"))
    labels = labels.withColumn("toxic", F.when(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull(), ((F.col("doc_id") - 2000) % 3 == 0).cast("int")))
    out = toxicity.score(df, toxicity.fit(df, labels)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) + len(ROWS) and all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    new = [r for r in out if (r.doc_id or 0) >= 2000]
    assert all(r.predicted == int((r.doc_id - 2000) % 3 == 0) for r in new if r.held) and any(r.held for r in new)
    r = next(r for r in new if r.predicted)
    assert all(r.text[int(a) : int(b)].split()[0] in bad for a, b in (s.split(":") for s in r.toxic_spans.split(",")))
    assert len({r.score for r in out if not words(r.text)}) == 1
    # A document that occurs many times is read once, and texts beyond the bound aren't read
    many = df.select("doc_id", "text").unionByName(spark.range(10_000).select((2000 + F.col("id") % 4).alias("doc_id"), F.lit(LONG).alias("text")))
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts, toxic)) or toxicity.Model())
    toxicity.fit(many, labels, sample=50, most=30_000)
    toxicity.fit(many, labels, sample=50)
    assert all(sum(map(len, t)) <= most and len(t) == len(y) for (t, y), most in zip(seen, (30_000, toxicity.CHARACTERS))) and 20 < len(seen[0][0]) <= len(seen[1][0]) <= 100
    monkeypatch.undo()
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0} and toxicity.score(empty, toxicity.Model()).count() == 0


def test_marginals_against_all_paths():
    e, trans = RNG.normal(size=9), RNG.normal(size=(2, 2))
    sizes = np.array([4, 1, 4])
    p = toxicity.Chains(sizes).marginals(e, trans)[0]
    for lo, n in zip((0, 4, 5), sizes):
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        weight = np.array([np.exp(sum(e[lo + i] * y for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        assert np.allclose(p[lo : lo + n], (np.array(paths) * weight[:, None]).sum(axis=0) / weight.sum())


def test_urls(spark):
    given = ["http://A.Example.org/es/1?x", "https://example.org/en/12", "http://x.org", "http://x.org/", "http://b.com/de/", "http://b.com/fr/#a", None, "nothing", "http://Bad.net/a/7", "http://good.net/a/8", "http://notexample.org/es/1"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit("clash"))
    more = spark.createDataFrame([(100 + k, f"http://{'bad' if k % 2 else 'good'}.net/{k}") for k in range(200)], "page_id long, url string").withColumn("host", F.lit(""))
    labels = more.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("toxic"), (F.col("page_id") % 2 == 0).cast("int").alias("quality")).withColumn("bad", F.when(F.col("quality") == 0, 1).otherwise(0)).select(F.col("doc_id").alias("page_id"), "bad")
    out = {r.page_id: r for r in urls.judge(pages.unionByName(more), labels).collect()}
    assert [(out[k].host, out[k].path, out[k].rule, out[k].verdict) for k in range(len(given))] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("x.org", "/", "org/", "allow"),
        ("b.com", "/de/", "com/de/", "block"), ("b.com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("bad.net", "/a/7", None, "block"), ("good.net", "/a/8", None, "allow"),
        ("notexample.org", "/es/1", "org/", "allow"),
    ]
    assert urls.judge(pages.limit(0), labels.limit(0)).count() == 0 and urls.judge(pages, labels.limit(0)).filter("rule is null and verdict = 'block'").count() == 0


def test_urls_take_repeated_pages_null_ids_and_clashing_names(spark):
    """A page that occurs twice counts twice, and rows without an id count for nothing but are judged; names that the operator uses itself change nothing."""
    pages = [(k, f"http://{'bad' if k % 4 else 'good'}.net/{k}") for k in range(24)]
    given = pages + pages + [(None, "http://bad.net/x"), (None, None), (500, "http://new.net/")]
    bad = [(k, int(k % 4 > 0)) for k in range(24)] + [(None, 1), (700, 0), (3, None), (4, 0)]
    names = ("host", "path", "rule", "verdict", "bad", "n", "prior", "strength", "mean", "over", "suffix", "domain", "bad_share", "bad_probability", "_all")
    plain, labels = spark.createDataFrame(given, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")
    clash = lambda df: df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})
    got = urls.judge(clash(plain), clash(labels)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, urls.judge(plain, labels).collect())) and len(got) == len(given)
    assert Counter(r.page_id for r in got) == Counter(k for k, _ in given)
    of = lambda rows, known: {r.host: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), known).collect()}
    twice, apart = of(pages + pages, labels), of(pages + [(k + 1000, u) for k, u in pages], labels.unionByName(labels.select(F.col("page_id") + 1000, "bad").toDF("page_id", "bad")))
    assert all(twice[h].bad_probability == apart[h].bad_probability for h in twice) and twice["bad.net"].verdict == "block" and twice["good.net"].verdict == "allow"
    assert {r.verdict for r in got if r.page_id is None and r.host == "bad.net"} == {"block"} and {(r.host, r.path) for r in got if r.page_id is None} == {("bad.net", "/x"), ("", "")}


def test_posterior_probability(spark):
    def brute(mean, n, limit, cells=200_000):
        """Mass of the beta density over the limit, summed over cells."""
        x = (np.arange(cells) + 0.5) / cells
        log = (mean * n - 1) * np.log(x) + ((1 - mean) * n - 1) * np.log1p(-x)
        w = np.exp(log - log.max())
        return w[x > limit].sum() / w.sum()

    cases = [(m, n, t) for m in (0.1, 0.4, 0.5, 0.55, 0.9) for n in (12.0, 30.0, 300.0, 5_000.0, 9_999.0, 20_000.0) for t in (0.3, 0.5)]
    for limit in (0.3, 0.5):
        mine = [(m, n) for m, n, t in cases if t == limit]
        got = spark.createDataFrame(mine, "m double, n double").select("m", "n", urls.probability_over(F.col("m"), F.col("n"), limit).alias("p")).collect()
        assert all(abs(r.p - brute(r.m, r.n, limit)) < 2e-3 for r in got)
    # No size is treated differently: around 10,000 pages, and where the normal distribution is as good as exact
    near = spark.createDataFrame([(0.51, float(n)) for n in range(9_990, 10_010)], "m double, n double").select("n", urls.probability_over(F.col("m"), F.col("n"), 0.5).alias("p")).orderBy("n").collect()
    assert all(0 < y.p - x.p < 1e-5 for x, y in itertools.pairwise(near))
    for n in (1e7, 1e9):
        shares = [0.5 + z * 0.5 / math.sqrt(n) for z in (-3.0, -1.6, 0.0, 0.5, 1.6449, 3.0)]
        got = spark.createDataFrame([(m, n) for m in shares], "m double, n double").select("m", urls.probability_over(F.col("m"), F.col("n"), 0.5).alias("p")).collect()
        assert all(abs(r.p - 0.5 * math.erfc(-(r.m - 0.5) / math.sqrt(r.m * (1 - r.m) / n) / math.sqrt(2))) < 2e-4 for r in got)
    edge = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0)], "m double, n double").select(urls.probability_over(F.col("m"), F.col("n"), 0.5).alias("p")).collect()
    assert [r.p for r in edge] == [0.0, 1.0]


def test_registered_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.shop.co.uk", "shop.co.uk", "co.uk", "a.b.com", "b.com", "com", "")], "host string")
    assert [(r.suffix, r.domain) for r in hosts.select(*[c.alias(k) for k, c in urls._names(F.col("host"), urls.SUFFIXES).items()]).collect()] == [
        ("co.uk", "shop.co.uk"), ("co.uk", "shop.co.uk"), ("co.uk", "co.uk"), ("com", "b.com"), ("com", "b.com"), ("com", "com"), ("", ""),
    ]


def test_token_counts(docs, empty):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})
    df = docs.select("doc_id", F.when(F.col("doc_id") == 4, "a\n\n\n b🙂🙂c\n").otherwise(F.col("text")).alias("text"))
    texts = {r.doc_id: r.text or "" for r in df.filter("doc_id is not null").collect()}
    for rule in tokens.RULES:
        rows = tokens.count_tokens(df.dropDuplicates(["doc_id"]), path, pattern, rule=rule).collect()
        sums = defaultdict(float)
        for r in rows:
            sums[r.doc_id] += r.n_tokens
        assert all(abs(sums[i] - len(encoder.encode_ordinary(t))) < 1e-6 for i, t in texts.items())
    four = tokens.count_tokens(df.filter("doc_id = 4"), path, pattern, rule="split").orderBy("section").collect()
    assert [(r.start, r.end) for r in four] == [(0, 2), (2, 3), (3, 4), (4, 10)]
    named = df.filter("doc_id = 5").withColumn("parts", F.array(F.struct(F.lit(2).alias("start"), F.lit(30).alias("end"))))
    got = tokens.count_tokens(named, path, pattern, "parts").collect()
    assert [r.section for r in got] == [None, 0, None] and sum(r.n_tokens for r in got) == len(encoder.encode_ordinary(texts[5]))
    # Each token's bytes share it; sections cut through words
    cut = [(0, 3), (3, 4), (9, 17)]
    for rule in tokens.RULES:
        given = df.filter("doc_id = 5").withColumn("parts", F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in cut]))
        got = {r.start: r.n_tokens for r in tokens.count_tokens(given, path, pattern, "parts", rule).collect()}
        want, at, borders = defaultdict(float), 0, [0, 3, 4, 9, 17, len(texts[5])]
        for k in encoder.encode_ordinary(texts[5]):
            n = len(encoder.decode_bytes([k]))
            held = [(sum(a <= i < b for i in range(at, at + n)), a) for a, b in zip(borders, borders[1:])]
            held = [(c, a) for c, a in held if c]
            if rule == "split":
                for c, a in held:
                    want[a] += c / n
            else:
                want[held[0][1] if rule == "first" else max(held, key=lambda h: (h[0], -h[1]))[1]] += 1
            at += n
        assert all(got[a] == pytest.approx(want[a]) for a in borders[:-1])
    assert tokens.count_tokens(empty, path, pattern).count() == 0


def test_bpe_takes_long_pieces():
    """Ids of pieces without any blank, of all lengths, equal the library's; 100,000 letters and 20,000 CJK characters are done in seconds."""
    import random
    import struct

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec, library = bpe.Codec(path, public_tokenizers.PATTERN), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(3)
    parts = [t.decode() for t in codec.ranks if t.isalpha() and len(t) > 1 and t.isascii()]
    drawn = (lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)), lambda n: "".join(rng.choices(parts, k=n // 4)), lambda n: "ab" * (n // 2) + "c", lambda n: "e" * n, lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n)))
    texts = [drawn[k % 5](rng.randint(1, 900)) for k in range(250)]
    began = time.perf_counter()
    texts += [drawn[0](100_000), drawn[4](20_000), drawn[3](100_001)]
    for text, (ids, back) in zip(texts, codec(texts), strict=True):
        want = library.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(want)}I", *want) and back == text.encode()
    assert time.perf_counter() - began < 60


def test_bpe_joins_blocks_that_share_no_token():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    piece = bytes(97 + k * k % 25 for k in range(180))
    known = {piece[a:b]: np.frombuffer(codec.contract([piece[a:b]], False)[0][0], np.uint32) for a, b in ((0, 96), (48, 144), (96, 180))}
    assert codec.join(piece, [(0, 96), (48, 144), (96, 180)], known)[1] == [(0, 180)]
    strange = known | {piece[48:144]: np.array([codec.ranks[b"z"]] * 96, np.uint32)}
    assert codec.join(piece, [(0, 96), (48, 144), (96, 180)], strange)[1] == [(0, 180)]  # contracted as one in the next round
