"""Filter interactions and source divergence against versions without Spark."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.llm import divergence, interactions

LETTERS = "ABCDE"


def fails(text, later):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), later]


def brute_audit(docs, labels):
    least, out = {}, collections.defaultdict(collections.Counter)
    for i, text, _ in docs:
        key = float("inf") if i is None else i
        least[text or ""] = min(least.get(text or "", key), key)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = [(lang or "", fails(text or "", i is None and least[text or ""] < float("inf") or i is not None and i > least[text or ""]), i in good, i in toxic) for i, text, lang in docs]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations(range(5)):
            for step, f in enumerate(order, 1):
                x = out[part, "".join(LETTERS[k] for k in order), step]
                for _, bad, q, t in own:
                    before, here = any(bad[k] for k in order[: step - 1]), bad[f]
                    x["kept"] += not before and not here
                    x["removed"] += here and not before
                    x["redundant"] += here and before
                    x["unique_fails"] += here and sum(bad) == 1
                    x["good_lost"] += here and not before and q
                    x["toxic_lost"] += here and not before and t
    total = collections.Counter()
    for (part, order, step), x in out.items():
        total[part, order[step - 1]] += x["removed"]
    return {k: {**x, "shapley": total[k[0], k[1][k[2] - 1]]} for k, x in out.items()}


def a_corpus(seed, n=60):
    rng = random.Random(seed)
    texts = ["", None, "A few WORDS", "one # two", " ".join(f"w{k}" for k in range(250)), " ".join(["same"] * 250), "ABC " * 220, "x\ty\x0bz \U0001d11e | é", " ".join(f"v{k % 120}" for k in range(260))]
    docs = [(rng.choice([None, *range(n)]) if rng.random() < 0.2 else i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(n)]
    rng.shuffle(docs)
    return docs, [(rng.choice([None, rng.randrange(n + 5)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]


def tables(spark, docs, labels, tmp_path, files):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"mask": F.lit("x"), "part": F.lit(1), "n": F.lit(1.5)})
    df.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    return f"{tmp_path}/documents.parquet", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("seed", "files", "batches"), [(1, 6, 3), (2, 1, 4)])
def test_audit_equals_brute_force(spark, tmp_path, seed, files, batches):
    docs, labels = a_corpus(seed)
    got = interactions.audit(spark, *tables(spark, docs, labels, tmp_path, files), batches=batches)
    want = brute_audit(docs, labels)
    rows = {(r["part"], r["filter_order"], r["step"]): {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} for r in got.collect()}
    assert rows == want


def test_audit_retracts_when_smaller_ids_arrive_and_survives_replays(spark, tmp_path):
    """Batches in falling order of ids: each takes the first place from the one before; the last two run twice, as after a loss."""
    docs = [(i, "the same # text", "en") for i in range(9, -1, -1)]
    state = interactions.Audit(spark, f"file://{tmp_path}/audit", spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"), interactions.CONDITIONS)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    firsts = []
    for batch in range(5):
        for _ in range(1 + (batch > 2)):
            state.take(frame(docs[2 * batch : 2 * batch + 2]), batch)
        held = {(r["mask"], r["quality"]): r["n"] for r in state.counters().collect()}
        firsts.append(sum(n for (mask, _), n in held.items() if not mask & 16))
        assert sum(held.values()) == 2 * batch + 2
    assert firsts == [1] * 5
    assert held == {(9, False): 1, (25, False): 8, (25, True): 1}


def test_audit_of_nothing(spark, tmp_path):
    assert interactions.audit(spark, *tables(spark, [], [], tmp_path, 1)).count() == 0


def brute_divergence(docs, held, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= held)
        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        whole, shares = share(sum(counts.values(), collections.Counter())), {s: share(c) for s, c in counts.items()}
        price = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in shares.items():
            pairs = sorted(((-sum(price(p[t], q[t]) for t in kept), o.encode(), o) for o, q in shares.items() if o != s))
            best = sorted((-price(p[t], whole[t]), t.encode(), t) for t in kept if counts[s][t] and p[t] > whole[t])[:top]
            out |= {(lang, s, part, x[2], -x[0], r) for part, rows in (("pair", pairs), ("term", best)) for r, x in enumerate(rows, 1)}
    return out


@pytest.mark.parametrize(("seed", "held", "top", "shard", "block"), [(1, 3, 10, 1024, 32), (2, 2, 2, 4, 2), (3, 1, 3, 8, 1), (4, 1000, 5, 16, 2)])
def test_divergence_equals_brute_force(spark, seed, held, top, shard, block):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "ÉTÉ", "été", "a", "b7c", "x_y", "日本", "𝄞", "naïve", *(f"t{'abcdefghij'[k % 10]}{'klmno'[k // 10]}" for k in range(40))]
    text = lambda: rng.choice([None, "", "123 ---"]) if rng.random() < 0.1 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))
    docs = [(text(), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "Ś", None, "𝄞"])) for _ in range(80)] + [("alone here", "one", "s1"), (None, "none", "s1"), ("", "none", "s2")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"idx": F.lit("x"), "n": F.lit(1), "term": F.lit(2.0)})
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.diverge(df, held, top, shard, block).collect()}
    assert got == brute_divergence(docs, held, top)


def test_divergence_of_nothing_and_of_great_counts(spark):
    assert divergence.diverge(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    counts = [[10**13, 0, 7], [3 * 10**13, 1, 0]]
    totals = np.array([sum(x) for x in counts])
    trees = divergence.Trees(np.array(counts))
    share = lambda g: [1 + 10**9 * (c + 2) // (int(totals[g]) + 6) for c in counts[g]]
    want = sum((p - q) ** 2 // (p + q) for p, q in zip(share(0), share(1), strict=True))
    assert trees.walk(np.array([0]), np.array([1]), totals, 3).tolist() == [want]


def test_equal_subtrees_are_one_node():
    trees = divergence.Trees(np.array([[1, 2, 1, 2, 0, 0, 0, 0], [0, 0, 0, 0, 1, 2, 1, 2], [1, 2, 1, 2, 1, 2, 1, 2]]))
    assert [len(x) for x in trees.children] == [2, 2, 3]  # (1, 2) and (0, 0); two of each; three roots
