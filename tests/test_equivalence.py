"""Rulings that came by two channels."""

import random

from pyspark.sql import functions as F

from docket.operators import equivalence


def test_planted_pairs_are_found(spark):
    """Copies with one word in fifty changed, laid out otherwise: all of 120 are proposed (recall 1.0), none of the 120 others with the same number is."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        near = [w if rng.random() > 0.02 else "changed" for w in text]
        rows += [("a", f"a{k}", [f"KIO {k}/24"], " ".join(text)), ("b", f"b{k}", [f"KIO {k}/24", "KIO 999/23"], " \n ".join(near)), ("b", f"x{k}", [f"KIO {k}/24"], " ".join(rng.choice(words) for _ in text))]
    rows += [("a", "a-empty", ["KIO 500/24"], None), ("b", "b-empty", ["KIO 500/24"], ""), ("a", "a-none", None, "text")]
    docs = spark.createDataFrame(rows, "channel string, doc_id string, numbers array<string>, text string")
    pairs = equivalence.proposals(docs)
    got = {(r["doc_a"], r["doc_b"]): r["alike"] for r in pairs.collect()}
    assert len(got) == 241 and {p for p, alike in got.items() if alike} == {(f"a{k}", f"b{k}") for k in range(120)}
    none = spark.createDataFrame([], equivalence.DECISIONS)
    assert equivalence.undecided(pairs, none).count() == 241 and equivalence.equivalent(none).count() == 0
    some = spark.createDataFrame([("a1", "b1", True, "me", "2024-01-01"), ("a2", "b2", True, "me", "2024-01-01"), ("a2", "b2", False, "you", "2024-01-02")], equivalence.DECISIONS)
    assert equivalence.undecided(pairs, some).count() == 239 and [tuple(r) for r in equivalence.equivalent(some).collect()] == [("a1", "b1")]


def test_likeness_estimates_jaccard(spark):
    left, right = " ".join(f"w{k}" for k in range(300)), " ".join(f"w{k}" for k in range(100, 400))
    docs = spark.createDataFrame([("a", "1", ["n"], left), ("b", "2", ["n"], right)], "channel string, doc_id string, numbers array<string>, text string")
    assert abs(equivalence.proposals(docs).first()["likeness"] - 198 / 398) < 3 / (2 * equivalence.SIGNATURE**0.5)


def test_signatures_equal_those_of_columns(spark):
    texts = [None, "", "..", "one", "a b", "a b c a b c", "Ala ma kota, a kot ma Alę i PSA " * 3, " ".join(map(str, range(40_000)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).select("k", equivalence.shingles(F.col("t")).alias("s"))
    least = F.transform(F.sequence(F.lit(1), F.lit(equivalence.SIGNATURE)), lambda k: F.array_min(F.transform("s", lambda h: F.xxhash64(h, k))))
    want = {r.k: r.s for r in rows.select("k", F.when(F.col("s").isNotNull(), least).alias("s")).collect()}
    assert {r.k: r.s for r in equivalence.signed(rows, "s").collect()} == want and want[0] is None and len(want[3]) == equivalence.SIGNATURE


def test_signatures_are_no_nested_expressions(spark):
    docs = spark.createDataFrame([("a", "a1", ["1"], "x"), ("b", "b1", ["1"], "x")], "channel string, doc_id string, numbers array<string>, text string")
    plan = equivalence.proposals(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_min" not in plan
