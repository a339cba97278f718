"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.llm import suffixes


def brute(rows, length):
    """Bytes that go, from the contract: rows of (id, copy, bytes) in order, each once."""
    seen, out = {}, {}
    for key, data in sorted(rows.items()):
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            else:
                seen[data[i : i + length]] = 1
        out[key] = gone
    return out


def spans(gone):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
    return [tuple(x) for x in edges.reshape(-1, 2).tolist()]


def check(spark, texts, length, kmer, block, parts=3):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: r for r in suffixes.drop_repeats(df, length, kmer, block).collect()}
    assert set(got) == set(texts)
    for i, gone in brute({i: (t or "").encode() for i, t in texts.items()}, length).items():
        data = (texts[i] or "").encode()
        assert [tuple(s) for s in got[i]["spans"]] == spans(gone), i
        assert bytes(got[i]["kept"]) == bytes(b for b, g in zip(data, gone, strict=True) if not g)
        assert got[i]["n_bytes"] == len(data)


def corpus(seed, n, alphabet):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randint(60, 400)) for _ in range(6)]
    out = {}
    for i in rng.sample(range(10 * n), n):
        kind = rng.random()
        text = "".join(rng.choice(passages) if rng.random() < 0.3 else word(rng.randint(1, 200)) for _ in range(rng.randint(1, 5)))
        if kind < 0.2 and out:
            text = rng.choice([t for t in out.values() if t is not None])  # a copy, or one with a letter changed
            if text and kind < 0.1:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice(alphabet) + text[k + 1 :]
        elif kind < 0.25:
            text = rng.choice(["", "x", None])
        elif kind < 0.3:
            text = rng.choice("ab") * rng.randint(50, 300)
        out[i] = text
    return out


@pytest.mark.parametrize(("seed", "alphabet", "length", "kmer", "block"), [(1, "abcdefghij ", 100, 32, 2048), (2, "ab", 20, 8, 4), (3, "aąβ𝄞b\0 ", 33, 9, 3), (4, "abc", 100, 32, 2)])
def test_equals_brute_force(spark, seed, alphabet, length, kmer, block, monkeypatch):
    if block < 10:
        monkeypatch.setattr(suffixes, "FEW", 5)  # so that anchors are salted
    check(spark, corpus(seed, 60, alphabet), length, kmer, block)


def test_slices_and_tasks_change_nothing(spark):
    """A text of many slices, in which a passage lies across a border, and runs that are brought together in small groups; workers import the module, so their limits are those of production."""
    rng = random.Random(5)
    own = "".join(rng.choice("abcdefgh") for _ in range(2 * suffixes.SLICE + 500))
    inside = own[suffixes.SLICE - 300 : suffixes.SLICE + 300]
    check(spark, {7: own, 3: inside, 9: inside[:150] + "x" + inside[150:], 8: own[-120:] + own[:130]}, 100, 32, 2048, parts=2)


def test_runs_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(1)
    data, at = rng.integers(97, 100, 5000).astype(np.uint8), np.array([0, 1200, 1290, 4000, 5000])
    whole = suffixes.runs(data, at[:-1], at[1:], 100, 32)
    monkeypatch.setattr(suffixes, "SLICE", 77)
    for a, b in zip(whole, suffixes.runs(data, at[:-1], at[1:], 100, 32), strict=True):
        assert (a == b).all()


def test_previous_factors():
    for seed in range(20):
        rng = random.Random(seed)
        text = "".join(rng.choice("ab" if seed % 2 else "a") for _ in range(rng.randint(1, 40)))
        order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
        shared = lambda i, j: next((k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), len(text))  # noqa: B023, E731
        lcp = np.array([0] + [shared(i, j) for i, j in zip(order[1:], order[:-1], strict=True)])
        want = [max((shared(i, j) for j in range(i)), default=0) for i in range(len(text))]
        assert suffixes.previous_factors(order, lcp).tolist() == want


def test_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(150)) for _ in range(2))
    rows = [(1, a, "x"), (1, a, "y"), (None, a, "z"), (2, b, "v"), (2, b + a, "w"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").withColumns({"copy": F.lit("c"), "kept": F.lit(1), "spans": F.lit(2)})
    got = suffixes.digests(suffixes.drop_repeats(df)).collect()
    assert len(got) == 6
    assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [0, 0]  # rows that are equal are one document
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [150]  # no id is smaller than none
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 2) in ([0, 300], [150, 150])  # whichever text comes first
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] == 5] == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]
    assert suffixes.drop_repeats(df.limit(0)).count() == 0
