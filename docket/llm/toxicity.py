"""Toxicity of documents by a linear-chain conditional random field over their words.

Only documents are labelled. So words are labelled first: a feature of words (the word, its first four to eight letters, its last four) that far more toxic than
clean documents hold marks its words as toxic in the toxic ones. The field is fitted to these labels, with a chain for each line; forward-backward marginals then give
each word its probability. A document's score is a logistic function of its largest marginal and of the sum of its marginals, fitted to the labels of documents.
The fit reads at most SAMPLE labelled documents of each class, those with the smallest hashes of their ids whose texts fit into CHARACTERS, and never held-out ones. Scores see
nothing but the text.

Defined results: null and empty texts have no words and the score of a text without any suspicion. Held out is a document whose crc32 of the id as text leaves 1 when divided by
3; a null id isn't. Repeated label rows count as one, toxic if any says so; null labels don't count. Repeated documents are scored alike; of different
texts with one id the fit reads the smallest. Where a class has no labelled document, every score is 0. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, tidy

SAMPLE = 1000  # documents of each class that the fit reads
CHARACTERS = 8_000_000  # of all texts that the fit reads; half of them for each class
THRESHOLD = 0.7
G_LEAST, RATIO_LEAST = 20.0, 3.0  # of a feature that marks words
ROUNDS, RATE, RIDGE = 40, 0.3, 1e-4
FEATURES = 7
SLIGHT = 0.02  # weights below this go
KNOWN = 150_000  # words that a worker remembers
EDGES = "\"'`.,;:!?()[]{}<>*#$%&-_…«»¡¿“”„’‘"
FLAT = 30.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: str) -> list[str]:
    w = word.lower().strip(EDGES)
    return [f"w{w}"] + [f"{k}{w[:k]}" for k in (4, 5, 6, 7, 8) if len(w) >= k] + ([f"s{w[-4:]}"] if len(w) > 4 else []) if w else []


def split_lines(text: str) -> list[list[str]]:
    return [words for line in text.split("\n") if (words := line.split())]


class Chains:
    """Lines of words, looked at step by step side by side: words holds their places line after line, sizes how many each line has."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        self.steps = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(self.steps), "left")  # lines longer than each step
        self.starts = starts

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.active[t]] + t

    def marginals(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each word; and the logs of the forward and backward ratios. e: log-odds of each word alone; trans: 2 x 2."""
        (a00, a01), (a10, a11) = np.exp(trans)
        ahead, behind = np.zeros(len(e)), np.zeros(len(e))
        e = np.clip(e, -FLAT, FLAT)
        r = np.zeros(0)
        for t in range(self.steps):
            at = self.at(t)
            if t == 0:
                r = e[at]
            else:
                x = np.exp(r[: len(at)])
                r = np.clip(e[at] + np.log((a01 + a11 * x) / (a00 + a10 * x)), -FLAT, FLAT)
            ahead[at] = r
        b = np.zeros(0)
        for t in range(self.steps - 1, -1, -1):
            at = self.at(t)
            new = np.zeros(len(at))
            if len(b):
                x = np.exp(np.clip(e[self.at(t + 1)] + b, -FLAT, FLAT))
                new[: len(b)] = np.log((a10 + a11 * x) / (a00 + a01 * x))
            behind[at] = b = new
        return 1 / (1 + np.exp(-(ahead + behind))), ahead, behind

    def pairs(self, e: np.ndarray, ahead: np.ndarray, behind: np.ndarray, trans: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Expected transitions between the places first and second, which follow them."""
        a, x, y = np.exp(trans), np.exp(ahead[first]), np.exp(np.clip(e[second] + behind[second], -FLAT, FLAT))
        each = np.stack([np.full(len(x), a[0, 0]), a[0, 1] * y, a[1, 0] * x, a[1, 1] * x * y])
        return (each / each.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class Model:
    """Weights of features, bias and transitions of the field, and the document's logistic function."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray | None = None
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def word(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def emissions(self, words: list[str]) -> np.ndarray:
        some = set(words)
        fresh = some - self.known.keys()
        if len(self.known) + len(fresh) > KNOWN:
            self.known = {w: self.known[w] for w in some & self.known.keys()}
        self.known.update((w, self.word(w)) for w in fresh)
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of the texts, and the number of words of each text."""
        lines = [split_lines(t) for t in texts]
        sizes = np.array([len(line) for doc in lines for line in doc], np.int64)
        e = self.emissions([w for doc in lines for line in doc for w in line])
        p = Chains(sizes).marginals(e, self.trans)[0] if len(e) else np.zeros(0)
        return p, np.array([sum(map(len, doc)) for doc in lines], np.int64)

    def suspicion(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the document's function sees: the log-odds of the largest marginal, the logs of their sum and of the number of words, 1."""
        out = np.tile([-10.0, 0.0, 0.0, 1.0], (len(n), 1))
        out[:, 2] = np.log1p(n) / 4
        some = np.flatnonzero(n)
        if len(some):
            at = (np.cumsum(n) - n)[some]
            top = np.clip(np.maximum.reduceat(p, at), 5e-5, 1 - 5e-5)
            out[some, 0], out[some, 1] = np.log(top / (1 - top)), np.log1p(np.add.reduceat(p, at))
        return out

    def score(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.zeros(len(n)) if self.doc is None else 1 / (1 + np.exp(-self.suspicion(p, n) @ self.doc))


def _distinct(texts: list[str]) -> np.ndarray:
    """Which texts don't share most of their words with an earlier one: copies would each count as a witness."""
    factors = np.random.default_rng(3).integers(1, 2**31, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.empty((len(texts), 32), np.uint64)
    for k, text in enumerate(texts):
        codes = np.array([zlib.crc32(w.encode()) for w in set(text.split())] or [1], np.uint64)
        least[k] = (codes[:, None] * factors % np.uint64(4294967291)).min(axis=0)
    return np.array([not k or (least[:k] == least[k]).sum(axis=1).max() < 16 for k in range(len(texts))], bool)


def _marks(texts: list[str], toxic: np.ndarray) -> set[str]:
    """Features that far more toxic than clean documents hold."""
    own = _distinct(texts)
    texts, toxic = [t for t, k in zip(texts, own, strict=True) if k], toxic[own]
    counts = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        counts[int(y)].update({f for w in set(text.split()) for f in features(w)})
    n1, n0 = toxic.sum(), (~toxic).sum()
    marks = set()
    for f, k1 in counts[1].items():
        k0 = counts[0][f]
        share = (k0 + k1) / (n0 + n1)
        g = 2 * (k1 * np.log(k1 / n1 / share) + (k0 * np.log(k0 / n0 / share) if k0 else 0)) if k1 / n1 > share else 0
        if g >= G_LEAST and k1 / n1 >= RATIO_LEAST * (k0 + 0.5) / n0:
            marks.add(f)
    return marks


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """The field and the document's function from whole labelled texts."""
    model = Model()
    if not toxic.any() or toxic.all():
        return model
    marks = _marks(texts, toxic)
    lines = [split_lines(t) for t in texts]
    kinds: dict[str, int] = {}
    words = np.array([kinds.setdefault(w, len(kinds)) for doc in lines for line in doc for w in line], np.int64)
    sizes = np.array([len(line) for doc in lines for line in doc], np.int64)
    n = np.array([sum(map(len, doc)) for doc in lines], np.int64)
    held = Counter(f for w in kinds for f in features(w))
    index: dict[str, int] = {}
    of = np.zeros((len(kinds), FEATURES), np.int64)  # 0 stands for none
    marked = np.zeros(len(kinds), bool)
    for w, k in kinds.items():
        own = features(w)
        marked[k] = any(f in marks for f in own)
        for i, f in enumerate(f for f in own if held[f] > 1 or f in marks):
            of[k, i] = index.setdefault(f, len(index) + 1)
    y = marked[words] & np.repeat(toxic, n)
    ends = np.cumsum(sizes)
    first = np.setdiff1d(np.arange(len(words)), ends - 1)
    chains = Chains(sizes)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[first].astype(int), y[first + 1].astype(int)), 1)
    theta, bias, trans = np.zeros(len(index) + 1), -5.0, np.zeros((2, 2))
    moments = [np.zeros(len(theta) + 5), np.zeros(len(theta) + 5)]
    for k in range(1, ROUNDS + 1):
        e = np.clip((theta[of].sum(axis=1) + bias)[words], -FLAT, FLAT)
        p, ahead, behind = chains.marginals(e, trans)
        wrong = np.bincount(words, p - y, len(kinds))
        grad = np.bincount(of.ravel(), np.repeat(wrong, FEATURES), len(theta)) + RIDGE * len(words) * theta / 1000
        grad[0] = 0
        both = np.concatenate([grad, [wrong.sum()], (chains.pairs(e, ahead, behind, trans, first, first + 1) - seen + RIDGE * len(words) * trans / 1000).ravel()])
        moments = [0.9 * moments[0] + 0.1 * both, 0.99 * moments[1] + 0.01 * both**2]
        step = RATE * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-8)
        theta, bias, trans = theta - step[: len(theta)], bias - step[len(theta)], trans - step[len(theta) + 1 :].reshape(2, 2)
    theta[np.abs(theta) < SLIGHT] = 0
    model.weights = {f: float(theta[i]) for f, i in index.items() if theta[i]}
    model.bias, model.trans = float(bias), trans
    x = model.suspicion(chains.marginals(np.clip((theta[of].sum(axis=1) + bias)[words], -FLAT, FLAT), trans)[0], n)
    doc = np.zeros(4)
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-x @ doc))
        doc = doc - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (q - toxic) + 0.05 * doc)
    model.doc = doc
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = CHARACTERS) -> Model:
    """A model from at most sample documents of each class, whose texts have at most the given number of characters together; only these texts come to the driver."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id")
    picked = [r for y in (0, 1) for r in known.filter(F.col("toxic") == y).orderBy(rank, "doc_id").limit(sample).collect()]
    if not picked:
        return Model()
    spark, schema = docs.sparkSession, "doc_id long, toxic int, place int"
    chosen = spark.createDataFrame([(r.doc_id, r.toxic, k) for k, r in enumerate(picked)], schema)  # at most 2 * sample rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stored(rows.groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text")), "sample")  # a row for each id, however often it occurs
    left, fit_ids = [most / 2, most / 2], []
    for r in sorted(rows.select("place", "doc_id", "toxic", F.length("text").alias("n")).collect()):
        if r.n <= left[r.toxic]:
            left[r.toxic] -= r.n
            fit_ids.append((r.doc_id,))
    texts = rows.join(F.broadcast(spark.createDataFrame(fit_ids, "doc_id long")), "doc_id").orderBy("doc_id").collect()
    return train([r.text for r in texts], np.array([bool(r.toxic) for r in texts], bool))


_WORD = re.compile(r"\S+")


def offending(text: str, p: np.ndarray, least: float = 0.5) -> str:
    """start:end of each run of words with at least this marginal, comma-joined; code points, end exclusive."""
    out, last = [], -2
    for k, m in enumerate(_WORD.finditer(text)):
        if p[k] >= least:
            if last == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([*m.span()])
            last = k
    return ",".join(f"{a}:{b}" for a, b in out)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score, predicted and toxic_spans."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        model = given.value
        for b in batches:
            texts = [t or "" for t in b["text"]]
            part = np.cumsum([len(t) for t in texts]) // 1_000_000  # characters that are looked at together
            scores, found = [], []
            for k in np.unique(part):
                some = [texts[i] for i in np.flatnonzero(part == k)]
                p, n = model.words(some)
                scores.append(model.score(p, n))
                cuts = np.concatenate([[0], np.cumsum(n)])
                found += [offending(t, p[x:y]) if (p[x:y] >= 0.5).any() else "" for t, x, y in zip(some, cuts[:-1], cuts[1:], strict=True)]
            if scores:
                scores = np.concatenate(scores)
                yield b.assign(score=scores, predicted=(scores >= threshold).astype("int32"), toxic_spans=found)
        model.known.clear()
        tidy()

    names = [c for c in docs.columns if c not in ("score", "predicted", "toxic_spans")]
    docs = docs.select(*names)
    return docs.mapInPandas(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in (("score", T.DoubleType()), ("predicted", T.IntegerType()), ("toxic_spans", T.StringType())))]))
