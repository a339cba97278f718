"""Token sequences for training: documents become pieces of at most a sequence's length, and vector best-fit packs the pieces.

Each open sequence has residual capacities of tokens, documents and attention cost (the sum of squared piece lengths). Pieces come longest first; of the
sequences that fit under every constraint, one takes the piece: the one whose residual vector, after it, has the least weighted norm, or the one with the largest
weighted dot product of demand and residual. As few sequences as possible are asked for, so the defaults of the other two capacities are those that a full sequence
of tokens implies: they only weigh in the score there, and bind where a caller lowers them.

Defined results: null and empty texts are one piece with the end token alone. Repeated rows are packed as often as they occur. A null id is kept. An empty table
gives an empty result. Other columns of the input are not read. Documents are never dropped or shortened; only those longer than a sequence are cut. Ids are those of the
tokenizers library without special tokens added; where a text holds the string of an added token, that library gives its id, and so does this.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import holding, stored, tidy

LENGTH = 2048
SHARD = 8192  # pieces that are packed together
BLOCK = 1_000_000  # bytes of text whose words are looked at together
KNOWN = 16_000_000  # bytes of words and ids beyond which a worker forgets those that a block doesn't hold
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: The rules of a vocabulary file under which words between blanks don't touch each other and SPLIT cuts as the file does.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters beyond which a word is left to the whole tokenizer: for the others, the case folding and the split by classes are plain.
RARE = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t-\r {LETTERS}0-9]+")


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    own = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _understood(spec: dict) -> bool:
    """Whether the rules of a file are those that Words works by."""
    steps, model = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], spec["model"]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and steps[0].get("pattern") == {"Regex": PATTERN} and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed"
        and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


class Words:
    """Ids of a vocabulary with word ends. Words between blanks don't touch each other, so each distinct one of a block of texts is looked up once, and its ids are dealt to its
    places by array operations. Known words are one string array, and their ids one number array; only new words become Python strings. The parts of plain words go to the library's
    merges many at a time; words with rare characters or an added token's string go to the whole tokenizer, and so do whole texts where the file's rules are others."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = _understood(spec)
        self.odd = re.compile("|".join([RARE.pattern, *(re.escape(t["content"]) for t in spec["added_tokens"])]))
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.sizes = np.zeros(0, np.int32)
        if self.plain:
            self.merges = Tokenizer(self.tokenizer.model)  # the same tables
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[k for t, k in vocab.items() if t.endswith(end)]] = True
            self.letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})

    def _parts(self, words: set[str]) -> dict[str, bytes]:
        """Ids of lower-case words that the merges take as they are."""
        out, words = {}, list(words)
        for i in range(0, len(words), 10_000):
            some = words[i : i + 10_000]
            text = " ".join(some).encode().decode("latin-1").translate(self.letters).replace(self.letters[32], " ")
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out.update(zip(some, (raw[a:b] for a, b in zip([0, *cuts], cuts)), strict=True))
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        odd = self.odd.search
        other = [w for w in words if odd(w)]
        of = {}
        for i in range(0, len(other), 1000):
            some = other[i : i + 1000]
            of.update(zip(some, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        cut = [() if w in of else (w.lower(),) if w.isalpha() else SPLIT.findall(w.lower()) for w in words]
        get = self._parts(set().union(*cut)).__getitem__
        return [of[w] if w in of else get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for w, x in zip(words, cut, strict=True)]

    def _places(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words among those known, when new ones are learnt."""
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        there = at >= 0
        fresh = words.filter(pa.array(~there))
        if len(fresh):
            if self.known.nbytes + self.flat.nbytes + self.sizes.nbytes > KNOWN:  # only words of this block stay
                kept = at[there]
                self.flat = _dealt(self.flat, self.sizes, kept)
                self.known, self.sizes = self.known.take(pa.array(kept)), self.sizes[kept]
                at[there] = np.arange(len(kept))
            ids = self._learn(fresh.to_pylist())
            at[~there] = len(self.known) + np.arange(len(ids))
            self.known = pa.concat_arrays([self.known, fresh.cast(pa.string())])
            self.sizes = np.concatenate([self.sizes, np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        return at

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if not self.plain:
            ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(x) for x in ids], np.int64)
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        at = self._places(words.dictionary)[words.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.sizes[at], dtype=np.int64)])
        return _dealt(self.flat, self.sizes, at), np.diff(ends[split.offsets.to_numpy()])


def _dealt(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat holds stretches of these sizes one after the other; those at the given places, one after the other."""
    n = sizes[at].astype(np.int64)
    shift = (np.cumsum(sizes, dtype=np.int64) - sizes)[at] - (np.cumsum(n) - n)
    return flat[np.arange(n.sum()) + np.repeat(shift, n)]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Words(path)


holding("packing", _encoder.cache_clear)


def _in_parts(text: str, most: int = BLOCK) -> Iterator[str]:
    """A long text cut at blanks, which are left out, into parts of about most characters."""
    at = 0
    while at < len(text):
        ends = [k for k in (text.find(" ", at + most), text.find("\n", at + most)) if k >= 0]
        yield text[at : min(ends, default=len(text))]
        at = min(ends, default=len(text)) + 1


def _encoded(words: Words, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row of a block of texts, their ids one after the other, and how many each has."""
    sizes = pc.binary_length(texts).to_numpy()
    block = np.cumsum(sizes) // BLOCK
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        long = np.flatnonzero(sizes[lo:hi] > BLOCK) + lo if words.plain else []
        for a, b in zip([lo, *(x for i in long for x in (i, i + 1))], [*(x for i in long for x in (i, i + 1)), hi], strict=True):
            if a < b and a in long:
                ids = np.concatenate([words(pa.array([part]))[0] for part in _in_parts(texts[int(a)].as_py())])
                yield a, ids, np.array([len(ids)], np.int64)
            elif b > a:
                yield a, *words(texts.slice(a, b - a))


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end token, cut where there are more than length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy("packing")
        last = end.to_bytes(4, "little")
        for b in batches:
            texts = b.column("text").fill_null("")
            for first, ids, n in _encoded(_encoder(path), texts):
                many = -(-(n + 1) // length)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                lo = np.repeat(np.cumsum(n) - n, many) + piece * length
                size = np.minimum(length, n[row] + 1 - piece * length)
                closes = piece == many[row] - 1
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(last, zlib.crc32(raw[4 * x : 4 * (x + k - 1)])) if c else zlib.crc32(raw[4 * x : 4 * (x + k)]) for x, k, c in zip(lo.tolist(), size.tolist(), closes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row + first)), pa.array(piece, pa.int32()), pa.array(piece * length, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        tidy("packing")

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, length: int, max_docs: int, max_cost: float, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Of each piece: its sequence (from 0) and its offset there."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    w = np.asarray(weights, float)
    cap = np.array([length, max_docs, max_cost], float)
    least = lengths.min() if len(lengths) else 0
    ids, rest = np.empty(len(lengths), np.int64), np.empty((3, len(lengths)))  # open sequences and their residual shares of capacity
    n = made = 0
    for i in order:
        size = int(lengths[i])
        demand = np.array([size, 1, float(size) ** 2]) / cap
        if demand.max() > 1 + 1e-12:
            raise ValueError("a piece is over the capacity of an empty sequence")
        after = rest[:, :n] - demand[:, None]
        fits = after.min(axis=0) >= -1e-12 if n else np.zeros(0, bool)
        if fits.any():
            score = -(w @ (after * after)) if rule == "norm" else (w * demand) @ rest[:, :n]
            at = int(np.argmax(np.where(fits, score, -np.inf)))
        else:
            at, ids[n], rest[:, n] = n, made, 1.0
            n, made = n + 1, made + 1
        sequence[i], offset[i] = ids[at], round((1 - rest[0, at]) * length)
        rest[:, at] -= demand
        if rest[0, at] * length < least - 0.5 or rest[1:, at].min() <= 1e-12:  # full: the last open one takes its place
            n -= 1
            ids[at], rest[:, at] = ids[n], rest[:, n]
    return sequence, offset


def pack(parts: DataFrame, length: int = LENGTH, max_docs: int = LENGTH, max_cost: float = float(LENGTH) ** 2, shard: int = SHARD, rule: str = "norm") -> DataFrame:
    """parts with sequence_id and offset. Rows are dealt evenly to tasks of about shard pieces; a task packs what it has, so sequences never span tasks."""
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            rows = pd.concat(rows, ignore_index=True)
            sequence, offset = best_fit(rows["length"].to_numpy(), length, max_docs, max_cost, rule=rule)
            yield rows.assign(sequence_id=sequence + (TaskContext.get().partitionId() << 32), offset=offset)

    n = max(1, round(parts.count() / shard))
    return parts.repartition(n).mapInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(stored(pieces(docs, path, length), "pieces"), length, **how)
