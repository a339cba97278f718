"""Token counts of sections, by offsets: a document is encoded once, whole, and each token's span is joined to the sections it meets.

The spans of tokens follow each other through the text, as do sections; so the join of the two lists of intervals is a search of section borders. A token inside one
section counts there. For a token that crosses borders, the rule decides: "most" gives it to the section that holds most of its bytes, the earlier one on a
tie; "first" to the one with its first byte; "split" gives each the share of the bytes it holds.

Defined results: null and empty texts have one empty section. Lines are the sections where none are named; a line ends with its line feed. Characters outside all named
sections form gaps, which take part like sections and come out with a null section. The counts of a document always add up to its tokens. Repeated rows are counted alike.
An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .bpe import ranks
from .common import holding, tidy

SCHEMA = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long"
RULES = ("most", "first", "split")


@functools.lru_cache(maxsize=1)
def _encoding(path: str, pattern: str):
    import tiktoken

    of = ranks(path)
    sizes = np.zeros(max(of.values()) + 1, np.int64)
    for token, k in of.items():
        sizes[k] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=of, special_tokens={}), sizes


holding("tokens", _encoding.cache_clear)


def line_borders(text: str) -> list[int]:
    """Starts of the lines and the text's end, in code points."""
    out, at = [0], 0
    while (at := text.find("\n", at) + 1) and at < len(text):
        out.append(at)
    return [*out, len(text)]


def borders(text: str, named: list[tuple[int, int]]) -> tuple[list[int], list[int | None]]:
    """Borders of the named sections and the gaps between them, and the number of each, or None. Named ones are in order and don't overlap."""
    cuts, numbers = [0], []
    for k, (a, b) in enumerate(named):
        if not cuts[-1] <= a <= b <= len(text):
            raise ValueError("sections must be in order, apart from each other and inside the text")
        if a > cuts[-1]:
            cuts.append(a)
            numbers.append(None)
        cuts.append(b)
        numbers.append(k)
    if cuts[-1] < len(text) or not numbers:
        cuts.append(len(text))
        numbers.append(None)
    return cuts, numbers


def attribute(raw: np.ndarray, sizes: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that cross a border, of each section. raw: the text's bytes; sizes: the tokens' sizes in bytes; cuts: the borders in code points."""
    if len(cuts) > 1 and len(raw) != cuts[-1]:
        heads = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes that begin a code point
        cuts = np.append(heads, len(raw))[cuts]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    lo = np.searchsorted(cuts, starts, "right") - 1
    hi = np.searchsorted(cuts, ends - 1, "right") - 1
    n, crossing = np.zeros(len(cuts) - 1), np.zeros(len(cuts) - 1, np.int64)
    inside = lo == hi
    n += np.bincount(lo[inside], minlength=len(n))[: len(n)]
    for t in np.flatnonzero(~inside):
        sections = np.arange(lo[t], hi[t] + 1)
        shares = np.minimum(cuts[sections + 1], ends[t]) - np.maximum(cuts[sections], starts[t])
        crossing[sections[shares > 0]] += 1
        if rule == "split":
            n[sections] += shares / shares.sum()
        else:
            n[sections[0] if rule == "first" else sections[np.argmax(shares)]] += 1
    return n, crossing


def count_tokens(docs: DataFrame, path: str, pattern: str, sections: str | None = None, rule: str = "most") -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing. sections: a column array<struct<start, end>> of code points; without it, lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy("tokens")
        encoding, size_of = _encoding(path, pattern)
        for b in batches:
            parts = []
            for k, text in enumerate(b["text"]):
                text = text or ""
                if sections is None:
                    cuts = line_borders(text)
                    numbers = list(range(len(cuts) - 1))
                else:
                    named = b["_sections"].iloc[k]
                    cuts, numbers = borders(text, [(x["start"], x["end"]) for x in (named if named is not None else ())])
                cuts = np.asarray(cuts, np.int64)
                n, crossing = attribute(np.frombuffer(text.encode(), np.uint8), size_of[np.asarray(encoding.encode_ordinary(text), np.int64)], cuts, rule)
                parts.append((k, np.array([-1 if x is None else x for x in numbers]), cuts[:-1], cuts[1:], n, crossing))
            if not parts:
                continue
            rows = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            out = pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("section", "start", "end", "n_tokens", "n_crossing"), 1)})
            out["section"] = out["section"].astype("Int32").mask(out["section"] < 0)
            out.insert(0, "doc_id", pd.array(b["doc_id"], "Int64")[rows])
            yield out

    chosen = docs.select("doc_id", "text", *([docs[sections].alias("_sections")] if sections else []))
    return chosen.mapInPandas(run, SCHEMA)
