"""Byte-level BPE over rank files, by recursive DuckDB queries in each partition.

Spark deals the documents; in a task, texts are split by the pattern, and the distinct pieces that the worker has not met go to an in-memory DuckDB.
There, rows of (piece, position, token) join the merge table and contract each piece's leftmost pair of minimum rank, until no pair is left. An ordered
aggregation of the tokens' bytes decodes them again.

Defined results: null and empty texts have no tokens, and hashes of no bytes. Text that the pattern skips can't occur, as it covers all characters. Repeated rows
are encoded alike. A piece that is a token by itself is that token. Pieces of any length work, in time that grows with their length; see Codec.stitched. An empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import holding, tidy

LONG = 40  # bytes from which a piece contracts all pairs of its minimum rank at a step
STEPS = 64  # of a recursive query, before its state is written anew
CHUNK = 20_000  # pieces given to a query at once
CUT = 48  # bytes from one block of a long piece to the next; a block has twice as many
KNOWN = 1_000_000  # pieces that a worker remembers

#: A row holds a token, its place in its piece, and the place and token that follow. A step finds the pairs that the merge table has, takes each piece's
#: leftmost one of minimum rank, gives its row the merged token and what followed its second row, and drops that row. Pieces without a pair go no further.
_STEP = """
WITH RECURSIVE run(step, word, pos, tok, npos, ntok) AS (
  SELECT 0, word, pos, tok, npos, ntok FROM state
  UNION ALL
  (WITH cur AS MATERIALIZED (SELECT * FROM run WHERE step < {steps} - 1),
    least_pair AS (SELECT word, min((rank::BIGINT << 42) | (pos::BIGINT << 21) | npos) AS code FROM cur JOIN merges ON l = tok AND r = ntok GROUP BY word),
    chosen AS (
      SELECT c.word AS word, (code >> 21) & 2097151 AS spot, c.pos AS gone, (code >> 42)::INTEGER AS merged, c.npos AS far, c.ntok AS farther
      FROM least_pair p JOIN cur c ON c.word = p.word AND c.pos = code & 2097151)
  SELECT step + 1, cur.word, pos, CASE WHEN pos = spot THEN merged ELSE tok END, CASE WHEN pos = spot THEN far ELSE npos END,
    CASE WHEN pos = spot THEN farther WHEN npos = spot THEN merged ELSE ntok END
  FROM cur JOIN chosen ON cur.word = chosen.word WHERE pos <> gone)
)
SELECT * FROM run WHERE step = {steps} - 1 OR (word, step) IN (SELECT word, max(step) FROM run GROUP BY word)
"""
#: For long pieces: of neighbouring pairs with the minimum rank every other one, from the left; only the leftmost where a lower rank might come up in between.
_STEP_ALL = """
WITH RECURSIVE run(step, word, pos, tok, npos, ntok) AS (
  SELECT 0, word, pos, tok, npos, ntok FROM state
  UNION ALL
  SELECT step + 1, word, pos, CASE WHEN chosen THEN rank ELSE tok END, NULL, NULL
  FROM (
    SELECT *, lag(chosen, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone, bool_or(chosen) OVER (PARTITION BY word) AS moves
    FROM (
      SELECT *, coalesce(rank = least AND CASE WHEN alone THEN idx = min(CASE WHEN rank = least THEN idx END) OVER (PARTITION BY word)
        ELSE (row_number() OVER (PARTITION BY word, rank IS NOT DISTINCT FROM least, island ORDER BY pos)) % 2 = 1 END, false) AS chosen
      FROM (
        SELECT *, idx - row_number() OVER (PARTITION BY word, rank IS NOT DISTINCT FROM least ORDER BY pos) AS island
        FROM (
          SELECT p.*, m.rank, m.alone, min(m.rank) OVER (PARTITION BY p.word) AS least
          FROM (SELECT step, word, pos, tok, lead(tok) OVER w AS nxt, row_number() OVER w AS idx FROM run WHERE step < {steps} - 1 WINDOW w AS (PARTITION BY word ORDER BY pos)) p
          LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt))))
  WHERE moves AND NOT gone
)
SELECT * FROM run WHERE step = {steps} - 1 OR (word, step) IN (SELECT word, max(step) FROM run GROUP BY word)
"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The merge table of a rank file in DuckDB, and the pieces met so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks(path)
        self.tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.known: dict[str, bytes] = {}  # ids of a piece, as little-endian unsigned 32-bit integers
        self.back: dict[str, bytes] = {}  # the bytes that they decode to
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], k) for t, k in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = zip(*pairs, strict=True) if pairs else ((), (), ())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.pa = pa
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        self.sizes[list(self.tokens)] = list(map(len, self.tokens.values()))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        given = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())})  # noqa: F841
        self.db.register("given", given)
        self.db.execute("CREATE TABLE pairs AS SELECT * FROM given")
        self.db.execute("""CREATE TABLE merges AS SELECT p.*, p.rank > least(coalesce(a.low, p.rank), coalesce(b.low, p.rank)) AS alone FROM pairs p
            LEFT JOIN (SELECT l, min(rank) AS low FROM pairs GROUP BY l) a ON a.l = p.rank LEFT JOIN (SELECT r, min(rank) AS low FROM pairs GROUP BY r) b ON b.r = p.rank""")
        self.db.unregister("given")
        tokens = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array([t.hex() for t in self.ranks])})
        self.db.register("given", tokens)
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, pieces: list[bytes], every: bool) -> tuple[list[bytes], list[bytes]]:
        """Ids as little-endian unsigned 32-bit integers, and the bytes they decode to, of each piece."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)
        pos = np.arange(len(raw), dtype=np.int32) - np.repeat(ends - sizes, sizes).astype(np.int32)
        tok, last = self.single[raw], np.zeros(len(raw), bool)
        last[ends - 1] = True
        state = self.pa.table({"word": word, "pos": pos, "tok": tok, "npos": np.where(last, -1, pos + 1).astype(np.int32), "ntok": np.where(last, -1, np.append(tok[1:], -1)).astype(np.int32)})
        done, sql = [], (_STEP_ALL if every else _STEP).format(steps=STEPS)
        while state.num_rows:
            self.db.register("given", state)
            self.db.execute("CREATE OR REPLACE TEMP TABLE state AS SELECT * FROM given")
            self.db.unregister("given")
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE stepped AS {sql}")
            done += self.db.execute(f"""SELECT word, list(tok ORDER BY pos), string_agg(bytes, '' ORDER BY pos) FROM stepped JOIN tokens USING (tok)
                WHERE step < {STEPS} - 1 GROUP BY word""").fetchall()
            state = self.db.sql(f"SELECT word, pos, tok, npos, ntok FROM stepped WHERE step = {STEPS} - 1").to_arrow_table()
        out, decoded = [b""] * len(pieces), [b""] * len(pieces)
        for w, ids, back in done:
            out[w], decoded[w] = struct.pack(f"<{len(ids)}I", *ids), bytes.fromhex(back)
        return out, decoded

    def stitched(self, pieces: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes of long pieces, from blocks that overlap.

        A sequence of tokens is what contracting gives if and only if that holds of each two neighbours in it. So where the tokens of two blocks that overlap have one in common, at the same place, those of the
        first up to it and those of the second after it are right together: any two neighbours stand so in a block. Blocks that share none are joined and contracted again, in the end as one.
        """
        blocks = [[(i, min(i + 2 * CUT, len(p))) for i in range(0, max(1, len(p) - CUT), CUT)] for p in pieces]
        known: dict[bytes, np.ndarray] = {}
        open_pieces = list(range(len(pieces)))
        done: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        while open_pieces:
            fresh = list({pieces[k][a:b] for k in open_pieces for a, b in blocks[k]} - known.keys())
            for i in range(0, len(fresh), CHUNK):
                part = fresh[i : i + CHUNK]
                known.update(zip(part, (np.frombuffer(x, np.uint32) for x in self.contract(part, len(max(part, key=len)) >= 4 * CUT)[0]), strict=True))
            rest = []
            for k in open_pieces:
                ids, blocks[k] = self.join(pieces[k], blocks[k], known)
                if len(blocks[k]) > 1:
                    rest.append(k)
                else:
                    done[k] = ids
            open_pieces = rest
        ids = [x.astype("<u4").tobytes() for x in done]
        return ids, self.decode(done)

    def join(self, piece: bytes, blocks: list[tuple[int, int]], known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The tokens of a piece and one block, or the blocks to go on with where neighbours have no token in common."""
        out, left, last = [], [], None
        for a, b in blocks:
            ids = known[piece[a:b]]
            ends = a + np.cumsum(self.sizes[ids])
            if last is not None:
                # A token is named by its end and id
                own, other = (e.astype(np.int64) << 32 | i for e, i in ((last[1], last[0]), (ends, ids)))
                _, x, y = np.intersect1d(own, other, return_indices=True)
                if not len(x):
                    left[-1] = (left[-1][0], b)
                    last = (ids, ends)
                    out = None
                    continue
                if out is not None:
                    out[-1] = out[-1][: len(out[-1]) - (len(last[0]) - x[-1]) + 1]
                    ids, ends = ids[y[-1] + 1 :], ends[y[-1] + 1 :]
            left.append((a, b))
            last = (ids, ends)
            if out is not None:
                out.append(ids)
        return (np.concatenate(out), [(0, len(piece))]) if out is not None else (np.zeros(0, np.uint32), left)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = [len(x) for x in ids]
        given = self.pa.table({"word": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.concatenate([np.arange(n) for n in sizes]), "tok": np.concatenate(ids).astype(np.int32)})
        self.db.register("given", given)
        rows = self.db.execute("SELECT word, string_agg(bytes, '' ORDER BY pos) FROM given JOIN tokens USING (tok) GROUP BY word").fetchall()
        self.db.unregister("given")
        of = dict(rows)
        return [bytes.fromhex(of.get(k, "")) for k in range(len(ids))]

    def learn(self, pieces: set[str]) -> None:
        fresh = []
        for p in pieces:
            raw = p.encode()
            if (k := self.ranks.get(raw)) is not None:
                self.known[p], self.back[p] = k.to_bytes(4, "little"), self.tokens[k]
            else:
                fresh.append((p, raw))
        kinds = ((0, LONG, lambda x: self.contract(x, False)), (LONG, 4 * CUT, lambda x: self.contract(x, True)), (4 * CUT, sys.maxsize, self.stitched))
        for low, high, way in kinds:
            some = [x for x in fresh if low <= len(x[1]) < high]
            for i in range(0, len(some), CHUNK):
                part = some[i : i + CHUNK]
                ids, back = way([raw for _, raw in part])
                self.known.update(zip((p for p, _ in part), ids, strict=True))
                self.back.update(zip((p for p, _ in part), back, strict=True))

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text, its ids and the bytes they decode to."""
        split, at = [], 0
        while at < len(texts) or split:
            size = 0
            while at < len(texts) and size < 2_000_000:  # characters whose pieces are held at once
                split.append(self.split(texts[at]))
                size += len(texts[at])
                at += 1
            fresh = set().union(*split)
            if len(self.known) + len(fresh - self.known.keys()) > KNOWN:
                kept = fresh & self.known.keys()
                self.known, self.back = ({p: of[p] for p in kept} for of in (self.known, self.back))
            self.learn(fresh - self.known.keys())
            for pieces in split:
                yield b"".join(map(self.known.__getitem__, pieces)), b"".join(map(self.back.__getitem__, pieces))
            split = []


@functools.lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


holding("bpe", codec.cache_clear)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy("bpe")
        for b in batches:
            texts = [t or "" for t in b["text"]]
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) for ids, back in codec(path, pattern)(texts)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=b["doc_id"].to_numpy())[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
