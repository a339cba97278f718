"""Each stage of the pipeline, on what the stage before it kept, against a version without Spark; with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docket.llm import pii, toxicity

RNG = np.random.default_rng(17)
WORDS = ["".join(RNG.choice(list("abcdeiorst"), RNG.integers(2, 9))) for _ in range(250)]
BAD = ["vilexa", "vilexon", "gromptar"]
prose = lambda n: " ".join(RNG.choice(WORDS, n))
CLASH = ("_host", "_lines", "component_id", "score", "predicted", "n_lines", "n_dropped", "key", "length", "rep", "_text", "gone")


def made():
    """doc_id, text, source."""
    rows = [(k, f"Menu of the site\n{prose(60)}" + (f"\n{' '.join(RNG.choice(BAD, 4))} {prose(20)}" if k % 3 == 0 else ""), ["a.org", "b.org"][k % 2]) for k in range(240)]
    base = prose(120).split()
    for k in range(20):
        copy = list(base)
        copy[int(RNG.integers(120))] = "edited"
        rows.append((300 + k, " ".join(copy), "c.org"))
    rows += [(400 + k, rows[1][1], None) for k in range(3)]
    rows += [(500, None, "a.org"), (501, "", "a.org"), (502, " \n", None), (503, "one two", None), (504, "one two", None), (505, f"write to x{'y' * 30}@mail.org or +49 171 2345678 " + prose(30), "d.org")]
    rows += [(506, prose(6000), "d.org"), (507, "Menu of the site", "a.org"), (None, prose(40), "e.org"), (None, None, "e.org"), (5, rows[5][1], rows[5][2]), (505, None, "d.org")]
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("corpus")
    rows = ROWS
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return f"{where}"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def toxic(rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = {i: t or "" for i, t, _ in rows if i is not None and i < 240 and not held(i)}
    model = toxicity.train([known[i] for i in sorted(known)], np.array([i % 3 == 0 for i in sorted(known)]))
    return [r for r in rows if model.score(*model.words([r[1] or ""]))[0] < 0.7]


def without_lines(rows):
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    pages, held = Counter(s for _, _, s in rows), Counter((s, x) for _, t, s in rows for x in {bare(x) for x in (t or "").split("\n")} - {""})
    drop = {k for k, n in held.items() if n >= 10 and n > 0.1 * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, bare(x)) not in drop), s) for i, t, s in rows]


def without_copies(rows):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [r for r in rows if r[0] is None or top(r[0]) == r[0]]


def masked(rows):
    return [(i, None if t is None else pii.redacted(t, pii.spans(t)[1]), s) for i, t, s in rows]


def packed(rows):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    return out


BRUTE = {"toxicity": toxic, "line_dedup": without_lines, "near_duplicates": without_copies, "personal_data": masked, "packing": packed}
in_order = lambda rows: sorted(rows, key=repr)


def test_stages_equal_a_version_without_spark(spark, tables):
    docs, rows = spark.read.parquet(f"{tables}/documents.parquet"), ROWS
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
        was, rows = rows, BRUTE[name](rows)
        got = docs.collect()
        assert in_order((r.doc_id, r.text, r.source) for r in got) == in_order(rows), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.lang == "en" for r in got), name
        assert was != rows, name  # every stage has something to do
        docs = spark.createDataFrame(got, docs.schema).withColumns({c: F.lit("clash") for c in CLASH})
    sequences, got = defaultdict(list), corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert in_order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == in_order(packed(rows))
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in map(sorted, sequences.values()):
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_run_equals_its_stages(spark, tables):
    rows = ROWS
    for brute in BRUTE.values():
        rows = brute(rows)
    assert in_order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, tables).collect()) == in_order(rows)


def test_stages_of_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name
