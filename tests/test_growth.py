"""What keeps queries of the rulings in proportion to their input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docket.functions import view
from docket.operators import graph
from docket.plans import rulings

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


def test_counts_of_cited_documents_without_pairs(spark):
    cited = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "doc_id long, canon string")
    numbers = spark.createDataFrame([(7, "a"), (8, "a"), (9, "c"), (10, None)], "doc_id long, number string")
    rows = graph.counted(cited, numbers)
    assert sorted(map(tuple, rows.collect())) == [(7, 3, 2), (8, 3, 2)]
    pairs = graph.resolved(cited, numbers).groupBy("cited").agg(F.count("*").alias("n"), F.countDistinct("citing").alias("citing"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, rows.collect()))


@given
def test_rulings_are_made_behind_the_last_shuffle(spark):
    plan = rulings.compose(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Krajowa" in plan and "Exchange" in plan
    below = plan[plan.index("Exchange"):]
    assert "Tak orzek" not in below and "Krajowa" not in below


def test_views_of_even_texts_equal_those_by_patterns(spark):
    texts = ["", " ", "\n", " a", "a ", "\na\n", "A B\nc d\n", "WYROK\nz dnia", "ab\ncd", "ab.\ncd", "ab\n1. cd", " ab\ncd ", "a  b", "a b\fc", "ab \ncd", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = [df.select("t", view.view(F.col("t")).alias("v"))]
    kept, view._even = view._even, lambda t: F.lit(False)
    try:
        both.append(df.select("t", view.view(F.col("t")).alias("v")))
    finally:
        view._even = kept
    one, two = ([tuple(r) for r in x.collect()] for x in both)
    assert one == two


def test_first_match_by_place_and_end(spark):
    from docket.functions.text import first_from

    texts = [("😀a\nx x", 0), ("a\nx x", 2), ("a\nx x", 3), ("x", 0), ("x", 1), ("", 0), (None, 0), ("x\n😀\n  x", 1)]
    df = spark.createDataFrame(texts, "t string, a int")
    rows = df.select(*[first_from(F.col("t"), r"(?m)^\s*x", F.col("a"), b, begins).alias(n) for n, b, begins in (("f", None, ""), ("g", None, "(?m:^)"), ("h", F.lit(2), "(?m:^)"))]).collect()
    assert [r["f"] and tuple(r["f"]) for r in rows] == [(3, 4, "x"), (2, 3, "x"), None, (0, 1, "x"), None, None, None, (4, 7, "  x")]
    assert [r["g"] for r in rows] == [r["f"] for r in rows]
    assert [r["h"] and tuple(r["h"]) for r in rows] == [None, None, None, (0, 1, "x"), None, None, None, None]


def test_headings_glued_to_dots_and_of_their_own(spark):
    from docket.operators import sections

    more = " tekst" * 50
    texts = ["orzeka: a\n…… Uzasadnienie" + more, "orzeka: a\nUzasadnienie\nB… … ...Uzasadnienie" + more, "orzeka: a\n...\n\nUz as adnienie\nB" + more, "orzeka: a\n... Uzasadnienie b\nUzasadnienie\n" + more, "orzeka: a\n...Uzasadnieniem\nb" + more]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", sections.spans(F.col("t")).alias("s")).orderBy("k").collect()
    starts = [[s["start"] for s in r["s"] if s["kind"] == "uzasadnienie"] for r in rows]
    assert starts == [[], [10], [15], [14], []]


def test_sections_of_an_even_text_are_not_searched_for_odd_blanks_again(spark, monkeypatch):
    from docket.operators import sections

    texts = ["a\nb c", "a\n\nb  c", " a\nB", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("even", view.even(F.col("t")))
    parts = lambda even: sections.views(F.col("t"), F.array(*[F.struct(F.lit("x").alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 2), (2, 5))]), even)
    seen = df.select(parts(None).alias("a"), parts(F.col("even")).alias("b")).filter("a is not null").collect()
    bare = lambda xs: [(x["kind"], x["start"], x["seen"] and (x["seen"]["text"], [tuple(m) for m in x["seen"]["moves"]])) for x in xs]
    assert [bare(r["a"]) for r in seen] == [bare(r["b"]) for r in seen]
    monkeypatch.setattr(view, "_even", lambda t: F.raise_error(F.lit("searched")).cast("boolean"))
    assert df.limit(1).select(F.size(parts(F.lit(True)))).first()[0] == 2


@given
@pytest.mark.parametrize("by", (99_900, 999_900))
def test_numbers_that_are_too_long_for_a_case_are_no_citations(spark, tmp_path, by):
    import duckdb

    from docket.plans import catalog

    db = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        (tmp_path / path.name).symlink_to(path)
    (tmp_path / "lineitem.parquet").unlink()
    spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + by).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("orders", "customer", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{'/*.parquet' if name == 'lineitem' else ''}'")
    for name in ("citations_offsets", "gold_check"):
        ours = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(ours, key=repr) == sorted(db.execute(catalog.ORACLE_SQL[name]).fetchall(), key=repr)


def test_postings_are_dealt_by_words_to_tasks_of_their_own(spark, monkeypatch):
    from docket.operators import postings

    monkeypatch.setattr(postings, "WORDS", 1000)
    docs = spark.createDataFrame([(k, 500) for k in range(10)], "key long, size int")
    assert postings.shards_of(docs) == 5 and postings.shards_of(docs.limit(0)) == 1 and postings.shards_of(docs, 1) == 10
    rows = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % postings.BUCKETS).cast("int").alias("bucket"))
    placed = postings.dealt(rows, 5).groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("place").alias("n")).collect()
    assert len(placed) == 5 * postings.BUCKETS and all(r["n"] == 1 for r in placed)


def test_sql_of_channel_pairs_takes_a_text_that_reads_the_same_backwards_for_alike():
    import duckdb

    from docket.plans import landing

    db = duckdb.connect()
    db.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (4, 'A.'), (8, 'one two three four'), (5, 'one'), (9, '..'), (7, NULL)) d(doc_id, text)")
    assert sorted(r[2] for r in db.execute(landing.ORACLE_SQL["channel_pairs"] + " ORDER BY doc_a").fetchall()) == [False, False, False, True, True]
