"""Texts read in Python against columns, and what of it Spark's plans hold."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docket.functions import reading, view
from docket.operators import provisions, sections
from docket.plans import rulings

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


def test_views_and_the_way_back_equal_those_of_columns(spark):
    texts = ["", " ", "\n", " a", "A B\nc d\n", "ab\ncd", "ab.\ncd", "ab\n1. cd", " ab\ncd ", "a  b", "a b\fc", "ab \ncd\r\n\n x\t", "\f\fa\u00a0\u2007b\r", "😀\n\n ab\uffff b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", view.view(F.col("t")).alias("v"))
    rows = rows.select("t", "v.text", F.transform(F.sequence(F.lit(0), F.col("v.n")), lambda k: view.origin(F.col("v"), k)).alias("at")).collect()
    for r in rows:
        seen, origin = reading.view(r.t)
        assert (seen, [origin(k) for k in range(len(seen) + 1)]) == (r.text, r.at), repr(r.t)


def test_words_and_case_are_those_of_unicode(spark):
    texts = ["ſygn. akt\n\u0301orzeka:\n²ORZEKA 1.", "Ⓐart. 4, ‿art. 5, ²art. ٣ KPC.", None]
    rows = spark.createDataFrame([(k, t, [t]) for k, t in enumerate(texts)], "doc_id int, text string, listed array<string>")
    kinds = [[s.kind for s in r.s] for r in rows.select("doc_id", sections.spans(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert kinds == [["naglowek", "sentencja"], ["nieprzypisane"], []]
    found = sorted(tuple(r) for r in provisions.from_both(rows, "listed").select("doc_id", "source", "form", "act").collect() if r.doc_id)
    assert found == [(1, "kanal", "art. ٣", "kpc"), (1, "tresc", "art. ٣", "kpc"), (2, "kanal", "", None)]


@given
@pytest.mark.parametrize("name", ("provision_forms", "statute_by_context", "provision_containment", "sections_map", "headed_text"))
def test_anchors_and_provisions_are_no_nested_expressions(spark, name):
    plan = rulings.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan and "rlike" not in plan.lower()


def test_case_numbers_equal_those_of_columns(spark):
    from docket.functions.identity import case_numbers, chamber_number

    texts = [
        "por. KIO 12/34, kio/uzp 0012/2019, KİO 5/11, KIO/KD 7/20, KIO/582/11; xKIO 1/20, KIO 100000/20, KIO 1/201", "II CSK 5/20 i III  czp 5/20, XVIII Aga 004/2011, VI SA/wa 2187/21, V GSK/Op 1/20",
        "UZP/ZO/0-12/05, uzp / zo / 0 - 0012 / 05, C-12/20, T – 7/11, AC-1/20, IX Ga 3/20, I C 1/20", "KIO ٣/20, KIO 0٣/11, ⒶKIO 1/20", "", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", case_numbers(F.col("t")).alias("found"), chamber_number(F.col("t")).alias("first")).collect()
    for r in rows:
        assert reading.chamber_number(r.t) == r["first"]
        assert r.t is None or reading.case_numbers(r.t) == [(h.start, h.end, h.kind, h.canon) for h in r.found], r.t


@given
@pytest.mark.parametrize("name", ("citations_offsets", "citation_kinds", "vintage_report", "gold_draft", "gold_check"))
def test_citations_are_no_nested_expressions_and_each_ruling_is_read_once(spark, name):
    from docket.plans import catalog

    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower() and "regexp_extract_all" not in plan and plan.count("ArrowEvalPython") == (2 if name.startswith("cit") else 1)
