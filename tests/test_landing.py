"""Landed files, full export rows, dictionaries and whole reports."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docket.operators import coverage, exports
from docket.sources import landed
from docket.sources.records import decode

DATA = Path("/root/testdata/sf0.001")


def test_landed_files_give_records_and_rejects(spark, tmp_path):
    own = landed.register(landed.Channel("landed test"))
    assert landed.channel("landed test") == own and landed.register(landed.Channel("landed test")) is own
    for bad in (lambda: landed.register(landed.Channel("landed test", pages="x")), lambda: landed.channel("unheard of")):
        with pytest.raises(ValueError):
            bad()
    files = {
        "page=1.json": json.dumps({"has_more": True, "data": [{"slug": "a", "primary_signature": "KIO 1/24"}, {"slug": 7}]}).encode(), "page=2.json": b'{"data": [', "page=3.json": b'{"data": {}}',
        "page=4.json": b"\xff\xfe", "notes.txt": b"{}", "page=5.json": b'{"has_more": false, "data": []}',
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    rows = landed.files(spark, f"file://{tmp_path}")
    assert sorted((r["page"], r["idx"], r["source_ref"], r["good"]) for r in landed.listed(rows, own).collect()) == [(1, 0, "a", True), (1, 1, None, False)]
    assert {(r["path"].rpartition("/")[2], r["reason"]) for r in landed.rejects(rows, own).collect()} == {("page=2.json", "not JSON"), ("page=3.json", "no list"), ("page=4.json", "not text"), ("notes.txt", "name")}
    assert {(r["path"].rpartition("/")[2], r["decoded"]) for r in landed.records(rows, own).collect()} == {(n, n not in ("page=2.json", "page=4.json")) for n in files}


def test_full_rows_and_their_dictionary(spark):
    bodies = [(1, json.dumps({"slug": "s-1", "primary_signature": "=KIO 1/24", "signatures": ["KIO 1/24", " ", "KIO 2/24"], "costs_total": 5, "full_text": "text"})), (2, json.dumps({"slug": "s-2", "costs_total": "7"}))]
    rows = decode(spark.createDataFrame(bodies, "doc_id long, content string").withColumn("sha256", F.sha2("content", 256)))
    full = exports.full_rows(rows, "test", F.lit("now"), "given")
    assert full.columns == list(exports.COLUMNS) and len(full.columns) == 21
    one, two = full.orderBy("slug").collect()
    assert (one["sygnatura"], one["sygnatury"], one["koszty"], one["dlugosc_tresci"]) == ("'=KIO 1/24", "KIO 1/24; KIO 2/24", 5.0, 4) and two["koszty"] is None
    filled = {r["column"]: (r["filled"], r["rows"]) for r in exports.dictionary(full, {}).collect()}
    assert filled["slug"] == (2, 2) and filled["koszty"] == (1, 2) and filled["sygnatury"] == (1, 2)


def test_whole_report(spark):
    a, b = spark.createDataFrame([("y", 1), ("x", 2)], "k string, n int"), spark.createDataFrame([], "q string")
    lines = [r["value"] for r in coverage.whole_report({"First": (a, "k"), "Second": (b, "q")}).orderBy("section", "position").collect()]
    assert lines == ["## First", "", "| k | n |", "|---|---|", "| x | 2 |", "| y | 1 |", "## Second", "", "| q |", "|---|"]


def test_packed_files_are_read_as_files_and_are_few(spark, tmp_path):
    own = landed.register(landed.Channel("packed test"))
    bodies = [(f"page={k}", b'{"data": [{"slug": "a"}]}' if k % 3 else b"{") for k in range(300)]
    for name, body in bodies[:4]:
        (tmp_path / name).write_bytes(body)
    to = landed.pack(spark.createDataFrame(bodies, "path string, content binary"), f"file://{tmp_path}/packs")
    packed, files = landed.packed(spark, to), landed.files(spark, f"file://{tmp_path}/page=*")
    assert packed.schema == files.schema and packed.count() == 300 and 1 <= len(list((tmp_path / "packs").glob("*.parquet"))) <= 16
    first = packed.filter(F.col("path").isin([n for n, _ in bodies[:4]]))
    for f, columns in ((landed.listed, ("page", "idx", "source_ref", "good")), (landed.rejects, ("sha256", "length", "reason"))):
        one, two = (sorted(map(tuple, f(rows, own).select(*columns).collect())) for rows in (first, files))
        assert one == two and one


def test_pages_of_a_query_share_files(spark):
    from pathlib import Path

    from docket.plans import landing
    from docket.sources import tables

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the given tables")
    rows = landing.landed_pages(spark, data)
    n = rows.filter("way = 'stream'").count()
    path = tables.stored_once(spark, data, "pages", None)
    assert n > 10 and len(list(Path(path.removeprefix("file://")).rglob("part-*"))) < n / 2


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_coverage_report_has_all_sections_and_equals_its_sql(spark):
    import duckdb

    from docket.plans import landing

    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    lines = sorted(tuple(r) for r in landing.coverage_report(spark, str(DATA)).collect())
    assert lines == sorted(db.execute(landing.ORACLE_SQL["coverage_report"]).fetchall())
    assert [v for _, at, v in lines if at == 0] == [f"## {t}" for t in ("Corpus", "Vintages", "Characters", "Months of issue", "Citations", "Citations by vintage", "Provisions", "Containment", "Gold set", "Gold differences")]
    acts, differ = [v for k, _, v in lines if k == 6], [v for k, at, v in lines if k == 9 and at > 3]
    assert any(v.startswith("| kanal |") for v in acts) and any(v.startswith("| tresc |") for v in acts)
    assert any(v.endswith("| unchecked |") for v in differ) and any(v.endswith("| citations |") for v in differ)


def test_long_tables_are_numbered_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(coverage, "STRETCH", 4)
    keys = [(k % 17 - 5, f"r{k // 17}") for k in range(40)]
    rows = coverage.numbered(spark.createDataFrame(keys, "k long, reason string"), "k", "reason")
    assert [tuple(r) for r in rows.orderBy("position").select("position", "k", "reason").collect()] == [(i, *x) for i, x in enumerate(sorted(keys))]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_of" in plan  # the rows' own ranks


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_a_coverage_report_reads_each_ruling_once(spark):
    from docket.plans import reports

    plan = reports._checked(spark, str(DATA), "listed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("RelationV2") + plan.count("Relation [") == 3 and "rlike" not in plan.lower()
