"""Registered queries against their SQL in DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from docket.plans import catalog

DATA = Path("/root/testdata/sf0.001")
CHECKED = (
    "version_ledger", "current_version", "incremental_reparse", "filter_algebra", "undated_left_out", "broadening_counts", "phrase_search_topk", "search_counts", "latest_run", "run_ledger", "lineage_rebuild",
    "error_streaks", "rolling_budget", "cooldown", "byte_stability", "vintage_cost_estimate", "shape_list", "marker_counts", "corpus_profile", "corpus_digest", "sanitize_text", "export_rows", "citation_block", "record_decode",
    "sections_map", "citations_offsets", "provision_forms", "gold_check", "vintage_report", "search_current", "search_by_number", "stream_ingest_equals_batch", "stream_budget", "stream_streaks", "stream_first_seen", "export_metadata", "capped_cost",
    "run_list", "headed_text", "criteria_of_runs",
)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted([tuple(clean(v[i]) for i in order) for v in values], key=repr)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, db, name):
    ours = catalog.QUERIES[name](spark, str(DATA))
    want = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(names, want.fetchall())
