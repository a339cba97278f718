"""Snapshots of several tables, and exports that replace only their own."""

import pytest
from pyspark.sql import functions as F

from docket.operators import exports
from docket.operators.snapshots import Change, Store, publish
from docket.streaming import ingest


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, v string")


def held(store, table, at=None):
    return sorted(map(tuple, store.read(table, at).collect()))


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = frame(spark, [(k, "a") for k in range(200)])
    assert store.commit({"versions": Change(first), "derived": Change(first, key="doc_id")}) == 0
    return store


def test_rows_are_replaced_by_buckets_and_older_snapshots_stay(spark, store):
    assert store.commit({"versions": Change(frame(spark, [(3, "b"), (900, "b")])), "derived": Change(frame(spark, [(3, "b"), (900, "b")]), key="doc_id")}) == 1
    old = [(k, "a") for k in range(200)]
    assert held(store, "versions") == sorted([*old, (3, "b"), (900, "b")]) and held(store, "versions", 0) == old
    assert held(store, "derived") == sorted([x for x in old if x[0] != 3] + [(3, "b"), (900, "b")]) and held(store, "derived", 0) == old
    parts = store.manifest()["tables"]["derived"]["parts"]
    assert len(parts) == 2 and not set(parts[0]["buckets"]) & set(parts[1]["buckets"]) and len(parts[1]["buckets"]) <= 2
    now = held(store, "derived")
    assert store.compact("derived", "doc_id") == 2 and held(store, "derived") == now and len(store.manifest()["tables"]["derived"]["parts"]) == 1
    assert len(store.expire(keep=1)) == 1 + 1 and store.snapshots() == [2] and held(store, "derived") == now and len(held(store, "versions")) == 202
    with pytest.raises(ValueError):
        store.read("versions", 0)


@pytest.mark.parametrize("step", ["first table", "second table", "manifest", "rename"])
def test_a_cut_at_any_step_leaves_the_old_snapshot(spark, store, monkeypatch, step):
    written = []
    write = Store._write

    def cut(self, rows, table, keyed):
        written.append(table)
        if step == ("first table", "second table")[len(written) - 1] if len(written) < 3 else False:
            raise OSError(step)
        return write(self, rows, table, keyed)

    with monkeypatch.context() as m:
        if step == "manifest":
            m.setattr(store.files, "write", lambda *_: (_ for _ in ()).throw(OSError(step)))
        elif step == "rename":
            m.setattr(store.files, "rename", lambda *_: (_ for _ in ()).throw(OSError(step)))
        else:
            m.setattr(Store, "_write", cut)
        with pytest.raises(OSError, match=step):
            store.commit({"versions": Change(frame(spark, [(1, "x")])), "derived": Change(frame(spark, [(1, "x")]), key="doc_id")})
    old = [(k, "a") for k in range(200)]
    assert store.snapshots() == [0] and held(store, "versions") == old and held(store, "derived") == old
    store.expire()
    assert sum(len(store.files.names(f"{store.path}/data/{t}")) for t in ("versions", "derived")) == 2  # what was cut off is gone
    assert store.commit({"versions": Change(frame(spark, [(1, "x")]))}) == 1


def test_a_commit_that_was_overtaken_fails(spark, store, monkeypatch):
    monkeypatch.setattr(store, "snapshots", lambda: [0][:])
    store.commit({"versions": Change(frame(spark, [(1, "x")]))})
    with pytest.raises(Exception, match=r"exist"):
        store.commit({"versions": Change(frame(spark, [(2, "y")]))})


def test_stream_commits_batches_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for k, rows in enumerate([[(1, "one"), (2, "two")], [(2, "two, changed"), (3, "three")]]):
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("seen_at", F.lit(f"2024-01-0{k + 1}").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("doc_id long, text string, seen_at timestamp").parquet(f"{tmp_path}/in")
        ingest.start_snapshots(stream, store, f"{tmp_path}/checkpoint", "run").awaitTermination()
    assert store.snapshots() == [0, 1]
    assert store.read("versions").count() == 4 and store.read("versions", 0).count() == 2
    assert {(r["doc_id"], r["n_chars"]) for r in store.read("metadata").collect()} == {(1, 3), (2, 12), (3, 5)}
    again = spark.createDataFrame([(9, "again")], "doc_id long, text string").withColumn("seen_at", F.lit("2024-01-03").cast("timestamp"))
    ingest.take(store, "run", again, 1)  # a batch that was committed already
    assert store.snapshots() == [0, 1]


def test_exports_replace_only_their_own(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, raw string")
    lines, path = exports.jsonl(docs, F.lit("cited"), "raw"), f"file://{tmp_path}/out/export"
    publish(lines, path, "corpus-1")
    publish(lines.limit(1), path, "corpus-1")
    assert spark.read.text(path).count() == 1
    (tmp_path / "out/foreign").mkdir()
    (tmp_path / "out/foreign/letter.txt").write_text("mine")
    for other, owner in ((f"file://{tmp_path}/out/foreign", "corpus-1"), (path, "corpus-2")):
        with pytest.raises(ValueError):
            publish(lines, other, owner)
    assert (tmp_path / "out/foreign/letter.txt").read_text() == "mine"
    with pytest.raises(Exception):  # noqa: B017  a failure half-way
        publish(lines.withColumn("value", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("value"))), path, "corpus-1")
    assert spark.read.text(path).count() == 1 and sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("..")) == ["export", "foreign"]
    pages = exports.markdown(docs, F.lit("t"), F.lit("b"), F.col("raw"), F.lit(""), F.col("doc_id").cast("string"))
    publish(exports.in_buckets(pages, 4), f"file://{tmp_path}/out/pages", "corpus-1", "json")
    assert {r["file"] for r in spark.read.json(f"file://{tmp_path}/out/pages").collect()} == {"1.md", "2.md"}
