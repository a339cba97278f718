"""Several tables that change together: a snapshot is a manifest of the folders that make up each table, and comes into being by one rename.

Folders of data are never changed. A commit writes new ones, then a manifest that lists them with those of the snapshot before, and renames it to the next number; a commit that was cut off before leaves
folders that no manifest names, and one that another overtook fails. Readers take the last manifest, or an older one. Rows of a keyed table are replaced by buckets of the key: the buckets that new rows touch
are written anew, the others stay where they are. Manifests also say how far each stream has come, so that a batch that runs again is left out.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.sources.files import Files

BUCKETS = 64


@dataclass
class Change:
    """rows are appended to a table, or with key put in place of the rows of the same keys, or with whole of all rows."""

    rows: DataFrame
    key: str | tuple[str, ...] | None = None
    whole: bool = False


@dataclass
class Store:
    """Tables under a path."""

    spark: SparkSession
    path: str
    files: Files = field(init=False)

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.path)
        self.files.make(f"{self.path}/manifests")

    def snapshots(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, at: int | None = None) -> dict:
        known = self.snapshots()
        if at is None and not known:
            return {"tables": {}, "streams": {}}
        at = known[-1] if at is None else at
        if at not in known:
            raise ValueError(f"no snapshot {at}; there are {known}")
        return json.loads(self.files.read(f"{self.path}/manifests/{at}.json"))

    def read(self, table: str, at: int | None = None) -> DataFrame:
        """A table as of a snapshot."""
        held = self.manifest(at)["tables"].get(table)
        if held is None:
            raise ValueError(f"no table {table}")
        return self._folders(held)

    def _folders(self, held: dict) -> DataFrame:
        out = None
        for part in held["parts"]:
            rows = self.spark.read.schema(f"{held['schema']}, _bucket int" if part["buckets"] is not None else held["schema"]).parquet(f"{self.path}/{part['path']}")
            if part["buckets"] is not None:
                rows = rows.filter(F.col("_bucket").isin(part["buckets"])).drop("_bucket")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _write(self, rows: DataFrame, table: str, keyed: bool) -> str:
        path = f"data/{table}/{uuid.uuid4().hex}"
        (rows.repartition("_bucket").write.partitionBy("_bucket") if keyed else rows.write).parquet(f"{self.path}/{path}")
        return path

    def commit(self, changes: dict[str, Change], stream: str | None = None, batch: int | None = None) -> int:
        """The number of the new snapshot, in which all changes are there together; of the last one where the stream's batch is in it already."""
        known = self.snapshots()
        now = self.manifest()
        if stream is not None and now["streams"].get(stream, -1) >= batch:
            return known[-1]
        tables = dict(now["tables"])
        for name, change in changes.items():
            tables[name] = self._changed(name, tables.get(name), change)
        streams = now["streams"] | ({stream: batch} if stream is not None else {})
        number = known[-1] + 1 if known else 0
        self._swap({"tables": tables, "streams": streams}, number)
        return number

    def _changed(self, name: str, held: dict | None, change: Change) -> dict:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in change.rows.schema.fields)
        old = [] if held is None or change.whole else held["parts"]
        if held is not None and not change.whole and held["schema"] != schema:
            raise ValueError(f"{name} has the columns {held['schema']}")
        if change.key is None:
            return {"schema": schema, "parts": [*old, {"path": self._write(change.rows, name, False), "buckets": None}]}
        key = [change.key] if isinstance(change.key, str) else list(change.key)
        bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")
        rows = change.rows.withColumn("_bucket", bucket)
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most BUCKETS
        if old:
            before = self._folders(held).withColumn("_bucket", bucket).filter(F.col("_bucket").isin(touched))
            rows = before.join(change.rows.select(*key).distinct(), key, "left_anti").select(*rows.columns).unionByName(rows)
        left = [{"path": p["path"], "buckets": b} for p in old if (b := [x for x in p["buckets"] if x not in touched])]
        return {"schema": schema, "parts": [*left, {"path": self._write(rows, name, True), "buckets": touched}]}

    def _swap(self, manifest: dict, number: int) -> None:
        staged = f"{self.path}/manifests/_{uuid.uuid4().hex}"
        self.files.write(staged, json.dumps(manifest))
        self.files.rename(staged, f"{self.path}/manifests/{number}.json")

    def compact(self, table: str, key: str | tuple[str, ...] | None = None) -> int:
        """The table as one folder, as a new snapshot."""
        return self.commit({table: Change(self.read(table), key, whole=True)})

    def expire(self, keep: int = 1) -> list[str]:
        """Drops all but the last snapshots, and the folders that none of those names, also of commits that were cut off; not while another commit runs. Gives the folders."""
        if keep < 1:
            raise ValueError("the last snapshot stays")
        known = self.snapshots()
        needed = {p["path"] for n in known[-keep:] for t in self.manifest(n)["tables"].values() for p in t["parts"]}
        for n in known[:-keep]:
            self.files.remove(f"{self.path}/manifests/{n}.json")
        every = [f"data/{t}/{f}" for t in self.files.names(f"{self.path}/data") for f in self.files.names(f"{self.path}/data/{t}")]
        gone = [f for f in every if f not in needed]
        for f in gone:
            self.files.remove(f"{self.path}/{f}")
        return gone


def publish(rows: DataFrame, path: str, owner: str, kind: str = "text", **options: object) -> None:
    """Writes an export whole or not at all: beside its place first, then by a rename. What is there before goes only if the same owner wrote it."""
    files = Files(rows.sparkSession, path)
    parent, _, name = path.rstrip("/").rpartition("/")
    staged, old = (f"{parent}/.{name}-{x}-{uuid.uuid4().hex}" for x in ("new", "old"))
    there = files.exists(path)
    if there and (not files.exists(f"{path}/_OWNER") or files.read(f"{path}/_OWNER") != owner):
        raise ValueError(f"{path} isn't an export of {owner}")
    partition = [c for c in ("bucket",) if c in rows.columns]
    try:
        rows.write.format(kind).options(**options).partitionBy(*partition).save(staged)
        files.write(f"{staged}/_OWNER", owner)
        if there:
            files.rename(path, old)
        try:
            files.rename(staged, path)
        except Exception:
            if there:
                files.rename(old, path)
            raise
        if there:
            files.remove(old)
    finally:
        files.remove(staged)
