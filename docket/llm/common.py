"""What the operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.sources.tables import shared_folder

BATCH = 1000  # rows of an Arrow batch: texts may be long, and a task holds a batch on both sides of its pipe


def prepare(spark: SparkSession) -> None:
    """What jobs on texts need of a session: small Arrow batches, and that Python workers which it starts find the package, wherever the driver was started; on a cluster, ship it with
    --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (root, env.get("PYTHONPATH"))))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables that nothing reads any more."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def stored(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """df written once to the shared folder, or to a folder made there, and read back: a lost executor costs no recomputation, and Spark knows the size for its choice of join."""
    spark = df.sparkSession
    path = f"{within}/{name}-{uuid.uuid4().hex}" if within else shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What empties the memory of each operator's module in a Python worker.
_HOLDING: dict[str, Callable[[], None]] = {}


def holding(name: str, clear: Callable[[], None]) -> None:
    _HOLDING[name] = clear


def tidy(own: str = "") -> None:
    """Gives back to the system the memory that earlier tasks of a Python worker no longer need: workers live on from stage to stage. What an operator remembers
    (own) stays for its next tasks, what others do goes."""
    for name, clear in _HOLDING.items():
        if name != own:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """The name with underscores before it until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text):
    """Words between ASCII white space, lower-cased; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
