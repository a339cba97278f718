"""Reading tables by name, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Own folders by application, where nothing names one.
_OWN: dict[str, str] = {}
#: What was built from the tables of a folder, by application, folder and name.
_BUILT: dict[tuple[str, str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the cluster names in spark.checkpoint.dir, which goes when the driver ends; where that is unset and everything runs in one machine, as in tests, in a
    local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="docket-"))
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(to)
    return path


def stored_once(spark: SparkSession, sf_dir: str, name: str, build):
    """What build(path) gives for a new shared folder, built at its first use in an application: tables that serve many queries over the same input."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _BUILT:
        _BUILT[at] = build(shared_folder(spark, name))
    return _BUILT[at]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
