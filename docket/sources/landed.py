"""Landed files as a source: whole files with their path and time, decoded by the contract of the channel that they came from; what can't be read is a table of its own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import CONTRACT, candidates, decode

FILES = "path string, modificationTime timestamp, length long, content binary"


@dataclass(frozen=True)
class Channel:
    """How a channel's files are read: the contract of its records, and the pattern of names of its listing pages, whose first group is the page's number."""

    name: str
    contract: dict = field(default_factory=lambda: CONTRACT)
    pages: str = r"page=(\d+)"


_CHANNELS: dict[str, Channel] = {}


def register(channel: Channel) -> Channel:
    """Makes a channel known by its name; one name stands for one channel."""
    if _CHANNELS.get(channel.name, channel) != channel:
        raise ValueError(f"another channel is called {channel.name}")
    return _CHANNELS.setdefault(channel.name, channel)


def channel(name: str) -> Channel:
    if name not in _CHANNELS:
        raise ValueError(f"no channel {name}; there are {sorted(_CHANNELS)}")
    return _CHANNELS[name]


def files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, modificationTime, length, content of all files under a path, at once or as they arrive."""
    reader = spark.readStream.schema(FILES) if stream else spark.read
    return reader.format("binaryFile").option("recursiveFileLookup", True).load(path)


def pack(pages: DataFrame, path: str) -> str:
    """Lands many small files (path, content) as few large ones: a row for each with its path, time, length and bytes. A file of a file system costs some milliseconds to make, list and open, whatever it holds."""
    rows = pages.select("path", F.current_timestamp().alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content")
    rows.write.mode("append").parquet(path)
    return path


def packed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The columns of files() of what was packed, at once or as it arrives."""
    return (spark.readStream if stream else spark.read).schema(FILES).parquet(path)


def _body() -> Column:
    return F.try_validate_utf8(F.col("content").cast("string"))


def records(landed: DataFrame, of: Channel) -> DataFrame:
    """path, landed_at, sha256, decoded and the contract's fields of files that hold a record each."""
    rows = landed.select("path", F.col("modificationTime").alias("landed_at"), F.sha2("content", 256).alias("sha256"), "content")
    return decode(rows, contract=of.contract).drop("content")


def listed(landed: DataFrame, of: Channel) -> DataFrame:
    """page, idx, source_ref, sygnatury, data_wydania, good of the records of listing pages."""
    page = F.regexp_extract("path", of.pages, 1).try_cast("long")
    return candidates(landed.select(page.alias("page"), _body().alias("body")).filter("page is not null"))


def rejects(landed: DataFrame, of: Channel) -> DataFrame:
    """path, sha256, length, reason of files that aren't listing pages that can be read: a name without a number, no text, no JSON, or no list of records."""
    value = F.try_parse_json(_body())
    is_list = F.schema_of_variant(F.try_variant_get(value, "$.data", "variant")).startswith("ARRAY")
    reason = (
        F.when(F.regexp_extract("path", of.pages, 1) == "", "name").when(_body().isNull(), "not text").when(value.isNull(), "not JSON").when(~F.coalesce(is_list, F.lit(False)), "no list")
    )
    return landed.select("path", F.sha2("content", 256).alias("sha256"), "length", reason.alias("reason")).filter("reason is not null")
