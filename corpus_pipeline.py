"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate group stays, personal data is masked, and the rest is packed.

STAGES are (name, function of spark, docs and sf_dir). Each one's result is written as Parquet and read again as the next one's documents; all but the last return the columns of documents.
Learnt models are fitted to the tables of sf_dir. SQL can't express the stages, so ORACLE_SQL is None; tests/llm/test_pipeline.py holds each stage against a version without Spark.

Defined results: null texts stay null in every stage and are packed as the end token alone; they, empty texts and short ones are near duplicates of nothing that isn't equal to them, and null
or blank ones of nothing at all. Rows that repeat an id are one document: they stay or go together, and all that stay are packed. Rows without an id are no near duplicates of others and
stay. Columns other than those of documents go, whatever their names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm import jaccard, lines, packing, pii, toxicity
from docket.llm.common import discard, prepare, stored, table
from docket.sources.tables import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars counted anew; a null text keeps what it had."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _counted(lines.drop_boilerplate(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of links stays."""
    prepare(spark)
    gone = jaccard.similarity_components(docs).filter("component_id <> doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(stored(gone, "gone"), "doc_id", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _counted(pii.redact(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of sf_dir. A stage's documents go once the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        where = shared_folder(spark, f"stage-{name}")
        docs = stored(stage(spark, docs, sf_dir), "documents", where)
        if before:
            discard(spark, before)
        before = where
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
