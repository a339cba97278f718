"""The registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import bpe, divergence, fingerprints, interactions, jaccard, lines, neighbours, packing, pii, suffixes, tokens, toxicity, urls
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), "score", "predicted", "toxic_spans")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.labelled(pages, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.drop_repeats(table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.diverge(table(spark, sf_dir, "documents"))


_ALL = (
    op1_fingerprints, op2_line_dedup, op3_nearest_neighbours, op4_best_fit_packing, op5_byte_bpe, op6_pii, op7_jaccard_join, op8_toxicity, op9_url_filter, op10_token_counts,
    op11_filter_interactions, op12_suffix_dedup, op13_source_divergence,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op2_line_dedup": lines.ORACLE_SQL, "op9_url_filter": urls.ORACLE_SQL, "op11_filter_interactions": interactions.ORACLE_SQL, "op12_suffix_dedup": suffixes.ORACLE_SQL, "op13_source_divergence": divergence.ORACLE_SQL}
