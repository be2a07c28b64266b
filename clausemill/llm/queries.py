"""The queries of this subpackage: {name: function(spark, sf_dir)} and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, licenses, lm_scoring, mixing, neighbours, quality, simhash, spelling, token_output, toxicity, url_filter, whitening
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.document_rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing query: the language of the rows that ``labels`` covers."""
    return labels.select("doc_id").distinct().join(docs.select("doc_id", docs["lang"].alias("domain")), "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_digest(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_output": op5_token_output,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_neighbours": op9_neighbours,
    "op10_licenses": op10_licenses,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL = {
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op4_lm_scoring": lm_scoring.ORACLE_SQL,
    "op6_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_licenses": licenses.oracle_sql(),
    "op13_spelling": spelling.ORACLE_SQL,
}
