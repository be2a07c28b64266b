"""A corpus pipeline of five operators; each stage gets what its predecessor kept.

All but the last stage return rows of ``documents`` as they came, with all their columns, whatever
these are called.  Rows with null ids, and null, empty or very long texts, are judged like others;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm import decontaminate, jaccard_join, mixing, quality, token_output
from clausemill.llm.common import save, table
from clausemill.llm.queries import labelled_domains


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null texts are judged as empty ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; of repeated
    rows one.  Documents without a word stay."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a document without a word holds none."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that languages come as near to their target weights as rates of
    at least 1 allow, so each clean document stays."""
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), least=1.0)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written in order of doc_id, null ids first; returns their digest, read back.  A
    text that is null or empty has the end id alone."""
    return token_output.encode_and_digest(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-id output", token_stage),
]

#: Trained trees, gradient steps and a tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs)
    return docs
