"""Sources: delimited, line-JSON, YAML, binary and text inputs, and chunk projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hierarchy, lenient_bool, source_tier, split_list


class EmptySource(ValueError):
    """A source that must have rows has none."""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _needed(df: DataFrame, path: str, columns) -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks the columns {', '.join(lost)}")
    if df.isEmpty():
        raise EmptySource(path)
    return df


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """All columns as strings; a byte-order mark before the first header goes; no row is an error."""
    df = spark.read.options(header=True, encoding="UTF-8", multiLine=True, escape='"').csv(path)
    return _needed(df.toDF(*(c.lstrip("﻿").strip() for c in df.columns)), path, columns)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are passed over, a line that doesn't parse is an error."""
    return _needed(spark.read.schema(schema).option("mode", "FAILFAST").json(path), path, ())


def read_yaml_rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The list below ``key`` of a small YAML file, read through Spark as one text."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(yaml.safe_load(text)[key], schema)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, filename_hash) of images, PDFs and other uploads."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return df.select("path", "length", "content", F.sha2(F.substring_index("path", "/", -1), 256).alias("filename_hash"))


def parse_ocr_tsv(rows: DataFrame) -> DataFrame:
    """Spans of (page, line) TSV output: blank texts and negative or unreadable confidences go."""
    parts = F.split("line", "\t")
    text, conf = F.get(parts, F.lit(11)), F.get(parts, F.lit(10)).try_cast("double")
    at = lambda k: F.get(parts, F.lit(k)).try_cast("int")
    out = rows.select("page", at(6).alias("x"), at(7).alias("y"), F.greatest(at(8), F.lit(1)).alias("w"), F.greatest(at(9), F.lit(1)).alias("h"), conf.alias("conf"), text.alias("text"))
    return out.filter((F.trim("text") != "") & (F.col("conf") >= 0)).withColumn("confidence", F.col("conf") / 100).drop("conf")


def merge_pages(layers: list[DataFrame]) -> DataFrame:
    """Spans of text and OCR layers together with each page's mean confidence and size."""
    spans = reduce(DataFrame.unionByName, layers)
    pages = spans.groupBy("page").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"), F.count("*").alias("spans"))
    return pages


def evidence_chunks(rows: DataFrame) -> DataFrame:
    """Official evidence rows to chunks: A tiers may score."""
    ids, cats = split_list(F.col("source_ids")), split_list(F.col("risk_categories"))
    tier = source_tier(ids)
    return rows.select(
        F.col("evidence_id").alias("chunk_id"), F.lit("evidence").alias("chunk_type"), F.concat_ws(" ", "title", "summary").alias("text"), tier.alias("authority_tier"), ids.alias("source_ids"),
        cats.alias("risk_categories"), hierarchy(tier, ids, cats, F.col("evidence_id")).alias("hierarchy"), tier.startswith("A").alias("score_eligible"), lenient_bool(F.col("public")).alias("public_export"),
    )


def glossary_chunks(rows: DataFrame) -> DataFrame:
    """Glossary rows to chunks named after their canonical id; they never score."""
    ids, cats = split_list(F.col("source_ids")), split_list(F.col("risk_categories"))
    tier = source_tier(ids)
    chunk = F.concat(F.lit("GL-"), "canonical_id")
    return rows.select(
        chunk.alias("chunk_id"), F.lit("glossary").alias("chunk_type"), F.concat_ws(" ", "ko", F.coalesce(F.nullif(F.trim("en"), F.lit("")), F.col("alias")), "caveat").alias("text"), tier.alias("authority_tier"), ids.alias("source_ids"),
        cats.alias("risk_categories"), hierarchy(tier, ids, cats, chunk).alias("hierarchy"), F.lit(False).alias("score_eligible"), lenient_bool(F.col("public")).alias("public_export"),
    )


def _practice_chunks(rows: DataFrame, chunk, kind: str, *text: str) -> DataFrame:
    """Practice sources explain; they never score."""
    ids, cats = split_list(F.col("source_ids")), split_list(F.col("risk_categories"))
    tier = source_tier(ids)
    return rows.select(
        chunk.alias("chunk_id"), F.lit(kind).alias("chunk_type"), F.concat_ws(" ", *text).alias("text"), tier.alias("authority_tier"), ids.alias("source_ids"),
        cats.alias("risk_categories"), hierarchy(tier, ids, cats, chunk).alias("hierarchy"), F.lit(False).alias("score_eligible"), lenient_bool(F.col("public")).alias("public_export"),
    )


def card_chunks(rows: DataFrame) -> DataFrame:
    """Knowledge cards (card_id, title, text, ...) to chunks."""
    return _practice_chunks(rows, F.col("card_id"), "card", "title", "text")


def checklist_chunks(rows: DataFrame) -> DataFrame:
    """Checklist items (item_id, question, answer, ...) to chunks."""
    return _practice_chunks(rows, F.concat(F.lit("CL-"), "item_id"), "checklist", "question", "answer")


def corpus(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def chunk_violations(chunks: DataFrame) -> DataFrame:
    from ..operators.audit import violations

    a_tier = F.col("authority_tier").isin("A0", "A1", "A2")
    return violations(chunks, "chunk_id", {
        "blank_text": F.coalesce(F.trim("text") == "", F.lit(True)), "eligible_without_official_tier": F.col("score_eligible") & ~a_tier,
        "eligible_not_evidence": F.col("score_eligible") & (F.col("chunk_type") != "evidence"), "no_source": F.size("source_ids") == 0, "glossary_with_official_tier": (F.col("chunk_type") == "glossary") & a_tier,
    })


def count_check(actual: dict[str, DataFrame], expected: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Tables whose row count isn't the one expected."""
    return {n: (c, expected[n]) for n, df in actual.items() if n in expected and (c := df.count()) != expected[n]}
