"""Constraint, license and manifest audits: each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import UNKNOWN_TIER


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violation) for each rule whose condition holds for a row."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return rows.select(key, F.explode(found).alias("violation"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def leaked(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that occur on both sides of a split."""
    return a.select(key).intersect(b.select(key))


def missing_references(rows: DataFrame, known: DataFrame, column: str, key: str) -> DataFrame:
    return rows.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def license_audit(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Public items (item_id, public, source_ids) that cite a source without a known license,
    or one that the manifest (source_id, license) lacks."""
    cited = items.filter("public").select("item_id", F.explode("source_ids").alias("source_id"))
    joined = cited.join(sources.select("source_id", "license", F.lit(True).alias("listed")), "source_id", "left")
    problem = F.when(F.col("listed").isNull(), "source_not_listed").when(F.coalesce(F.trim("license"), F.lit("")).isin("", "unknown"), "license_unknown")
    return joined.select("item_id", "source_id", problem.alias("problem")).filter("problem IS NOT NULL")


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): missing, extra or changed, of two (path, hash) tables."""
    a, b = before.select("path", F.col("hash").alias("a")), after.select("path", F.col("hash").alias("b"))
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).filter("change IS NOT NULL")


def private_passages(texts: DataFrame, key: str, least: int = 120) -> DataFrame:
    """Lines with at least ``least`` Hangul syllables."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.withColumn("syllables", F.length(F.regexp_replace("text", "[^가-힣]", ""))).filter(F.col("syllables") >= least).drop("text")


def marker_leaks(surfaces: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Markers of a run that occur in its (key, surface, text)."""
    return surfaces.join(markers, key).filter(F.contains("text", F.col("marker"))).select(key, "surface", "marker")


def keep_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def status_ladder(rows: DataFrame, by: str, ladder: list[str]) -> DataFrame:
    """The most severe status of each group; states outside the ladder come last."""
    place = F.coalesce(*(F.when(F.col("status") == s, k) for k, s in enumerate(ladder)), F.lit(UNKNOWN_TIER))
    return rows.groupBy(by).agg(F.min_by("status", place).alias("status"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ladder))
