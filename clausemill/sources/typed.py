"""Typed loads that give bad rows back with reasons, and counts over several sources.

A source is read as text; each column is cast by itself, so one bad value names its column and
doesn't fail the load.  Rows without a problem go on; the others come back beside them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column: its type, whether it must be there, and what its value must be (reason: condition of
    the typed value)."""

    kind: str = "string"
    required: bool = True
    checks: dict = field(default_factory=dict)


def one_of(*values: str):
    return lambda c: c.isin(*values)


def prefixed(*prefixes: str):
    return lambda c: c.rlike("^(?:" + "|".join(prefixes) + ")")


def words_below(most: int):
    return lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) < most


def distinct_items(separators: str = "[;,|]"):
    return lambda c: F.size(F.filter(F.transform(F.split(c, separators), lambda x: F.trim(x)), lambda x: x != "")) > 0


#: What the four kinds of corpus rows must hold.
EVIDENCE = {
    "evidence_id": Field(), "title": Field(), "summary": Field(checks={"too long": words_below(15)}), "authority_tier": Field(checks={"not official": one_of("A1", "A2")}),
    "source_ids": Field(checks={"no source": distinct_items(), "not official": prefixed("A")}), "risk_categories": Field(checks={"no category": distinct_items()}), "year": Field("int", False, {"out of range": lambda c: c.between(1900, 2099)}),
}
CARD = {"card_id": Field(), "text": Field(), "source_ids": Field(checks={"official source": prefixed("B", "C")}), "score_eligible": Field("boolean", checks={"may not score": lambda c: ~c})}
CHECKLIST = {"item_id": Field(), "category": Field(checks={"unknown": prefixed("F[1-9]")}), "question": Field(), "source_ids": Field(checks={"official source": prefixed("B", "C")})}
GLOSSARY = {"canonical_id": Field(), "ko": Field(), "en": Field(required=False), "caveat": Field(), "is_evidence": Field("boolean", checks={"may not be evidence": lambda c: ~c})}


def typed(rows: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """``rows`` of text with the columns of ``fields`` typed, others as they were, and ``problems``:
    an array of ``column: reason``, empty for good rows.  Blank text is missing; a column that the
    source lacks is missing in every row."""
    given = {c.lower(): c for c in rows.columns}
    values: dict[str, Column] = {}
    problems: list[Column] = []
    for name, spec in fields.items():
        raw = F.nullif(F.trim(F.col(given[name.lower()]).cast("string")), F.lit("")) if name.lower() in given else F.lit(None).cast("string")
        value = raw.try_cast(spec.kind)
        values[name] = value
        if spec.required:
            problems.append(F.when(raw.isNull(), F.lit(f"{name}: missing")))
        problems.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{name}: not {spec.kind}")))
        problems += [F.when(value.isNotNull() & ~check(value), F.lit(f"{name}: {reason}")) for reason, check in spec.checks.items()]
    rest = [F.col(c) for c in rows.columns if c.lower() not in {n.lower() for n in fields} | {"problems"}]
    return rows.select(*(v.alias(n) for n, v in values.items()), *rest, F.array_compact(F.array(*problems)).alias("problems"))


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without ``problems``, and bad rows with them."""
    return rows.filter(F.size("problems") == 0).drop("problems"), rows.filter(F.size("problems") > 0)


def read_typed_jsonl(spark: SparkSession, path: str, fields: dict[str, Field]) -> DataFrame:
    """One object a line as ``typed`` rows; a line that isn't an object has the problem ``line: not
    an object`` and comes whole in ``line``, which is null otherwise.  Blank lines are passed over."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields] + [T.StructField("line", T.StringType())])
    text = spark.read.text(path).filter(F.trim("value") != "")
    parsed = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"}).alias("r")).select("r.*")
    out = typed(parsed, fields)
    bad = F.array(F.lit("line: not an object"))
    return out.withColumn("problems", F.when(F.col("line").isNotNull(), bad).otherwise(F.col("problems")))


def counts_by_source(sources: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(source, good, bad, expected, problem) of ``typed`` sources, all counted in one aggregate;
    ``problem`` is null where as many good rows as expected came."""
    names = list(sources)
    rows = None
    for n in names:
        part = sources[n].select(F.lit(n).alias("source"), (F.size("problems") > 0).alias("is_bad"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("source").agg(F.count_if(~F.col("is_bad")).alias("good"), F.count_if("is_bad").alias("bad"))
    wanted = rows.sparkSession.createDataFrame([(n, expected.get(n)) for n in names], "source string, expected long")
    out = wanted.join(counts, "source", "left").fillna(0, ["good", "bad"])
    problem = F.when(F.col("good") == 0, "no rows").when(F.col("good") != F.col("expected"), F.concat(F.lit("expected "), F.col("expected").cast("string")))
    return out.select("source", "good", "bad", "expected", problem.alias("problem"))
