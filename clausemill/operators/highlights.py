"""Source highlights: covering ranges to display segments, and text edits by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def span_offsets(spans: DataFrame, doc: str) -> DataFrame:
    """Adds a span's offset in the document's text, spans being joined by one character."""
    w = Window.partitionBy(doc).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int"))


def segments(texts: DataFrame, ranges: DataFrame, doc: str) -> DataFrame:
    """Elementary segments (start, end, labels) of a text under labelled ranges (start, end,
    label).  Borders are events of +1 and -1 for each label; running sums tell which labels are
    open, so no range is compared with a segment.

    Joins are by document and grow with the texts on both sides.  They ask for a merge, since Spark
    takes rows that a generator made for few, and would send them whole through the driver."""
    inside = ranges.join(texts.select(doc, F.length("text").alias("_len")).hint("merge"), doc).filter("start >= 0 AND start < end AND end <= _len")
    labels = inside.select(doc, "label").distinct()
    events = inside.select(doc, "label", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(doc, "label", "e.*")
    ends = texts.select(doc, F.explode(F.array_distinct(F.array(F.lit(0), F.length("text")))).alias("at"))
    cuts = events.select(doc, "at").unionByName(ends).distinct()
    w = Window.partitionBy(doc).orderBy("at")
    parts = cuts.select(doc, F.col("at").alias("start"), F.lead("at").over(w).alias("end")).filter("end IS NOT NULL")
    # one running sum for each label of a document
    grid = parts.join(labels.hint("merge"), doc).select(doc, "label", F.col("start").alias("at"), "end", F.lit(0).alias("d"))
    moves = events.groupBy(doc, "label", "at").agg(F.sum("d").alias("d")).withColumn("end", F.lit(None).cast("int"))
    run = Window.partitionBy(doc, "label").orderBy("at", F.col("end").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = grid.unionByName(moves).withColumn("n", F.sum("d").over(run)).filter("end IS NOT NULL AND n > 0")
    marked = open_.groupBy(doc, F.col("at").alias("start")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return parts.join(marked.hint("merge"), [doc, "start"], "left").select(doc, "start", "end", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def merge_equal(parts: DataFrame, doc: str) -> DataFrame:
    """Neighbouring segments with equal labels become one."""
    w = Window.partitionBy(doc).orderBy("start")
    # a window function may not hold another one: first the change, then its sum
    step = parts.withColumn("_c", F.when(F.lag("labels").over(w).eqNullSafe(F.col("labels")), 0).otherwise(1))
    step = step.withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return step.groupBy(doc, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("labels").alias("labels")).drop("_g")


def apply_corrections(spans: DataFrame, corrections: DataFrame) -> DataFrame:
    """Spans with the text of their latest correction (span_id, revision, corrected_text); of equal
    revisions the larger text counts."""
    last = corrections.groupBy("span_id").agg(F.max_by("corrected_text", F.struct("revision", "corrected_text")).alias("corrected_text"))
    return spans.join(last.hint("merge"), "span_id", "left").withColumn("text", F.coalesce("corrected_text", "text")).drop("corrected_text")
