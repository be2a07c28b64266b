"""Edits of page lists: (doc, page_index, ...) rows, dense from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed value: minutes counted for a correction
CORRECTION_MINUTES = 1.5


def reorder(pages: DataFrame, orders: DataFrame, doc: str) -> DataFrame:
    """Pages of each document in the order of ``orders`` (doc, page_order array).  A document
    whose order is no permutation of its pages keeps its own and has ``reordered`` false."""
    sizes = pages.groupBy(doc).agg(F.count("*").alias("_n"))
    asked = orders.join(sizes, doc).filter(F.array_sort("page_order") == F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: (i - 1).cast("int")))
    places = asked.select(doc, F.posexplode("page_order").alias("_to", "page_index"))
    moved = pages.join(places, [doc, "page_index"], "left")
    return moved.withColumn("reordered", F.col("_to").isNotNull()).withColumn("page_index", F.coalesce("_to", "page_index")).drop("_to")


def rotate(pages: DataFrame, turns: DataFrame, doc: str) -> DataFrame:
    """``rotation_deg`` of the pages that ``turns`` (doc, page_index, degrees) names."""
    return pages.join(turns, [doc, "page_index"], "left").withColumn("rotation_deg", F.coalesce("degrees", "rotation_deg")).drop("degrees")


def delete(pages: DataFrame, gone: DataFrame, doc: str) -> DataFrame:
    """Pages without those of ``gone`` (doc, page_index), numbered anew without gaps."""
    left = pages.join(gone.select(doc, "page_index").distinct(), [doc, "page_index"], "left_anti")
    return left.withColumn("page_index", (F.row_number().over(Window.partitionBy(doc).orderBy("page_index")) - 1).cast("int"))


def correction_minutes(corrections: DataFrame, doc: str) -> DataFrame:
    return corrections.groupBy(doc).agg((F.count_if("counted") * CORRECTION_MINUTES).alias("minutes"))
