"""Matches of positions in order: islands of near positions, and greedy matching within them."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bucket.
BUCKET = 8192


def islands(rows: DataFrame, keys: list[str], at: str, gap: int, bucket: int = BUCKET) -> DataFrame:
    """Adds ``island``: the position (integer, each once for its keys) where a run begins in which no
    step is wider than ``gap``.  Sorted passes cover a bucket of positions, or a row for each bucket."""
    part = rows.withColumn("_b", F.floor(F.col(at) / bucket))
    over, inner = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys, "_b").orderBy(at)
    edge = part.groupBy(*keys, "_b").agg(F.max(at).alias("_last")).select(*keys, "_b", F.lag("_last").over(over).alias("_before"))
    before = F.coalesce(F.lag(at).over(inner), "_before")
    begun = part.join(edge, [*keys, "_b"]).withColumn("_prev", before)
    begun = begun.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col(at) - F.col("_prev") > gap), F.col(at)))
    last = begun.groupBy(*keys, "_b").agg(F.max("_start").alias("_s"))
    last = last.select(*keys, "_b", F.max("_s").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    run = F.max("_start").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return begun.join(last, [*keys, "_b"]).withColumn("island", F.coalesce(run, "_base")).drop("_b", "_before", "_prev", "_start", "_base")


def _matched(tolerance: int, kind: pa.DataType):
    """(key, gold, predicted) of rows (key, island, at, is_gold, is_predicted) that come sorted.  Holds
    the positions of one stretch of twice the tolerance."""

    def run(batches):
        out: list[tuple] = []
        free, golds, current = deque(), deque(), None

        def settle(g):
            while free and free[0] < g - tolerance:
                free.popleft()
            near = min(((abs(p - g), p) for p in free if p <= g + tolerance), default=None)
            if near:
                free.remove(near[1])
                out.append((current[0], g, near[1]))

        def flushed():
            key, gold, predicted = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array(gold, pa.int64()), pa.array(predicted, pa.int64())], ["key", "gold", "predicted"])

        for batch in batches:
            for key, island, at, is_gold, is_predicted in zip(*(batch.column(c).to_pylist() for c in ("key", "island", "at", "is_gold", "is_predicted"))):
                while golds and ((key, island) != current or golds[0] + tolerance < at):
                    settle(golds.popleft())
                if (key, island) != current:
                    free.clear()
                    current = (key, island)
                while not golds and free and free[0] < at - tolerance:
                    free.popleft()
                if is_gold:
                    golds.append(at)
                if is_predicted:
                    free.append(at)
            if len(out) > 10_000:
                yield flushed()
        while golds:
            settle(golds.popleft())
        yield flushed()

    return run


def boundary_matches(gold: DataFrame, predicted: DataFrame, doc: str, tolerance: int, bucket: int = BUCKET) -> DataFrame:
    """(doc, gold, predicted): one-to-one matches of positions (doc, position).  Gold positions take
    their turn in ascending order; each takes the nearest prediction within ``tolerance`` that is
    free, the earlier of two.  Repeated positions count once; null ones don't count.

    Positions further apart than the tolerance don't bear on each other, so a document is split at
    such gaps and its islands are dealt over tasks; an island is one sorted pass.
    """
    if tolerance < 0:
        raise ValueError("tolerance must be 0 or more")
    kind = gold.select(doc).schema[0].dataType
    flag = lambda df, g: df.select(F.col(doc).alias("key"), F.col("position").cast("long").alias("at"), F.lit(g).alias("is_gold"), F.lit(not g).alias("is_predicted"))
    both = flag(gold, True).unionByName(flag(predicted, False)).filter("at IS NOT NULL")
    both = both.groupBy("key", "at").agg(F.bool_or("is_gold").alias("is_gold"), F.bool_or("is_predicted").alias("is_predicted"))
    found = islands(both, ["key"], "at", tolerance, bucket).repartition("key", "island").sortWithinPartitions("key", "island", "at")
    from pyspark.sql.pandas.types import to_arrow_type

    rows = found.select("key", "island", "at", "is_gold", "is_predicted").mapInArrow(_matched(tolerance, to_arrow_type(kind)), f"key {kind.simpleString()}, gold long, predicted long")
    return rows.withColumnRenamed("key", doc)


def boundary_report(gold: DataFrame, predicted: DataFrame, doc: str, tolerance: int = 0) -> DataFrame:
    """(doc, gold, predicted, matched, precision, recall, f1) of documents with a boundary on either
    side; a ratio over none is 0."""
    per = lambda df, name: df.filter("position IS NOT NULL").groupBy(doc).agg(F.count_distinct("position").alias(name))
    counts = per(gold, "gold").join(per(predicted, "predicted"), doc, "full_outer")
    hits = boundary_matches(gold, predicted, doc, tolerance).groupBy(doc).agg(F.count("*").alias("matched"))
    out = counts.join(hits, doc, "left").fillna(0, ["gold", "predicted", "matched"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("matched"), F.col("predicted")), "recall": ratio(F.col("matched"), F.col("gold"))})
    f1 = F.when(F.col("matched") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select(doc, "gold", "predicted", "matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))
