"""Ordered unions, first occurrences and round-robin choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_flags(*groups: Column) -> Column:
    """Flags of several arrays in order, trimmed, each once; null if there are none."""
    none = F.array().cast("array<string>")
    flags = F.filter(F.transform(F.concat(*(F.coalesce(g, none) for g in groups)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(flags) > 0, F.array_distinct(flags))


def first_occurrences(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """The first row of each ``by`` in the order of ``order``, numbered by ``place`` within the
    first column of ``by``."""
    kept = rows.groupBy(*by).agg(F.min(F.struct(*order)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(by[0]).orderBy("_o", *by[1:]))
    return kept.withColumn(name, place).select(*by, name)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side alone, with side ``missing`` (of ``a`` only) or ``extra`` (of ``b`` only)."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def round_robin(rows: DataFrame, by: str, group: str, item: str, order: list[str], most: int) -> DataFrame:
    """Of (by, group, item): at most ``most`` different items of each ``by``, the first of each
    group in the order of groups, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(by, group).orderBy(*order))
    turns = rows.withColumn("_turn", turn).groupBy(by, item).agg(F.min(F.struct("_turn", group)).alias("_p"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_p", item))
    return turns.withColumn("place", place).filter(F.col("place") <= most).select(by, F.col(f"_p.{group}").alias(group), item, "place")


def dealt_items(findings: DataFrame, items: DataFrame, by: str, group: str, order: str, each: int) -> DataFrame:
    """Each finding (by, group, order) gets the next ``each`` items (group, item, ordinal from 1)
    of its group that no finding before it got."""
    turn = F.row_number().over(Window.partitionBy(by, group).orderBy(order))
    numbered = findings.withColumn("_turn", turn)
    lots = items.withColumn("_turn", F.floor((F.col("ordinal") - 1) / each) + 1)
    return numbered.join(lots, [group, "_turn"]).select(by, group, order, "item", "ordinal")


def curated_checkpoints(findings: DataFrame, topics: dict[str, list[str]], doc: str, order: list[str], limit: int = 3) -> DataFrame:
    """(doc, order, category, keys): in the order of a document's findings, each takes the first
    ``limit`` keys of its category's list that no finding of the document took before, whatever its
    category; findings for which none is left don't come.

    ``topics`` are lists by category, in order of priority, that may overlap.  Keys are compared
    without case and outer space; blank ones don't count.  A category's later findings get
    nothing once one got less than ``limit``, so that of each document and category only the first
    (longest list / limit) matter, and what the fold goes through is bounded by the lists.
    """
    lists = {c: list(dict.fromkeys(k for x in keys if (k := x.strip().casefold()))) for c, keys in topics.items()}
    lists = {c: keys for c, keys in lists.items() if keys}
    if not lists or limit <= 0:
        return findings.select(doc, *order, "category", F.array().cast("array<string>").alias("keys")).limit(0)
    turns = -(-max(map(len, lists.values())) // limit)
    turn = F.row_number().over(Window.partitionBy(doc, "category").orderBy(*order))
    first = findings.filter(F.col("category").isin(*lists)).withColumn("_turn", turn).filter(F.col("_turn") <= turns)
    rows = first.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*order, "category"))).alias("_rows"))
    known = F.create_map(*(x for c, keys in lists.items() for x in (F.lit(c), F.array(*map(F.lit, keys)))))
    none = F.array().cast("array<string>")
    kind = f"array<{first.select(F.struct(*order, 'category', none.alias('keys')).alias('x')).schema['x'].dataType.simpleString()}>"

    def step(acc, r):
        keys = F.slice(F.filter(F.element_at(known, r["category"]), lambda k: ~F.array_contains(acc["seen"], k)), 1, limit)
        taken = F.array(F.struct(*(r[c].alias(c) for c in order), r["category"].alias("category"), keys.alias("keys")))
        return F.struct(F.concat(acc["seen"], keys).alias("seen"), F.concat(acc["out"], taken).alias("out"))

    folded = F.aggregate("_rows", F.struct(none.alias("seen"), F.array().cast(kind).alias("out")), step)["out"]
    return rows.select(doc, F.inline(folded)).filter(F.size("keys") > 0)


def clauses_of(statuses: dict[str, Column], default: str) -> Column:
    """The first status whose condition holds."""
    (name, when), *more = statuses.items()
    return reduce(lambda acc, s: acc.when(s[1], s[0]), more, F.when(when, name)).otherwise(default)
