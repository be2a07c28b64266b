"""Clause segmentation: spans to lines, lines to clauses, boundary metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: line starts that open a clause (articles first, then numbered and lettered items), and what a marker counts
ARTICLE = r"(?iuU)^\s*(?:제\s*[0-9]+\s*조(?:\s*[({（][^)}）]+[)}）])?|(?:Article|Section|Clause)\s+[0-9]+[A-Za-z0-9_.-]*)\b"
SUBCLAUSE = r"(?U)^\s*(?:[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|\(\s*[0-9]+\s*\)|\(\s*[A-Za-z가-힣]\s*\)|[0-9]+(?:\.[0-9]+)*[.)]|[A-Za-z가-힣][.)])\s+"
MARKED, UNMARKED = 1.0, 0.55


def text_lines(documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, line, text, confidence): the lines of pasted texts that aren't blank, from 0.  A
    pasted line is a span of its own, so nothing has to be clustered."""
    lines = F.filter(F.split(F.col("text"), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: F.trim(x) != "")
    return documents.select(doc, F.posexplode(lines).alias("line", "text")).withColumn("confidence", F.lit(1.0))


def marker(text: Column) -> Column:
    return F.when(text.rlike(ARTICLE), "article").when(text.rlike(SUBCLAUSE), "subclause")


def clauses(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A clause begins at a marked line, the document's first line apart; texts are joined by
    line feeds; the heading is a marked first line."""
    order = Window.partitionBy(doc).orderBy("line")
    opens = (F.col("marker").isNotNull() & (F.row_number().over(order) > 1)).cast("int")
    numbered = lines.withColumn("marker", marker(F.col("text"))).withColumn("opens", opens)
    numbered = numbered.withColumn("clause", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("line", "text", "marker")))
    out = numbered.groupBy(doc, "clause").agg(rows.alias("_r"), F.avg("confidence").alias("_c"))
    first = F.col("_r")[0]
    score = F.when(first["marker"].isNotNull(), MARKED).otherwise(UNMARKED)
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.85 * F.col("_c") + 0.15 * score))
    return out.select(
        doc,
        "clause",
        first["line"].alias("first_line"),
        F.size("_r").alias("n_lines"),
        F.when(first["marker"].isNotNull(), first["text"]).alias("heading"),
        F.array_join(F.transform("_r", lambda x: x["text"]), "\n").alias("text"),
        F.transform("_r", lambda x: x["line"]).alias("line_ids"),
        F.round(confidence, 6).alias("seg_confidence"),
    )


def boundary_scores(gold: DataFrame, predicted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Precision, recall and F1 of boundaries (doc, position) that agree exactly, over all
    documents; without any boundary on either side they are 1."""
    g, p = gold.select(doc, "position").distinct(), predicted.select(doc, "position")
    both = g.join(p.distinct(), [doc, "position"]).agg(F.count("*").alias("hit"))
    counts = g.agg(F.count("*").alias("gold")).crossJoin(p.agg(F.count("*").alias("predicted"))).crossJoin(both)  # single rows
    none = (F.col("gold") == 0) & (F.col("predicted") == 0)
    ratio = lambda a, b: F.when(none, 1.0).when(b == 0, 0.0).otherwise(a / b)
    precision, recall = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("gold"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    out = counts.withColumns({"precision": precision, "recall": recall})
    return out.select("gold", "predicted", "hit", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def line_clusters(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (text, x, y, h, confidence) of a page to lines: sorted by vertical centre and x, a
    span joins the nearest line within max(8, 0.65 * smaller height); a line's centre and height
    are means of its members.  A page's spans are one array; pages are bounded."""
    kind = "array<struct<centre:double,height:double,n:int,members:array<struct<x:int,text:string,confidence:double>>>>"
    ordered = F.array_sort(F.collect_list(F.struct((F.col("y") + F.col("h") / 2.0).alias("c"), "x", F.greatest(F.col("h").cast("double"), F.lit(1.0)).alias("h"), "text", F.col("confidence").cast("double").alias("confidence"))))

    def step(lines, s):
        member = F.array(F.struct(s["x"].cast("int").alias("x"), s["text"].alias("text"), s["confidence"].alias("confidence")))
        far = lambda line: F.abs(line["centre"] - s["c"])
        near = F.array_min(F.filter(F.transform(lines, lambda line, i: F.struct(far(line).alias("d"), i.alias("i"), line["height"].alias("h"))), lambda z: z["d"] <= F.greatest(F.lit(8.0), 0.65 * F.least(s["h"], z["h"]))))
        new = F.concat(lines, F.array(F.struct(s["c"].alias("centre"), s["h"].alias("height"), F.lit(1).alias("n"), member.alias("members"))))
        grown = F.transform(
            lines,
            lambda line, i: F.when(
                i == near["i"],
                F.struct(
                    ((line["centre"] * line["n"] + s["c"]) / (line["n"] + 1)).alias("centre"), ((line["height"] * line["n"] + s["h"]) / (line["n"] + 1)).alias("height"),
                    (line["n"] + 1).alias("n"), F.concat(line["members"], member).alias("members"),
                ),
            ).otherwise(line),
        )
        return F.when(near.isNull(), new).otherwise(grown)

    pages = spans.filter(F.trim("text") != "").groupBy(*keys).agg(ordered.alias("_s"))
    lines = F.aggregate("_s", F.array().cast(kind), step)
    found = pages.select(*keys, F.posexplode(F.array_sort(lines)).alias("line", "l"))
    members = F.array_sort(F.col("l.members"))
    mean = F.aggregate(members, F.lit(0.0), lambda a, m: a + m["confidence"]) / F.size(members)
    return found.select(*keys, "line", F.array_join(F.transform(members, lambda m: m["text"]), " ").alias("text"), F.round(mean, 6).alias("confidence"))
