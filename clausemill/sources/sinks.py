"""Sinks: reports as JSON, Markdown and HTML rows, and projections that are safe to log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of a field's ``privacy`` metadata that logs may not hold, and keys of raw images.
PRIVATE_LEVELS = ("P2", "P3")
RAW_KEYS = ("raw_image", "image_bytes", "content", "thumbnail")


def log_safe(df: DataFrame) -> DataFrame:
    """Only columns whose metadata doesn't mark them private."""
    return df.select(*(f.name for f in df.schema.fields if f.metadata.get("privacy") not in PRIVATE_LEVELS))


def marked(df: DataFrame, **levels: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c, metadata={"privacy": levels[c]}) if c in levels else F.col(c) for c in df.columns))


def _scrubbed(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        kept = [_scrubbed(column[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in RAW_KEYS]
        return F.when(column.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _scrubbed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(column, lambda k, _: ~k.isin(*RAW_KEYS)) if isinstance(kind.keyType, T.StringType) else column
        return F.transform_values(kept, lambda _, v: _scrubbed(v, kind.valueType))
    return column


def without_raw(df: DataFrame) -> DataFrame:
    """``df`` without keys of raw images, at any depth of structs, arrays and maps."""
    return df.select(*(_scrubbed(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in RAW_KEYS))


def json_reports(df: DataFrame, key: str) -> DataFrame:
    """(key, payload): a row's other columns as JSON with sorted keys and its digest."""
    body = F.to_json(F.struct(*sorted(c for c in without_raw(df).columns if c != key)))
    return df.select(key, body.alias("payload"), F.sha2(body, 256).alias("payload_sha256"))


def markdown(title: Column, items: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))


def html(title: Column, items: Column) -> Column:
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<h1>"), safe(title), F.lit("</h1><ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), safe(x), F.lit("</li>"))), ""), F.lit("</ul>"))


def write_bundle(reports: DataFrame, path: str, formats=("json", "markdown", "html"), key: str = "doc_id") -> None:
    """Writes (key, title, items) in each format, as tables of one text a row."""
    if "json" in formats:
        json_reports(reports, key).write.mode("overwrite").json(f"{path}/json")
    for name, render in (("markdown", markdown), ("html", html)):
        if name in formats:
            reports.select(key, render(F.col("title"), F.col("items")).alias("body")).write.mode("overwrite").parquet(f"{path}/{name}")
