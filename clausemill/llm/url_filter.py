r"""URL filters as a sort-merge range join.

A rule (host, path) fits a url if the url's host is the rule's host or one of its
subdomains and the url's path starts with the rule's path; the longest rule string
``host + path`` wins, then the longer host, then the verdict that sorts last (block).

Hosts become reversed keys (``www.a.com`` -> ``com.a.www.``), so that a rule's host and
its subdomains are one interval of keys.  Urls and rules are cut into ranges of keys, each
rule being sent to every range that its interval meets; within a range a sorted sweep
keeps the stack of host intervals that are open, each with its path rules.  A hot host is
spread over several ranges, since path and page id belong to the sort key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); the rules that the query applies.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT_VERDICT = "allow"
#: Keys drawn for each range to place its borders; borders affect balance alone.
KEYS_PER_RANGE = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_url_parts(pages: DataFrame, url: Column) -> DataFrame:
    """Adds host and path.  Null or no ``://``: both empty."""
    rest = F.when(F.instr(F.col("_url"), "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return (
        pages.withColumn("_url", F.coalesce(url, F.lit("")))
        .withColumn("_rest", rest)
        .withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
        .withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0))
        .withColumn("host", F.translate("_host", UPPER, LOWER))
        .drop("_url", "_rest", "_host")
    )


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _ranges(borders: list[str], is_rule: bool):
    """Adds the range of a url's key, or one row for each range that a rule's interval meets."""

    def assign(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            rows, ranges = [], []
            if is_rule:
                for i, key in enumerate(keys):
                    # "." is followed by "/": every key that starts with key lies in [key, end)
                    for r in range(bisect_right(borders, key), bisect_left(borders, key[:-1] + "/") + 1):
                        rows.append(i)
                        ranges.append(r)
                batch = batch.take(pa.array(rows, pa.int64()))
            else:
                ranges = [bisect_right(borders, key) for key in batch.column("sort_key").to_pylist()]
            yield batch.append_column("range", pa.array(ranges, pa.int32()))

    return assign


class _OpenHost:
    """An open host interval with the path rules of that very host."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        if path not in self.rules or self.rules[path][1] < verdict:
            self.rules[path] = (host + path, verdict)
        self.lengths = sorted({len(p) for p in self.rules}, reverse=True)

    def longest(self, path: str):
        for n in self.lengths:
            if n <= len(path) and (hit := self.rules.get(path[:n])):
                return hit
        return None


def _sweep(columns: list[str]):
    """Rows come sorted by (range, key, kind): rules before the urls that they may fit."""

    def sweep(batches):
        stack: list[_OpenHost] = []
        current = None
        for batch in batches:
            get = {name: batch.column(name).to_pylist() for name in ("range", "key", "is_url", "host", "path", "verdict")}
            keep, rules, verdicts = [], [], []
            for i, (rng, key, is_url, host, path, verdict) in enumerate(zip(*get.values())):
                if rng != current:
                    current, stack = rng, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1].key != key:
                        stack.append(_OpenHost(key))
                    stack[-1].add(host, path, verdict)
                    continue
                best = None
                for entry in reversed(stack):  # deepest host first: it wins a tie of lengths
                    hit = entry.longest(path)
                    if hit and (best is None or len(hit[0]) > len(best[0])):
                        best = hit
                keep.append(i)
                rules.append(best and best[0])
                verdicts.append(best and best[1])
            out = batch.select(columns).take(pa.array(keep, pa.int64()))
            out = out.append_column("rule", pa.array(rules, pa.string()))
            yield out.append_column("rule_verdict", pa.array(verdicts, pa.string()))

    return sweep


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judges every url of ``pages`` (page_id, url) by ``rules`` (host, path, verdict).

    Returns page_id, host, path, rule (null where none fits) and verdict, a row for each
    row of ``pages``; other columns are ignored.  Null urls and ids stay, with empty host
    and path.  Rules with a null part are ignored; of rules with the same host and path the
    verdict that sorts last wins.  Empty tables give an empty result or default verdicts.
    """
    spark = pages.sparkSession
    page_type = pages.schema["page_id"].dataType
    urls = with_url_parts(pages.select("page_id", F.col("url").cast("string").alias("url")), F.col("url")).drop("url")
    urls = urls.withColumn("key", reversed_host(F.col("host")))
    tie = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")
    urls = urls.withColumn("sort_key", F.concat_ws("\0", "key", "path", tie))

    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    count = pages.count()
    share = min(1.0, KEYS_PER_RANGE * ranges / max(1, count))
    drawn = sorted(r[0] for r in urls.select("sort_key").sample(share, seed=7).collect())
    borders = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []

    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict"
    ).withColumn("key", reversed_host(F.col("host")))
    fields = [("page_id", page_type.simpleString()), ("host", "string"), ("path", "string"), ("key", "string"), ("sort_key", "string"), ("is_url", "int"), ("verdict", "string")]
    left = urls.withColumns({"is_url": F.lit(1), "verdict": F.lit(None).cast("string")})
    right = rules.withColumns({"is_url": F.lit(0), "page_id": F.lit(None).cast(page_type), "sort_key": F.col("key")})
    schema = ", ".join(f"{n} {t}" for n, t in fields) + ", range int"
    names = [n for n, _ in fields]
    both = left.select(names).mapInArrow(_ranges(borders, False), schema).unionByName(
        right.select(names).mapInArrow(_ranges(borders, True), schema)
    )
    swept = (
        both.repartition(ranges, "range")
        .sortWithinPartitions("range", "key", "is_url")
        .mapInArrow(_sweep(["page_id", "host", "path"]), f"page_id {page_type.simpleString()}, host string, path string, rule string, rule_verdict string")
    )
    return swept.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged AS (
  SELECT page_id, host, path,
         (SELECT max_by(struct_pack(r := h || p, v := v), length(h || p) * 1000 + length(h)) FROM rules
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS hit
  FROM urls
)
SELECT page_id, host, path, hit.r AS rule, coalesce(hit.v, 'allow') AS verdict FROM judged
"""
