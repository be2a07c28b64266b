r"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 consecutive words of the benchmark items (an item of fewer
words, but not none, is one window).  Within each class of equal length the search keeps a
*shift table* over blocks of two words (how far the window may move when its last block is
this one; the largest shift where the block is in no pattern) and *buckets* of patterns by
the hash of their suffix block; candidates are confirmed by comparing their bytes.  Many
stretches of text are searched side by side, with a cursor for each.

The patterns are taken in blocks of at most ``PATTERNS_PER_BLOCK`` windows, so what is
broadcast is bounded; each block is searched in all documents, and a document's hits from
several blocks are merged by its row.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM, LOWER, WordHasher, mix, text_blocks, texts_of, word_borders

WINDOW = 10
PATTERNS_PER_BLOCK = 200_000
SHIFT_BITS = 18
STRETCH = 128
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_windows(text: str | None, n: int = WINDOW) -> set[tuple[str, ...]]:
    words = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _hash_words(hasher: WordHasher, words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return hasher(np.frombuffer(b"".join(data), np.uint8), ends - [len(w) for w in data], ends)


def _block_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + last)


class PatternClass:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, patterns: list[tuple[str, ...]], items: list[list[int]]):
        hasher = WordHasher()
        self.length = m = len(patterns[0])
        self.block = b = min(2, m)
        h = _hash_words(hasher, [w for p in patterns for w in p]).reshape(-1, m)
        self.most = m - b + 1
        self.shift = np.full(1 << SHIFT_BITS, self.most, np.uint8)
        for end in range(b - 1, m):
            slots = self._keys(h[:, end - b + 1], h[:, end]) & np.uint64((1 << SHIFT_BITS) - 1)
            np.minimum.at(self.shift, slots.astype(np.int64), m - 1 - end)
        suffix = self._keys(h[:, m - b], h[:, m - 1])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.first = suffix[order], h[order, 0]
        self.text = [" ".join(patterns[i]).encode() for i in order]
        self.items = [items[i] for i in order]

    def _keys(self, first, last):
        return _block_hash(first, last) if self.block == 2 else mix(last.copy())

    def search(self, h: np.ndarray):
        """Yields (end, pattern) of candidates whose suffix block and first word fit."""
        m, b = self.length, self.block
        if len(h) < m:
            return
        cursors = np.arange(m - 1, len(h), STRETCH)
        limits = np.minimum(cursors + STRETCH, len(h))
        mask = np.uint64((1 << SHIFT_BITS) - 1)
        while len(cursors):
            keys = self._keys(h[cursors - 1] if b == 2 else None, h[cursors])
            shift = self.shift[(keys & mask).astype(np.int64)].astype(np.int64)
            stop = np.flatnonzero(shift == 0)
            if len(stop):
                lo = np.searchsorted(self.suffix, keys[stop], "left")
                hi = np.searchsorted(self.suffix, keys[stop], "right")
                for k in np.flatnonzero(hi > lo):
                    end = int(cursors[stop[k]])
                    for pattern in lo[k] + np.flatnonzero(self.first[lo[k] : hi[k]] == h[end - m + 1]):
                        yield end, int(pattern)
            cursors = cursors + np.maximum(shift, 1)
            left = cursors < limits
            cursors, limits = cursors[left], limits[left]


def _searcher(tables):
    """Of each document: words, hit words as (first, last) runs, and items that occur."""

    def run(batches):
        classes, hasher = tables.value, WordHasher()
        for batch in batches:
            n_words, runs, items = [], [], []
            for _, raw, offsets in text_blocks(texts_of(batch)):
                data = LOWER[raw]
                starts, ends, first_word = word_borders(data, offsets, ALNUM)
                n_words.extend(np.diff(first_word).tolist())
                docs = len(offsets) - 1
                found: dict[int, tuple[list, set]] = {}
                h = hasher(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
                for c in classes:
                    for end, pattern in c.search(h):
                        begin = end - c.length + 1
                        doc = int(np.searchsorted(first_word, end, "right")) - 1
                        if begin < first_word[doc]:
                            continue
                        words = [data[starts[i] : ends[i]].tobytes() for i in range(begin, end + 1)]
                        if b" ".join(words) == c.text[pattern]:
                            spans, ids = found.setdefault(doc, ([], set()))
                            spans.append((begin - int(first_word[doc]), end - int(first_word[doc])))
                            ids.update(c.items[pattern])
                for doc in range(docs):
                    spans, ids = found.get(doc, ((), ()))
                    runs.append([x for span in merge_runs(spans) for x in span])
                    items.append(sorted(ids))
            keep = batch.drop_columns(["text"]) if "text" in batch.schema.names else batch
            keep = keep.append_column("n_words", pa.array(n_words, pa.int64()))
            keep = keep.append_column("runs", pa.array(runs, pa.list_(pa.int64())))
            yield keep.append_column("items", pa.array(items, pa.list_(pa.int64())))

    return run


def merge_runs(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merged_runs(sets):
    """What ``merge_runs`` does, of a column of flat lists, as a flat list."""
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def pairs(flat):
        at = F.sequence(F.lit(0), F.greatest(F.size(flat) - 2, F.lit(0)), F.lit(2))
        return F.when(F.size(flat) > 1, F.transform(at, lambda i: F.struct(F.get(flat, i).alias("a"), F.get(flat, i + 1).alias("b")))).otherwise(none)

    def step(out, p):
        last = F.get(out, F.size(out) - 1)
        wider = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], p["b"]).alias("b")))
        return F.when((F.size(out) > 0) & (p["a"] <= last["b"] + 1), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), wider)).otherwise(F.concat(out, F.array(p)))

    merged = F.aggregate(F.array_sort(F.flatten(F.transform(sets, pairs))), none, step)
    return F.flatten(F.transform(merged, lambda x: F.array(x["a"], x["b"])))


def _pattern_blocks(benchmark: DataFrame, n: int, most: int):
    """Reads the items one after the other and yields lists of pattern classes."""
    rows = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text").toLocalIterator()
    windows: dict[tuple[str, ...], set[int]] = {}

    def classes():
        by_length: dict[int, list] = {}
        for w in windows:
            by_length.setdefault(len(w), []).append(w)
        return [PatternClass(ws, [sorted(windows[w]) for w in ws]) for _, ws in sorted(by_length.items())]

    for item, text in rows:
        for w in item_windows(text, n):
            windows.setdefault(w, set()).add(item)
        if len(windows) >= most:
            yield classes()
            windows.clear()
    if windows:
        yield classes()


def find_contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, patterns_per_block: int = PATTERNS_PER_BLOCK) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_words, ``runs`` (flat
    list of first and last word of each run of hit words), ``items`` (sorted ids of the
    items with an occurring window) and n_hit.

    Null texts have no words; null doc_ids stay.  Items with a null id are ignored, and an
    id that occurs in several rows counts once.  An empty benchmark hits nothing.  Other
    columns of both tables are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = [spark.sparkContext.broadcast(c) for c in _pattern_blocks(benchmark, n, patterns_per_block)] or [spark.sparkContext.broadcast([])]
    if len(blocks) == 1:
        out = docs.mapInArrow(_searcher(blocks[0]), f"doc_id {kind}, n_words long, runs array<bigint>, items array<bigint>")
    else:
        # a pass for each block; equal rows have equal hits, and their number is that of any pass
        keyed = docs.withColumn("row", F.xxhash64("text"))
        schema = f"doc_id {kind}, row long, n_words long, runs array<bigint>, items array<bigint>"
        passes = [keyed.mapInArrow(_searcher(c), schema).withColumn("pass", F.lit(k)) for k, c in enumerate(blocks)]
        merged = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "row").agg(
            F.max("n_words").alias("n_words"),
            F.count(F.when(F.col("pass") == 0, 1)).cast("int").alias("rows"),
            F.collect_set("runs").alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        out = merged.withColumn("runs", _merged_runs(F.col("runs"))).withColumn("_", F.explode(F.sequence(F.lit(1), "rows"))).drop("row", "rows", "_")
    size = F.expr("aggregate(transform(runs, (x, i) -> if(i % 2 = 1, x + 1, -x)), 0L, (s, x) -> s + x)")
    return out.withColumn("n_hit", size)


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest that the query returns."""
    found = find_contamination(documents, benchmark)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, patterns_per_block: int = PATTERNS_PER_BLOCK) -> DataFrame:
    """The rows of ``documents``, with all their columns, that hold no occurrence of a
    benchmark window; without a shuffle."""
    spark = documents.sparkSession
    rows = documents.select(F.struct("*").alias("row"))
    for c in _pattern_blocks(benchmark, n, patterns_per_block):
        found = rows.mapInArrow(
            _searcher(spark.sparkContext.broadcast(c)),
            T.StructType([T.StructField("row", rows.schema["row"].dataType), *T._parse_datatype_string("n_words long, runs array<bigint>, items array<bigint>").fields]),
        )
        rows = found.filter(F.size("items") == 0).select("row")
    return rows.select("row.*")


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d
), occ AS (
  SELECT doc_id, item_id, i, pos_m.m
  FROM (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
        FROM pos, (SELECT DISTINCT m FROM pat) WHERE i + m - 1 <= len(w)) pos_m
  JOIN pat USING (m, p)
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
