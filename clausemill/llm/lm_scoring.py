"""Language-model scores by stupid backoff, computed relationally.

Counts of words and of word pairs are tables keyed by hash.  With N words in all,

    S(w | v) = c(v w) / c(v)         if the pair occurs at least MIN_COUNT times,
               BACKOFF * c(w) / N    otherwise,

and S of a first word is c(w) / N.  The logarithm of a document's score is a sum over its
words and over its *kept* pairs alone, since a pair's value can be stated as the difference
to what backing off would give:

    sum_w tf(w) * ln(c(w) / N)  +  (n - 1) * ln(BACKOFF)
    + sum_{kept vw} tf(vw) * (ln(c(vw) / c(v)) - ln(c(w) / N) - ln(BACKOFF)).

So a document's n-grams are exploded, joined by key to one table of values and summed.  Pairs
are done in ``KEY_RANGES`` ranges of their key, one after the other, which divides the
shuffled volume that lies on disk at a time.  All documents are counted and scored.

Words are ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z; a word is known by a
64-bit hash.  A pair's key is ``v * STEP + w`` modulo 2^64, from which w follows by v, so that
its count row carries v alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, save
from .words import ALNUM, LOWER, WordHasher, mix, text_blocks, word_borders

BACKOFF, MIN_COUNT = 0.4, 2
KEY_RANGES = 3
STEP = np.uint64(0xD6E8FEB86659FD93)


def word_ids(raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher):
    """(ids of all words, index of each row's first word)."""
    data = LOWER[raw]
    starts, ends, first = word_borders(data, offsets, ALNUM)
    h = hasher(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    return h, first


def _keys(raw, offsets, hasher, order: int):
    """(row, key, first word) of each n-gram; a word's key is its id."""
    ids, first = word_ids(raw, offsets, hasher)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if order == 1:
        return row, ids, ids
    same = row[1:] == row[:-1]
    v, w = ids[:-1][same], ids[1:][same]
    return row[1:][same], v * STEP + w, v


def _in_range(keys: np.ndarray, part: int, ranges: int) -> np.ndarray:
    return mix(keys.copy()) % np.uint64(ranges) == np.uint64(part)


def _counts(order: int, part: int, ranges: int):
    """Counts of a batch's n-grams."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            keys, firsts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for _, raw, offsets in text_blocks(batch.column("text")):
                _, k, v = _keys(raw, offsets, hasher, order)
                if ranges > 1:
                    inside = _in_range(k, part, ranges)
                    k, v = k[inside], v[inside]
                keys.append(k)
                firsts.append(v)
            keys, at, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            v = np.concatenate(firsts)[at]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(v.view(np.int64))], ["key", "n", "v"])

    return run


def _exploded(order: int, part: int, ranges: int):
    """(key, row, tf): a row for each document and each of its different n-grams."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            names = np.asarray(batch.column("row"))
            for lo, raw, offsets in text_blocks(batch.column("text")):
                row, keys, _ = _keys(raw, offsets, hasher, order)
                if ranges > 1:
                    inside = _in_range(keys, part, ranges)
                    row, keys = row[inside], keys[inside]
                by = np.lexsort((keys, row))
                row, keys = row[by], keys[by]
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1]))) if len(row) else np.empty(0, np.int64)
                tf = np.diff(np.append(new, len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(names[lo + row[new]]), pa.array(tf.astype(np.int32))], ["key", "row", "tf"])

    return run


def _sizes(batches):
    for batch in batches:
        n = [np.diff(word_borders(LOWER[raw], offsets, ALNUM)[2]) for _, raw, offsets in text_blocks(batch.column("text"))]
        yield batch.select(["doc_id", "row"]).append_column("n_words", pa.array(np.concatenate(n) if n else np.empty(0, np.int64)))


def count_table(docs: DataFrame, order: int, part: int = 0, ranges: int = 1) -> DataFrame:
    """(key, n, v) of all n-grams of a range of keys; v is the first word."""
    rows = docs.select("text").mapInArrow(_counts(order, part, ranges), "key long, n long, v long")
    if order == 1:
        return rows.groupBy("key").agg(F.sum("n").alias("n"))
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("v").alias("v"))


def _second_words(batches):
    for batch in batches:
        key, v = (np.asarray(batch.column(c)).view(np.uint64) for c in ("key", "v"))
        yield batch.append_column("w", pa.array((key - v * STEP).view(np.int64)))


def _sums(docs: DataFrame, values: DataFrame, order: int, part: int = 0, ranges: int = 1) -> DataFrame:
    """(row, s) of n-grams that have a value."""
    rows = docs.select("row", "text").mapInArrow(_exploded(order, part, ranges), "key long, row long, tf int")
    return rows.join(values, "key").groupBy("row").agg(F.sum(F.col("tf") * F.col("value")).alias("s"))


def score_documents(documents: DataFrame, backoff: float = BACKOFF, min_count: int = MIN_COUNT, ranges: int = KEY_RANGES) -> DataFrame:
    """A row for each row of ``documents`` (doc_id, text): doc_id, n_words, log_score (natural
    logarithm, 0 without words) and mean_log_score (null without words), rounded to 6 places.

    Null texts have no words.  Null ids and repeated rows stay, and repeated rows are counted
    as often as they occur.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = save(docs.mapInArrow(_sizes, f"doc_id {kind}, row long, n_words long"))
    total = float(sizes.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    words = save(count_table(docs, 1))
    free_shuffles(spark)
    parts = [save(_sums(docs, words.select("key", F.log(F.col("n") / total).alias("value")), 1))]
    free_shuffles(spark)
    for part in range(ranges):
        pairs = count_table(docs, 2, part, ranges).filter(F.col("n") >= min_count)
        pairs = save(pairs.mapInArrow(_second_words, "key long, n long, v long, w long"))
        free_shuffles(spark)
        v, w = (words.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}")) for c in "vw")
        value = F.log(F.col("n") / F.col("n_v")) - F.log(F.col("n_w") / total) - math.log(backoff)
        values = save(pairs.join(v, "v").join(w, "w").select("key", value.alias("value")))
        parts.append(save(_sums(docs, values, 2, part, ranges)))
        free_shuffles(spark)
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    # rows that are equal in id and text share a key and were summed together
    sums = sums.groupBy("row").agg(F.sum("s").alias("s"))
    copies = sizes.groupBy("row").agg(F.count("*").alias("copies"))
    log = F.coalesce(F.col("s") / F.col("copies"), F.lit(0.0)) + F.greatest(F.col("n_words") - 1, F.lit(0)) * math.log(backoff)
    scored = sizes.join(sums.join(copies, "row"), "row", "left").withColumn("log_score", log)
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), mean.alias("mean_log_score"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT r, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d)
), c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {MIN_COUNT}),
total AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT r, sum(CASE WHEN t.v IS NULL THEN ln(a.n / total.n) WHEN c2.n IS NULL THEN ln({BACKOFF} * a.n / total.n) ELSE ln(c2.n / b.n) END) AS s
  FROM t CROSS JOIN total JOIN c1 a ON a.w = t.w LEFT JOIN c1 b ON b.w = t.v LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 6) AS log_score, CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_log_score
FROM d LEFT JOIN s USING (r)
"""
