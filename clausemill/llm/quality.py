"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on statistics of labelled rows; every path from a root to a node
becomes a conjunctive rule; a lasso logistic regression keeps few of the rules and weighs
them; the kept rules are compiled into one Spark column expression.

Labels come from training rows only (``common.fold``), at most ``LABELLED_ROWS`` of them.
Inputs of a score are statistics of the text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, fold, one_a_document, save, training_labels
from .words import LOWER, NON_SPACE, WordHasher, mix, text_blocks, texts_of, word_borders

#: Bound of the sample of labelled rows that the model is fitted on.
LABELLED_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.001, 17
THRESHOLD = 0.5

_CLASSES = ("upper", "lower", "digit", "wide", "stop", "symbol", "bang", "bar", "other", "space")


def _class_of(b: int) -> int:
    c = chr(b)
    if "A" <= c <= "Z":
        return 0
    if "a" <= c <= "z":
        return 1
    if "0" <= c <= "9":
        return 2
    if b >= 128:
        return 3
    if c in ".,;:'\"()-?":
        return 4
    if c in "#$%&*@^~+=<>":
        return 5
    if c == "!":
        return 6
    if c in "|\\/_{}[]":
        return 7
    return 9 if c.isspace() else 8


CLASS = np.array([_class_of(b) for b in range(256)], np.int64)
NOT_NEWLINE = np.array([b != 10 for b in range(256)])
STATS = [
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "same_as_last", "top_pair", "symbol_end", "short_words", "capital_words",
    "words_per_line", "repeated_lines", "stops_per_word",
]


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each row has."""
    keys = np.unique(mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(rows[keys], minlength=n)


def block_stats(raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """Statistics of each row of a block, in the order of ``STATS``; an empty text has zeros."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    counts = np.bincount(row * len(_CLASSES) + CLASS[raw], minlength=n * len(_CLASSES)).reshape(n, -1)
    data = LOWER[raw]
    starts, ends, first = word_borders(data, offsets, NON_SPACE)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    per = 1.0 / np.maximum(words, 1)
    h = hasher(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    length = ends - starts
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)

    def count(mask):
        return np.bincount(doc[mask], minlength=n)

    follows = np.zeros(len(h), bool)
    second = np.zeros(len(h), bool)
    if len(h) > 1:
        follows[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    if len(h) > 2:
        second[2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
    last = CLASS[raw[ends - 1]] if len(ends) else np.empty(0, np.int64)
    lead = CLASS[raw[starts]] if len(starts) else np.empty(0, np.int64)
    a, b, lines_first = word_borders(data, offsets, NOT_NEWLINE)
    lines = np.diff(lines_first)
    line_doc = np.repeat(np.arange(n), lines)
    line_hash = hasher(data, a, b) if len(a) else np.empty(0, np.uint64)
    out = [
        *(counts / np.maximum(sizes, 1)[:, None]).T,
        np.log1p(sizes), np.log1p(words), np.bincount(doc, length, n) * per, np.log1p(longest),
        _distinct(doc, h, n) / np.sqrt(np.maximum(words, 1)), count(follows) * per, count(second) * per, count(last == 5) * per, count(length <= 3) * per, count(lead == 0) * per,
        np.log1p(words / np.maximum(lines, 1)), 1 - _distinct(line_doc, line_hash, n) / np.maximum(lines, 1), counts[:, 4] * per,
    ]
    return np.stack(out, axis=1)


def _stats(batches):
    hasher = WordHasher()
    for batch in batches:
        parts = [block_stats(raw, offsets, hasher) for _, raw, offsets in text_blocks(batch.column("text"))]
        m = np.concatenate(parts) if parts else np.empty((0, len(STATS)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(m[:, k]) for k in range(len(STATS)))], ["doc_id", *STATS])


def text_stats(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_stats, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is upper bound, border)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for stat, upper, border in self.terms:
            out = out & ((F.col(stat) <= border) if upper else (F.col(stat) > border))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The compiled score over statistic columns."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def tree_rules(tree_text: str) -> set[Rule]:
    """The paths of a tree as Spark prints it (``If (feature 3 <= 0.5)`` ... ``Else``)."""
    found, path = set(), []
    for line in tree_text.split("\n"):
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, STATS[int(m[3])], m[4] == "<=", float(m[5]))]
        tight: dict[tuple[str, bool], float] = {}
        for _, stat, upper, border in path:
            pick = min if upper else max
            tight[stat, upper] = pick(border, tight.get((stat, upper), border))
        found.add(Rule(tuple(sorted((s, u, b) for (s, u), b in tight.items()))))
    return found


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED_ROWS) -> RuleEnsemble:
    """Fits on training rows of ``labels``.  Without labelled rows, or with labels of one
    kind, the score is the constant share of label 1 (0.5 without any)."""
    train = training_labels(labels, label, most)
    rows = save(stats.join(F.broadcast(train), "doc_id"))  # at most `most` ids are broadcast
    rows = one_a_document(rows, *STATS)
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = (ones / n) if n else 0.5
        return RuleEnsemble((), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    few = rows.coalesce(4)
    vectors = VectorAssembler(inputCols=STATS, outputCol="features").transform(few).select("features", "label").cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=SEED).fit(vectors)
    vectors.unpersist()
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)}, key=lambda r: r.terms)
    bits = few.select(array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"), "label").cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(bits)
    bits.unpersist()
    drop_saved(rows)
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-6)
    return RuleEnsemble(kept, float(lasso.intercept))


def score_quality(documents: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """A row for each row of ``documents`` (doc_id, text): doc_id, held_out, score in [0, 1]
    and predicted (1 from 0.5 on).

    Null texts count as empty and are scored by their zero statistics; null ids stay and are
    never trained on; repeated rows get equal scores; other columns are ignored; empty
    ``documents`` give an empty result.
    """
    stats = save(text_stats(documents))
    model = fit(stats, labels, "quality", most)
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return stats.select("doc_id", held.alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without rejected rows.  The statistics travel beside the row, so that
    nothing is joined; texts are read twice."""
    rows = documents.select(F.struct("*").alias("row"))
    stats = save(text_stats(documents))
    model = fit(stats, labels, "quality")
    drop_saved(stats)

    def beside(batches):
        hasher = WordHasher()
        for batch in batches:
            parts = [block_stats(raw, offsets, hasher) for _, raw, offsets in text_blocks(texts_of(batch))]
            m = np.concatenate(parts) if parts else np.empty((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(m[:, k]) for k in range(len(STATS)))], ["row", *STATS])

    from pyspark.sql import types as T

    schema = T.StructType([rows.schema["row"], *(T.StructField(s, T.DoubleType()) for s in STATS)])
    return rows.mapInArrow(beside, schema).filter(model.score() >= THRESHOLD).select("row.*")
