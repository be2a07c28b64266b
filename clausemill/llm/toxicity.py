"""Toxicity by weak supervision.

1. Voters: lexicon voters (a word) and pattern voters (words that begin with some bytes).
   Besides a short public list of insults they are mined from labelled training rows: terms
   that occur in clearly more toxic than clean documents.
2. A generative label model: expectation maximisation estimates how often each voter fires
   in either class and how voters correlate within the classes; the votes of voters that
   repeat each other share their weight.  It starts from the number of votes and sees no label.
3. A linear classifier over hit counts is trained on the posterior labels and scores all
   documents.

Labels come from training rows only, at most ``LABELLED_ROWS`` of them; inputs of a score
are words of the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, fold, one_a_document, save, training_labels
from .words import ALNUM, LOWER, WordHasher, hash_word, mix, text_blocks, word_borders

#: Bound of the sample of labelled rows that voters and models are fitted on.
LABELLED_ROWS = 12_000
VOTERS = 400
PREFIX_BYTES = (5, 6, 7, 8)
#: A mined voter's least number of toxic documents, and its least ratio of toxic to clean rate.
LEAST_TOXIC, LEAST_LIFT = 4, 8.0
ROUNDS = 12
THRESHOLD = 0.7
SEED_LEXICON = (
    "idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumbass", "bastard", "bitch", "asshole",
    "retard", "slut", "whore", "faggot", "vermin", "filth", "subhuman", "idiotas", "imbécil", "puta", "cabrón", "salaud", "connard", "ordure", "arschloch", "dreckig", "abschaum",
)


def term_hashes(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher):
    """(row, hash) of all words and word beginnings of a block."""
    starts, ends, first = word_borders(data, offsets, ALNUM)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(starts):
        return doc, np.empty(0, np.uint64)
    total = hasher.prefix(data)
    docs, hashes = [doc], [hasher.ranges(total, starts, ends)]
    for n in PREFIX_BYTES:
        long = np.flatnonzero(ends - starts >= n)
        docs.append(doc[long])
        hashes.append(mix(hasher.ranges(total, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def _mine(batches):
    """Of each term, the toxic and the clean rows of the batch that hold it."""
    hasher = WordHasher()
    for batch in batches:
        toxic = np.asarray(batch.column("label")) > 0
        for lo, raw, offsets in text_blocks(batch.column("text")):
            doc, h = term_hashes(LOWER[raw], offsets, hasher)
            once = np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            terms, which = np.unique(h[once], return_inverse=True)
            t = toxic[lo + doc[once]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)), pa.array(np.bincount(which[t], minlength=len(terms))), pa.array(np.bincount(which[~t], minlength=len(terms)))],
                ["term", "toxic", "clean"],
            )


def mine_voters(rows: DataFrame, toxic: int, clean: int, most: int = VOTERS) -> np.ndarray:
    """Sorted hashes of the voters."""
    counts = rows.select("label", "text").mapInArrow(_mine, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate_t, rate_c = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    best = (
        counts.filter(F.col("toxic") >= LEAST_TOXIC)
        .withColumn("lift", F.log(rate_t / rate_c))
        .filter(F.col("lift") >= float(np.log(LEAST_LIFT)))
        .orderBy((F.col("lift") * F.sqrt("toxic")).desc(), "term")
        .limit(most)
        .select("term")
    )
    mined = [r.term for r in best.collect()]
    return np.unique(np.array(mined + [np.uint64(hash_word(w)).astype(np.int64) for w in SEED_LEXICON], np.int64).view(np.uint64))


class VoteCounter:
    """Finds voters' hits in blocks: a bit table rejects most words, a sorted list decides."""

    def __init__(self, voters: np.ndarray):
        self.voters, self.hasher = voters, WordHasher()
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(voters & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, raw: np.ndarray, offsets: np.ndarray):
        """(row, voter, count) of all hits."""
        doc, h = term_hashes(LOWER[raw], offsets, self.hasher)
        maybe = np.flatnonzero(self.bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        doc, h = doc[maybe], h[maybe]
        at = np.minimum(np.searchsorted(self.voters, h), len(self.voters) - 1)
        hit = self.voters[at] == h
        keys, counts = np.unique(doc[hit] * len(self.voters) + at[hit], return_counts=True)
        return keys // len(self.voters), keys % len(self.voters), counts


def _votes(voters):
    """Of each row, the logarithms of 1 + hits for all voters."""

    def run(batches):
        count = VoteCounter(voters.value)
        for batch in batches:
            parts = [np.empty((0, len(voters.value)), np.float32)]
            for _, raw, offsets in text_blocks(batch.column("text")):
                m = np.zeros((len(offsets) - 1, len(voters.value)), np.float32)
                row, voter, n = count(raw, offsets)
                m[row, voter] = np.log1p(n)
                parts.append(m)
            m = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "hits"])

    return run


def shared_weights(x: np.ndarray, p: np.ndarray, shrink: float = 0.2) -> np.ndarray:
    """A weight for each voter, from the correlations R of votes within the classes: the
    solution of R w = 1, so that independent voters weigh 1 and n copies of one 1 / n each."""
    covariance = np.zeros((x.shape[1],) * 2)
    for q in (p, 1 - p):
        mean = q @ x / q.sum()
        covariance += (x * q[:, None]).T @ x - q.sum() * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
    r = (1 - shrink) * covariance / scale[:, None] / scale
    np.fill_diagonal(r, 1.0)
    return np.clip(np.linalg.solve(r, np.ones(len(r))), 0.05, 1.0)


def label_model(fired: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probabilities of the toxic class from votes alone (rows x voters, 0/1)."""
    x = fired.astype(float)
    p = 1 - 0.98 * 0.4 ** x.sum(1)
    for _ in range(rounds):
        p = np.clip(p, 1e-6, 1 - 1e-6)
        prior = p.mean()
        on = (p @ x + 0.5) / (p.sum() + 1)  # P(fires | toxic)
        off = ((1 - p) @ x + 0.1) / ((1 - p).sum() + 1)  # P(fires | clean)
        weight = shared_weights(x, p)
        odds = np.log(prior / (1 - prior)) + x @ (weight * np.log(on / off)) + (1 - x) @ (weight * np.log((1 - on) / (1 - off)))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


class Model:
    def __init__(self, voters: np.ndarray, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias


def _best_border(z: np.ndarray, label: np.ndarray) -> float:
    """The border of z with the best F1; halfway to the next lower value."""
    order = np.argsort(-z, kind="stable")
    s, hits = z[order], np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + label.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1e-6)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", most: int = LABELLED_ROWS) -> Model:
    """Without labelled rows of both kinds the seed lexicon alone votes, with equal weights."""
    spark = documents.sparkSession
    train = training_labels(labels, label, most)
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = save(docs.join(F.broadcast(train), "doc_id").select("doc_id", "label", "text"))  # at most `most` ids are broadcast
    rows = one_a_document(rows, "text")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    border = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    if not n or ones in (0, n):
        voters = np.unique(np.array([hash_word(w) for w in SEED_LEXICON], np.uint64))
        return Model(voters, np.full(len(voters), 4.0), border - 2.0)
    voters = mine_voters(rows, int(ones), int(n - ones))
    kind = docs.schema["doc_id"].dataType.simpleString()
    votes = save(rows.mapInArrow(_votes(spark.sparkContext.broadcast(voters)), f"doc_id {kind}, label double, hits array<float>"))
    drop_saved(rows)
    # a bounded sample: at most `most` rows with one number for each voter
    sample = votes.toArrow()
    ids, y = sample["doc_id"], sample["label"].to_numpy()
    hits = sample["hits"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    p = label_model(hits > 0)
    posterior = spark.createDataFrame(pa.table({"doc_id": ids, "p": p})).groupBy("doc_id").agg(F.max("p").alias("p"))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    frame = votes.select("doc_id", "hits").join(F.broadcast(posterior), "doc_id").select("hits", both.alias("x"))
    frame = frame.filter("x.weight > 1e-4").select(array_to_vector("hits").alias("features"), "x.label", "x.weight").coalesce(4).cache()
    linear = LogisticRegression(regParam=0.002, maxIter=40, weightCol="weight", standardization=False).fit(frame)
    frame.unpersist()
    drop_saved(votes)
    weights = linear.coefficients.toArray()
    return Model(voters, weights, border - _best_border(hits @ weights, y))


def _score(model):
    def run(batches):
        m = model.value
        count = VoteCounter(m.voters)
        for batch in batches:
            z = []
            for _, raw, offsets in text_blocks(batch.column("text")):
                row, voter, n = count(raw, offsets)
                z.append(np.bincount(row, np.log1p(n) * m.weights[voter], len(offsets) - 1))
            z = np.concatenate(z) + m.bias if z else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """A row for each row of ``documents`` (doc_id, text): doc_id, held_out, score in [0, 1]
    and predicted (1 from 0.7 on).

    Null texts count as empty, which no voter finds toxic; null ids stay and are never
    trained on; repeated rows get equal scores; other columns are ignored; empty
    ``documents`` give an empty result.
    """
    spark = documents.sparkSession
    model = fit(documents, labels, "toxic", most)
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
