"""Mixing sources to target weights, with soft membership; DataFrame functions only.

1. A naive Bayes classifier over hashed words, fitted on any labelled table (doc_id, domain),
   gives each document a posterior over the domains.  Its evidence is tempered to that of
   ``EVIDENCE`` words, so that memberships stay soft.
2. Each document gets a rate r >= 0.  The rates minimise
   ``sum_d (S_d - T_d)^2 / T_d``, ``S_d`` being the expected tokens of domain d,
   ``sum_i r_i * tokens_i * p_id``, by projected gradient in the metric of the documents'
   tokens, in its lazy form: gradients are summed up and the sum is projected,
   ``r_i = max(0, 1 - sum_d p_id * y_d)``.  So of all rates that meet the targets, those
   nearest to 1 are found, and a step is one aggregate over the corpus to one number for
   each domain.

The total of the targets is the least by which no domain has to lose tokens, unless a
budget is given.  With soft memberships single documents can get rates below 1 even then;
``least=1`` projects onto rates of at least 1, so that each row stays.  Only sums for each domain reach the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save

#: Target shares of tokens by domain (here: language).
WEIGHTS = {"en": 0.52, "de": 0.18, "es": 0.13, "fr": 0.17}
#: Words are hashed to so many buckets; the pseudo-count of each.
BUCKETS, PSEUDO = 4096, 0.5
EVIDENCE = 2
STEPS, TOLERANCE = 40, 1e-6


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, as the output of a generator: the optimizer evaluates them
    there once and doesn't write their expressions into each place that uses them."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def word_buckets(text: Column) -> Column:
    """The buckets of all words between white space of a text that isn't null; none of an empty one."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def class_weights(documents: DataFrame, labelled: DataFrame, domains: list[str]) -> np.ndarray:
    """log prior and, for each bucket, log P(bucket | domain).  A domain without labelled rows
    has a flat distribution.  Counts of BUCKETS buckets for each domain reach the driver."""
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id")
    rows = computed(rows, ["domain"], b=word_buckets(F.coalesce("text", F.lit(""))))
    # bucket -1 counts documents
    counts = rows.select("domain", F.explode(F.concat(F.array(F.lit(-1)), "b")).alias("bucket")).groupBy("domain", "bucket").count().toArrow().to_pylist()
    n, c = np.zeros(len(domains)), np.full((len(domains), BUCKETS), PSEUDO)
    for r in counts:
        d = domains.index(r["domain"])
        if r["bucket"] < 0:
            n[d] = r["count"]
        else:
            c[d, r["bucket"]] += r["count"]
    prior = (n + 1) / (n + 1).sum()
    return np.column_stack([np.log(prior), np.log(c / c.sum(1, keepdims=True))])


def with_posteriors(rows: DataFrame, keep: list[str], text: Column, weights: np.ndarray) -> DataFrame:
    """``keep``, the number of tokens and p0, p1, ... for the domains; they sum to 1."""
    out = computed(rows, keep, b=word_buckets(F.coalesce(text.cast("string"), F.lit(""))))
    scale = F.least(F.lit(1.0), EVIDENCE / F.greatest(F.size("b"), F.lit(1)))
    names, scores = [f"z{d}" for d in range(len(weights))], []
    for w in weights:
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in w[1:])), ",").cast("array<double>")  # folded to a constant
        scores.append(F.lit(float(w[0])) + scale * F.aggregate("b", F.lit(0.0), lambda acc, x: acc + F.get(table, x)))
    out = computed(out, [*keep, "b"], **dict(zip(names, scores)))
    keep = [*keep, "tokens"]
    out = out.withColumn("tokens", F.size("b").cast("long"))
    top = F.greatest(*names) if len(names) > 1 else F.col("z0")
    out = computed(out, keep, **{f"e{d}": F.exp(F.col(z) - top) for d, z in enumerate(names)})
    total = reduce(lambda a, b: a + b, (F.col(f"e{d}") for d in range(len(weights))))
    return computed(out, keep, **{f"p{d}": F.col(f"e{d}") / total for d in range(len(weights))})


def rate(slope: list[float], least: float = 0.0) -> Column:
    """The projection of ``1 - sum_d p_d * slope_d`` onto the rates that are allowed."""
    return F.greatest(F.lit(float(least)), F.lit(1.0) - reduce(lambda a, b: a + b, (F.col(f"p{d}") * x for d, x in enumerate(slope)))) if slope else F.lit(1.0)


def fit_rates(posteriors: DataFrame, targets: list[float], budget: float | None = None, steps: int = STEPS, least: float = 0.0):
    """(slope for ``rate``, totals before, targets in tokens, totals after)."""
    n = len(targets)
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    first = posteriors.agg(
        *(F.sum(F.col("tokens") * F.col(f"p{d}")).alias(f"s{d}") for d in range(n)),
        *(F.sum(F.col("tokens") * F.col(f"p{a}") * F.col(f"p{b}")).alias(f"g{a}_{b}") for a, b in pairs),
    ).first()
    start = np.array([first[f"s{d}"] or 0.0 for d in range(n)])
    share = np.array(targets, float) / sum(targets)
    if budget is None:
        budget = float(np.max(np.where(share > 0, start / np.maximum(share, 1e-12), 0.0)))
    t = share * budget
    if not budget or not start.sum():
        return [], start, t, start
    root = np.sqrt(np.maximum(t, 1e-9 * budget))
    gram = np.zeros((n, n))
    for a, b in pairs:
        gram[a, b] = gram[b, a] = (first[f"g{a}_{b}"] or 0.0) / (root[a] * root[b])
    eta = 1.0 / float(np.linalg.eigvalsh(gram)[-1])
    slope, s = np.zeros(n), start
    for _ in range(steps):
        slope = slope + eta * (s - t) / root**2
        got = posteriors.select("tokens", *(f"p{d}" for d in range(n)), rate(slope.tolist(), least).alias("r")).agg(*(F.sum(F.col("tokens") * F.col("r") * F.col(f"p{d}")).alias(f"s{d}") for d in range(n))).first()
        s = np.array([got[f"s{d}"] for d in range(n)])
        if np.max(np.abs(s - t)) <= TOLERANCE * budget:
            break
    return slope.tolist(), start, t, s


class Mixture:
    """What is fitted: class weights and the slope of the rates."""

    def __init__(self, documents: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, least: float = 0.0):
        self.domains = sorted(weights)
        self.classes = class_weights(documents, labelled, self.domains)
        self.posteriors = save(with_posteriors(documents.select("doc_id", F.col("text").alias("_t")), ["doc_id"], F.col("_t"), self.classes))
        self.slope, self.before, self.targets, self.after = fit_rates(self.posteriors, [weights[d] for d in self.domains], budget, least=least)


def document_rates(documents: DataFrame, labelled: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | None = None) -> DataFrame:
    """A row for each row of ``documents`` (doc_id, text): doc_id, tokens, a posterior
    ``p_<domain>`` for each domain of ``weights`` and the rate.

    ``labelled`` holds (doc_id, domain); null ids and other domains are left out, of several
    rows of an id the least domain counts.  Null and empty texts have no tokens and the
    prior as posterior.  Null ids and repeated rows stay.  Other columns are ignored.
    """
    m = Mixture(documents, labelled, weights, budget)
    names = [F.col(f"p{d}").alias(f"p_{x}") for d, x in enumerate(m.domains)]
    return m.posteriors.select("doc_id", "tokens", *names, rate(m.slope).alias("rate"))


def mix(documents: DataFrame, labelled: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | None = None, least: float = 0.0) -> DataFrame:
    """``documents`` with each row as often as its rate says: the whole part always, the rest
    by a hash of id and text.  No rate is below ``least``; with 1 each row stays.  Columns stay
    as they are.  Rates are computed beside the row from its text, without a join."""
    m = Mixture(documents, labelled, weights, budget, least)
    drop_saved(m.posteriors)
    rows = documents.select(F.struct("*").alias("row"))
    place = F.pmod(F.xxhash64("row.doc_id", F.coalesce(F.col("row.text").cast("string"), F.lit(""))), F.lit(1 << 20)) / (1 << 20)
    rows = computed(with_posteriors(rows, ["row"], F.col("row.text"), m.classes), ["row"], copies=F.floor(rate(m.slope, least) + place).cast("int"))
    return rows.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
