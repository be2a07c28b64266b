"""Error rates against a plain table of distances, and on long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def rates(spark, pairs, rate):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r.x for r in df.select("i", rate(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]


def some_pairs(letters, joint):
    rng = random.Random(3)
    text = lambda: joint.join(rng.choices(letters, k=rng.randrange(1, 16)))
    pairs = [(text(), text()) for _ in range(150)]
    return pairs + [(a, a.replace(letters[0], letters[1])) for a, _ in pairs]


def test_char_error_rate_equals_a_table(spark):
    pairs = some_pairs("abc가😀", "")
    assert rates(spark, pairs, tx.char_error_rate) == pytest.approx([distance(a, b) / len(a) for a, b in pairs])
    assert rates(spark, [("", ""), (" ", "x"), (None, "x"), ("x", None), ("a  b", "a b")], tx.char_error_rate) == [0, 1, None, None, 0]


def test_char_error_rate_of_long_texts(spark):
    """A table of their distances has 1.6e11 cells."""
    a = "the lessee pays the fee; " * 16_000
    began = time.time()
    got = rates(spark, [(a, a.replace("e", "o")), (a, a[:1000] + a[1025:])], tx.char_error_rate)
    n = len(a.strip())
    assert got == pytest.approx([a.count("e") / n, 25 / n]) and time.time() - began < 60


def test_word_error_rate_equals_a_table(spark):
    pairs = some_pairs("abcd", " ")
    assert rates(spark, pairs, tx.word_error_rate) == pytest.approx([distance(a.split(), b.split()) / len(a.split()) for a, b in pairs])


def test_word_error_rate_of_long_texts(spark):
    """A row of the table for each word of these takes minutes; a few words differ."""
    words = [f"w{i}" for i in range(60_000)]
    began = time.time()
    (got,) = rates(spark, [(" ".join(words), " ".join(words[:1] + words[2:] + ["end"]))], tx.word_error_rate)
    assert got == pytest.approx(2 / len(words)) and time.time() - began < 60
