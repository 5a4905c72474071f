"""Multiset counts of short and of long texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom.functions.text import COUNTED, multiset_overlap, numbered
from evalloom.functions.textscore import bleu_stats


@pytest.mark.parametrize("size", [0, 1, 30, COUNTED])
def test_overlap(spark, size):
    rng = random.Random(size)
    a, b = ([str(int(rng.paretovariate(0.7))) for _ in range(n)] for n in (size, size + 3))
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    row = df.select(multiset_overlap(F.col("a"), F.col("b")).alias("n"), numbered(F.col("a")).alias("k")).first()
    assert row.n == sum((Counter(a) & Counter(b)).values())
    assert len(set(row.k)) == size and Counter(x.rpartition(" ")[0] for x in row.k) == Counter(a)


def test_bleu_counts_of_long_texts(spark):
    rng = random.Random(1)
    text = lambda n: [rng.choice("abcdefg") for _ in range(n)]
    pred, one, two = text(3000), text(2500), text(3500)
    df = spark.createDataFrame([(" ".join(pred), " ".join(one), " ".join(two))], "p string, r string, s string")
    got = df.select(bleu_stats(F.col("p"), F.array("r", "s")).alias("x")).first().x
    for n in range(1, 5):
        grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))  # noqa: B023, E731
        assert got.correct[n - 1] == sum((grams(pred) & (grams(one) | grams(two))).values())
