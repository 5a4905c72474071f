"""Bootstrap errors against plain resampling, and the draws against the Poisson distribution."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions.textscore import bleu_stats
from evalloom.operators import aggregates as ag
from evalloom.operators import bootstrap as bs


def resampled(rows, statistic, times=400, seed=5):
    rng = random.Random(seed)
    return statistics.stdev(statistic(rng.choices(rows, k=len(rows))) for _ in range(times))


@pytest.mark.parametrize("count", [1, 2, 7, 300, 10**6])
def test_draws_follow_the_distribution(count):
    keys = np.random.default_rng(count).integers(0, 1 << 63, 200, dtype=np.uint64)
    drawn = bs.draws(keys, np.full(200, count), np.arange(500), 3)
    assert abs(drawn.mean() / count - 1) < 5 / math.sqrt(count * drawn.size)
    assert abs(drawn.var() / count - 1) < 0.05
    assert np.array_equal(drawn[:, [3, 9]], bs.draws(keys, np.full(200, count), np.array([3, 9]), 3))


@pytest.mark.parametrize("size", [400, 401])
def test_median(spark, size):
    rng = random.Random(size)
    rows = [(g, rng.choice((rng.gauss(0, 1), float(rng.randrange(3))))) for g in ("a", None) for _ in range(size)]
    df = spark.createDataFrame([*rows, ("a", None)], "g string, v double").repartition(5)
    out = {r.g: r for r in bs.bootstrap_median(df, ["g"], "v", 600, range_rows=60).collect()}
    for g in ("a", None):
        plain = resampled([v for h, v in rows if h == g], statistics.median)
        assert out[g].replicates == 600 and abs(out[g].stderr / plain - 1) < 0.25
    whole = bs.bootstrap_median(df, [], "v", 50, range_rows=100_000).first()
    assert whole.stderr == pytest.approx(bs.bootstrap_median(df, [], "v", 50, range_rows=37).first().stderr, rel=1e-12)
    assert bs.bootstrap_median(df.limit(0), ["g"], "v", 20).count() == 0


def test_macro_f1(spark):
    rng = random.Random(1)
    rows = [(g, g if rng.random() < 0.7 else rng.choice("abc")) for g in rng.choices("abc", (5, 2, 1), k=300)]

    def macro(sample):
        scores = []
        for c in {x for r in sample for x in r}:
            tp = sum(g == p == c for g, p in sample)
            off = sum((g == c) != (p == c) for g, p in sample)
            scores.append(2 * tp / (2 * tp + off))
        return sum(scores) / len(scores)

    out = bs.bootstrap_macro_f1(spark.createDataFrame(rows, "g string, p string"), [], "g", "p", 600).first()
    assert out.replicates == 600 and abs(out.stderr / resampled(rows, macro) - 1) < 0.2


def test_corpus_bleu(spark):
    rng = random.Random(3)
    words = "the cat sat on a mat and ran to its house".split()
    rows = []
    for _ in range(120):
        gold = rng.choices(words, k=12)
        rows.append((" ".join(w if rng.random() < 0.8 else rng.choice(words) for w in gold), " ".join(gold)))
    df = spark.createDataFrame(rows, "p string, r string")
    terms, statistic = ag.bleu_terms("x")
    stats = df.select(bleu_stats(F.col("p"), F.array("r")).alias("x"))
    listed = [(r.x.test, r.x.ref, *r.x.guess, *r.x.correct) for r in stats.collect()]

    def bleu(sample):
        test, ref, *counts = (sum(c) for c in zip(*sample))
        logs = sum(math.log(c / g) for g, c in zip(counts[:4], counts[4:])) / 4
        return 100 * math.exp(logs + min(0, 1 - ref / test))

    out = bs.bootstrap_error(stats, [], terms, statistic, 600).first()
    assert out.replicates == 600 and abs(out.stderr / resampled(listed, bleu) - 1) < 0.2
    assert ag.corpus_bleu(df, "p", F.array("r")).first().bleu == pytest.approx(bleu(listed))
