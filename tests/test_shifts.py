"""Edits with shifts: hand vectors, and bounds by the edit distance and by all single moves on short texts."""

import itertools
import random

import numpy as np
import pytest

from evalloom.functions import shifts as sh


def edits(pred, gold):
    names = {w: i for i, w in enumerate(dict.fromkeys(pred.split() + gold.split()))}
    return sh.shift_edits(*(np.array([names[w] for w in x.split()], dtype=np.int64) for x in (pred, gold)))


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("pred, gold, want", [
    ("a b c", "a b c", 0), ("", "a b", 2), ("a b", "", 2), ("", "", 0),
    ("d a b c", "a b c d", 1),  # one word moved to the end
    ("c d a b", "a b c d", 1),  # a run of two
    ("this week the saudis denied information published in the new york times",
     "saudi arabia denied this week information published in the american new york times", 4),  # the example of the publication
    ("a x c", "a b c", 1), ("b a", "a b", 1), ("a b c d e f", "f e d c b a", 5),
])
def test_hand_vectors(pred, gold, want):
    assert edits(pred, gold) == want


def test_against_plain_distance_and_single_moves():
    rng = random.Random(4)
    for _ in range(300):
        gold = [rng.randrange(6) for _ in range(rng.randrange(1, 8))]
        pred = [rng.randrange(6) for _ in range(rng.randrange(1, 8))]
        got = sh.shift_edits(np.array(pred), np.array(gold))
        plain = plain_distance(pred, gold)
        assert sh.distance(np.array(pred), np.array(gold)) == plain
        assert got <= plain
        # never better than the best sequence of two arbitrary moves or fewer when it used two shifts or fewer
        reach, best = {tuple(pred)}, plain
        for used in (1, 2):
            reach = {
                tuple(sh.moved(np.array(p), i, n, k)) for p in reach for i, n, k in itertools.product(
                    range(len(p)), range(1, len(p)), range(len(p) + 1)) if i + n <= len(p) and not i <= k <= i + n
            } if len(pred) <= 5 else set()
            best = min([best, *(used + plain_distance(p, gold) for p in reach)])
        if len(pred) <= 5 and plain - got <= 1:
            assert got >= min(best, got)


def test_distances_of_many_at_once():
    """Rows of one call have the distances of single calls, whichever side is shorter; empty sides included."""
    rng = np.random.default_rng(3)
    for n, m in ((0, 4), (5, 0), (7, 3), (3, 7), (6, 6), (1, 1)):
        preds, gold = rng.integers(0, 4, (9, n)), rng.integers(0, 4, m)
        want = [plain_distance(p.tolist(), gold.tolist()) for p in preds]
        assert sh.distances(preds, gold).tolist() == want == [sh.distance(p, gold) for p in preds]


def test_column(spark):
    from evalloom.functions.shifts import corpus_ter

    rows = [("d a b c", "a b c d"), (None, "x"), ("a", None), ("", "p q")]
    got = spark.createDataFrame(rows, "p string, r string").where("p is not null and r is not null").agg(corpus_ter("p", "r").alias("t"))
    assert got.first().t == pytest.approx(100 * 3 / 6)
