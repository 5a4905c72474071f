"""Blocked Bloom filters: no key is lost, few foreign keys pass, any number of tasks gives the same filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import bloom


@pytest.mark.parametrize("keys", [1, 1000, 200_000])
def test_rates(keys):
    rng = np.random.default_rng(3)
    mine, foreign = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (keys, 200_000))
    found = bloom.Bloom(bloom.blocks_for(keys))
    found.add(mine)
    assert found.has(mine).all()
    assert found.has(np.setdiff1d(foreign, mine)).mean() < 0.01
    again = bloom.Bloom.unpack(found.pack())
    assert np.array_equal(again.words, found.words)


@pytest.mark.parametrize("tasks", [1, 7, 80])
def test_built_by_tree(spark, tasks):
    rows = spark.range(0, 50_000, 1, tasks).select(F.xxhash64("id").alias("k"), F.lit("clash").alias("chunk"))
    built = bloom.bloom_of(rows, "k", 50_000)
    plain = bloom.Bloom(bloom.blocks_for(50_000))
    plain.add(rows.toArrow()["k"].to_numpy().view(np.uint64))
    assert np.array_equal(built.words, plain.words)
    empty = bloom.bloom_of(rows.limit(0), "k", 0)
    assert not empty.words.any()


def test_more_keys_than_fit():
    keys = np.arange(10_000, dtype=np.uint64)
    small = bloom.Bloom(bloom.blocks_for(10_000, max_bytes=1 << 10))
    small.add(keys)
    assert len(small.words) == 32 and small.has(keys).all()
