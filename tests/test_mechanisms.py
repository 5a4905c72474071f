"""Bucketed tables without exchanges, table functions, frequent-item summaries and merged sketches."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.functions import tables
from evalloom.operators import buckets as bk
from evalloom.operators import heavy as hv


def test_no_exchange_between_bucketed_tables(spark):
    rows = spark.range(3000).select((F.col("id") % 700).cast("string").alias("ngram"), "id")
    left, right = (spark.table(bk.write_bucketed(rows.where(c), n, 8)) for c, n in (("id < 2000", "left"), ("id > 500", "right")))
    assert bk.exchanges(rows.groupBy("ngram").count()) > 0
    assert bk.exchanges(bk.counted(left, 1)) == 0
    assert bk.exchanges(bk.joined(left, right)) == 0
    want = Counter(i % 700 for i in range(2000))
    assert {int(r.ngram): r.n_docs for r in bk.counted(left, 2).collect()} == {k: n for k, n in want.items() if n > 2}
    plain = rows.where("id < 2000").join(rows.where("id > 500"), "ngram").count()
    assert bk.joined(left, right).count() == plain
    assert sorted(r.id for r in bk.looked_up(left, ["5"]).collect()) == [5, 705, 1405]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan shows the buckets of a mere scan
    try:
        plan = bk.looked_up(left, ["5"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan


def test_one_sorted_file_per_bucket(spark):
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("ngram"))
    table = spark.table(bk.write_bucketed(rows, "sorted", 4))
    files = table.groupBy(F.input_file_name().alias("f")).agg(F.collect_list("ngram").alias("g")).collect()
    assert len(files) == 4 and all(r.g == sorted(r.g) for r in files)


def test_lateral_functions(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "One, two!  ... three FOUR"), (2, None), (3, "a")], "id long, text string")
    got = spark.sql("select id, g.* from {d}, lateral ngram_offsets(text, 2) g", d=docs).collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "one two", 0, 9), (1, 1, "two three", 5, 20), (1, 2, "three four", 15, 25)
    ]
    asked = spark.createDataFrame([(1, ["a", "b", "c"], 1), (2, [], 0), (3, ["x"], 5), (4, None, None)], "id long, c array<string>, g int")
    got = spark.sql("select id, place, choices from {d}, lateral option_swaps(c, g) order by id, place", d=asked).collect()
    assert [tuple(r) for r in got] == [(1, 0, ["b", "a", "c"]), (1, 1, ["a", "b", "c"]), (1, 2, ["a", "c", "b"])]


def test_partitioned_function(spark):
    tables.register(spark)
    talk = spark.createDataFrame(
        [(c, t, f"{c}" * t) for c in (1, 2, 3) for t in (3, 1, 2)] + [(4, 1, None)], "conv_id long, turn long, text string"
    )
    got = spark.sql("select * from conversation_spans(table({d}) partition by conv_id order by turn)", d=talk).collect()
    assert sorted(map(tuple, got)) == sorted(
        [(c, t, a, b) for c in (1, 2, 3) for t, a, b in ((1, 0, 1), (2, 2, 4), (3, 5, 8))] + [(4, 1, 0, 0)]
    )


@pytest.mark.parametrize("size", [4, 50, 5000])
def test_summary_bounds(size):
    rng = random.Random(size)
    items = [str(int(rng.paretovariate(0.8))) for _ in range(20_000)]
    truth, summary = Counter(items), hv.Summary(size)
    for low in range(0, len(items), 900):
        part = Counter(items[low : low + 900])
        summary.add(pa.array(list(part)), np.array(list(part.values())))
    held = dict(zip(summary.items.to_pylist(), summary.counts.tolist()))
    assert len(held) <= size and all(0 <= n - held.get(i, 0) <= summary.short for i, n in truth.items())


@pytest.mark.parametrize("k, size", [(10, 16), (40, 1000)])
def test_heavy_hitters(spark, k, size):
    rng = random.Random(k)
    items = [str(int(rng.paretovariate(0.9))) for _ in range(30_000)] + [None] * 50
    df = spark.createDataFrame([(i,) for i in items], "w string").repartition(6)
    want = sorted(Counter(i for i in items if i is not None).items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [tuple(r) for r in hv.heavy_hitters(df, "w", k, size).collect()] == want
    assert hv.heavy_hitters(df.limit(0), "w", k).count() == 0
    flat = spark.range(500).select(F.col("id").cast("string").alias("w"))
    assert [r.item for r in hv.heavy_hitters(flat, "w", 3, 4).collect()] == ["0", "1", "10"]


def test_few_rows_leave_a_task(spark):
    words = spark.range(0, 50_000, 1, 4).select(F.concat_ws("-", F.col("id") % 20_000, F.lit("x")).alias("w"))
    assert hv.summaries(words, "w", 100).count() <= 4 * 101


def test_sketches_of_batches_are_one_sketch(spark):
    pairs = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 20_000).alias("v"))
    batches = [hv.distinct_sketches(pairs.sample(0.7, seed=b), "k", "v") for b in range(3)]
    union = batches[0].unionByName(batches[1]).unionByName(batches[2])
    seen = pairs.sample(0.7, seed=0).union(pairs.sample(0.7, seed=1)).union(pairs.sample(0.7, seed=2))
    once = {r.k: r.n for r in hv.merged_distinct(hv.distinct_sketches(seen, "k", "v"), "k").collect()}
    exact = {r.k: r.n for r in seen.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    for r in hv.merged_distinct(union, "k").collect():
        assert abs(r.n / once[r.k] - 1) < 0.01 and abs(r.n / exact[r.k] - 1) < 0.05
