import random

from pyspark.sql import functions as F

from evalloom.operators import buckets as bk
from evalloom.operators import decontam as dc
from evalloom.operators import runs as rn


def corpus(spark):
    """Texts of few words, so that n-grams repeat inside and between texts."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id") % 40), lambda i: F.concat(F.lit("w"), F.xxhash64(i, F.col("id") % 7) % 5)), " ")
    return spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 5, words).alias("text"))


def test_runs_spell_the_same_ngrams(spark):
    docs = corpus(spark)
    for n in (2, 4):
        runs = rn.ngram_runs(docs, n)
        got, want = rn.spelled(runs, n), dc.distinct_postings(docs, n)
        assert sorted(map(tuple, got.select("doc_id", "ngram").collect())) == sorted(map(tuple, want.collect()))
        assert got.groupBy("ngram").agg(F.count_distinct("mark").alias("m")).where("m > 1").count() == 0
        every = rn.spelled(rn.ngram_runs(docs, n, distinct=False), n).count()
        assert every == dc.ngram_postings(docs, n).count()


def test_words_moved_do_not_grow_with_n(spark):
    docs = spark.range(20).select(
        F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.hash(i, "id").cast("string")), " ").alias("text"))
    moved = rn.ngram_runs(docs, 13).agg(F.sum(F.size(F.split("words", " ")))).first()[0]
    assert moved < 4 * 20 * 400 < dc.distinct_postings(docs, 13).agg(F.sum(F.size(F.split("ngram", " ")))).first()[0]


def test_counts_of_runs_need_no_shuffle(spark):
    docs = corpus(spark)
    table = spark.table(bk.write_bucketed(rn.ngram_runs(docs, 3), "runs", 4, "mark"))
    counts = rn.counted_ngrams(table, 3, 1)
    assert bk.exchanges(counts) == 0
    want = dc.distinct_postings(docs, 3).groupBy("ngram").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))


def test_sorted_buckets_of_runs(spark):
    """All n-grams, those of an n-gram in one bucket, buckets in order and sorted inside a partition; runs are moved, not n-grams."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(9 if i % 2 else 400)}" for _ in range(120))) for i in range(40)] + [(40, None), (41, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dc.sorted_run_buckets(docs, 5, 6, text_bytes=2000)
    parts = [tuple(r) for r in found.select(F.spark_partition_id(), "bucket", "ngram", "doc_id").collect()]
    plain = sorted(map(tuple, dc.ngram_postings(docs, 5).select("ngram", "doc_id").collect()))
    assert sorted(r[2:] for r in parts) == plain
    assert parts == sorted(parts) and [r[1] for r in parts] == sorted(r[1] for r in parts)
    assert len({r[1:3] for r in parts}) == len({g for g, _ in plain})
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")


def test_runs_travel_packed(spark):
    """Runs that are sorted are dealt compressed: less is moved than the text has bytes, and nothing is read to find the ranges but a sample."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("word"), (F.xxhash64(i, "id") % 500).cast("string"))), " ").alias("text")).localCheckpoint()
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    found = dc.sorted_run_buckets(docs, 13, 20)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "rangepartitioning" not in plan
    assert found.count() == dc.ngram_postings(docs, 13).count()
    rows = [r["size"] for r in packed_rows(docs, 13)]
    assert sum(rows) < 0.8 * 3 * text


def packed_rows(docs, n):
    runs = rn.ngram_runs(docs, n, distinct=False).select(F.lit(0).alias("part"), "words")
    return runs.mapInArrow(lambda batches: rn.packed(batches), rn.PACKED).select(F.octet_length("runs").alias("size")).collect()


def test_sorted_buckets_of_a_passage_everywhere(spark):
    """One passage in all texts fills many partitions; keys are strings, some null; rows, order and buckets stay right."""
    passage = " ".join(f"é{k}" for k in range(12))
    rows = [(f"k{i}" if i % 9 else None, f"{passage} z{i % 4} {passage}") for i in range(200)]
    docs = spark.createDataFrame(rows, "name string, body string")
    plain = sorted(map(repr, dc.ngram_postings(docs, 5, "body", ["name"]).select("ngram", "name").collect()))
    for buckets in (1, 40):
        found = dc.sorted_run_buckets(docs, 5, buckets, "body", "name", 2000)
        assert found.columns == ["name", "bucket", "ngram"]
        parts = [tuple(r) for r in found.select(F.spark_partition_id(), "bucket", "ngram", "name").collect()]
        key = lambda r: (*r[:3], r[3] is not None, r[3] or "")
        assert [key(r) for r in parts] == sorted(map(key, parts)) and [r[1] for r in parts] == sorted(r[1] for r in parts)
        assert sorted(map(repr, found.select("ngram", "name").collect())) == plain
        assert len({r[1:3] for r in parts}) == len({r[2] for r in parts})
        assert len({r[0] for r in parts}) > 4
