"""Contamination with an evaluation side too large to list: the Bloom filter gives the rows of the small way."""

import pytest
from pyspark.sql import functions as F

from evalloom.operators import decontam as dc

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text")
    return docs, dc.distinct_postings(items, keys=["item_id"]).select("ngram")


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_both_ways_agree(corpus):
    docs, grams = corpus
    small = rows(dc.matched_postings(docs, grams))
    assert small and small == rows(dc.matched_postings(docs, grams, max_keys=0)) == rows(dc.matched_postings(docs, grams, max_rows=0))
    plain = dc.distinct_postings(docs).join(grams.distinct(), "ngram", "left_semi").select("doc_id", "ngram")
    assert small == rows(plain)


def test_few_other_ngrams_are_spelled_out(corpus):
    docs, grams = corpus
    known = dc.hash_filter(dc.gram_keys(grams, dc.NGRAM), max_keys=0)
    assert type(known).__name__ == "Bloom"
    spelled = dc.spelled_hits(docs, known, dc.NGRAM, "text", ["doc_id"])
    right = dc.matched_postings(docs, grams).count()
    every = dc.hashed_postings(docs).count()
    assert right <= spelled.count() <= right + 0.01 * every


def test_frequent_ngrams_beyond_the_list(corpus):
    docs, _ = corpus
    assert rows(dc.frequent_ngrams(docs, 5, 3)) == rows(dc.frequent_ngrams(docs, 5, 3, max_keys=0))


def test_empty_sides(corpus):
    docs, grams = corpus
    assert dc.matched_postings(docs, grams.limit(0)).count() == 0
    assert dc.matched_postings(docs.limit(0), grams).count() == 0
    assert dc.matched_postings(docs.withColumn("text", F.lit(None).cast("string")), grams).count() == 0


def test_hashes_are_dealt_before_they_are_counted(corpus, spark):
    """The counts of the plain grouping for any number of n-grams held and text dealt, without a table of all hashes in front of the shuffle."""
    docs, _ = corpus
    plain = rows(dc.hashed_postings(docs, 3, distinct=False).groupBy("k1", "k2").agg(F.count("*")))
    once = rows(dc.hashed_postings(docs, 3).groupBy("k1").agg(F.count("*")))
    for held, size in ((1, 1 << 14), (1 << 20, 1 << 30)):
        assert rows(dc.counted_hashes(docs, 3, distinct=False, held=held, text_bytes=size)) == plain
        assert rows(dc.counted_hashes(docs, 3, held=held, text_bytes=size, second=False)) == once
    plan = dc.counted_hashes(docs, 3)._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange") < plan.index("MapInArrow")
    assert dc.counted_hashes(docs.limit(0), 3).count() == 0
