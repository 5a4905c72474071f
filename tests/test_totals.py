from pyspark.sql import functions as F

from evalloom.functions import tables
from evalloom.operators import decontam as dc


def test_totals_are_one_row(spark):
    """What leaves the function is a row per text, not a row per n-gram."""
    tables.register(spark)
    spark.createDataFrame([(1, "b a, c"), (2, "x"), (3, None)], "id long, t string").createOrReplaceTempView("totals_docs")
    got = spark.sql("select id, o.* from totals_docs, lateral ngram_totals(t, 2) o").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2, 10, "a c")]


def test_span_totals_have_no_row_per_ngram(spark):
    """Null, short and repeated keys add up as the rows of all n-grams do, without those rows."""
    docs = spark.createDataFrame([(1, "b a, c"), (2, "x"), (3, None), (1, "a  b"), (None, "q r s")], "doc_id long, text string")
    totals = dc.span_totals(docs, 2)
    assert sorted(map(tuple, totals.collect()), key=repr) == [(1, 3, 2, 14, "a b"), (None, 2, 2, 8, "q r")]
    assert "Generate" not in totals._jdf.queryExecution().executedPlan().toString()


def test_smallest_ngram_by_bytes(spark):
    """A control character stands before the blank that ends a shorter word; equal first words are told apart by the next ones."""
    docs = spark.createDataFrame([(1, "a c a\u0001 d a b"), (2, "b b a b a a c")], "doc_id long, text string")
    for n in (1, 2, 3):
        plain = dc.ngram_spans(docs, n).groupBy("doc_id").agg(F.count("*"), F.sum("start"), F.sum("stop"), F.min("ngram"))
        assert sorted(map(tuple, dc.span_totals(docs, n).collect())) == sorted(map(tuple, plain.collect()))
