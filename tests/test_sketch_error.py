from pyspark.sql import functions as F

from evalloom.operators import heavy as hv


def test_sketches_keep_their_error(spark):
    """With 2 ** 12 registers the count of these values is 4.5 % too large."""
    pairs = spark.range(1401 * 8000, 1402 * 8000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    batches = [hv.distinct_sketches(pairs.where(F.col("v") % 4 == b), "k", "v", hv.precision_for(0.04)) for b in range(4)]
    union = batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3])
    assert abs(hv.merged_distinct(union, "k").first().n / 8000 - 1) < 0.04
