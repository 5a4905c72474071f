from pyspark.sql import functions as F

from evalloom.functions.numbers import rounded


def test_rounding_of_products(one):
    assert one(rounded(F.lit(82.0) / F.lit(1280), 6)) == 0.064062
    assert one(rounded(F.lit(-0.0078125), 6)) == -0.007813
