"""Bucketed n-gram tables: hashed and sorted once when they are written, then joined and counted without a shuffle.

Rows of an n-gram are in one bucket of every table of as many buckets, so two tables join bucket by bucket, a count per n-gram needs no
exchange, and a look-up of one n-gram reads one bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.session import run_dir

BUCKETS = 500


def write_bucketed(postings: DataFrame, name: str, buckets: int = BUCKETS, key: str = "ngram", within: tuple[str, ...] = (),
                   folder: str | None = None, shape: Callable[[DataFrame], DataFrame] | None = None, **options) -> str:
    """Write ``postings`` as a table of ``buckets`` buckets by ``key``, sorted inside by it and ``within``; the name of the table, new for each call.

    Rows are dealt by the function that buckets use, so a bucket is one sorted file. The files lie in the shared folder. ``shape`` is applied
    to the dealt rows before they are sorted; it must keep the key.
    """
    spark = postings.sparkSession
    full = f"{name}_{uuid.uuid4().hex[:12]}"
    dealt = postings.repartition(buckets, key)
    dealt = (shape(dealt) if shape else dealt).sortWithinPartitions(key, *within)
    writer = dealt.write.bucketBy(buckets, key).sortBy(key, *within).format("parquet").option("path", folder or run_dir(spark, name)).options(**options)
    writer.saveAsTable(full)
    return full


def bucket_count(spark: SparkSession, least: int = 16) -> int:
    """Buckets for a table as large as the data: the partitions that the session shuffles into."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def counted(table: DataFrame, more_than: int, key: str = "ngram", *more: str) -> DataFrame:
    """Keys (with ``more`` columns) in more than ``more_than`` rows of a table bucketed by ``key``, with their rows: one pass over the buckets."""
    return table.groupBy(key, *more).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > more_than)


def joined(left: DataFrame, right: DataFrame, key: str = "ngram", how: str = "inner") -> DataFrame:
    """Join of two tables of as many buckets, bucket by bucket."""
    return left.hint("merge").join(right.hint("merge"), key, how)


def looked_up(table: DataFrame, values: list[str], key: str = "ngram") -> DataFrame:
    """Rows of some keys; only their buckets are read."""
    same: Column = F.col(key).isin(*values)
    return table.where(same)


def exchanges(df: DataFrame) -> int:
    """Exchanges in the physical plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")
