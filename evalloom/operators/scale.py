"""Distribution helpers shared by the operators: sized broadcasts, salted joins, positions and running totals.

All of them keep a hot key (one source, one task, one n-gram holding a third of the rows) from landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.session import cut_lineage

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
SALTS = 16


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: strings by length, nested values by their JSON, the rest by eight."""
    sizes = [F.lit(0)]
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(field.name), F.lit(0)) + 16)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.octet_length(F.to_json(F.struct(field.name))))
        else:
            sizes.append(F.lit(8))
    return sum(sizes[1:], sizes[0])


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes. Reads no further than that many rows."""
    found = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(row_bytes(df)).alias("bytes")).first()
    return found["n"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` if they lie in fewer pieces than the session has cores, as one small file does; else ``df`` itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def semi_join_sized(left: DataFrame, keys: DataFrame, on: str | list[str], spread: Column,
                    max_rows: int = BROADCAST_ROWS, anti: bool = False) -> DataFrame:
    """``left`` rows whose ``on`` is (not) among ``keys``.

    Broadcasts ``keys`` only after counting them. A larger key set is shuffled, with the left side salted by
    ``spread`` so that a key held by a third of the rows is spread over ``SALTS`` tasks.
    """
    how = "left_anti" if anti else "left_semi"
    on = [on] if isinstance(on, str) else on
    keys = keys.select(*on).distinct()
    if fits_broadcast(keys, max_rows):
        return left.join(F.broadcast(keys), on, how)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def lookup_sized(left: DataFrame, table: DataFrame, on: list[str], spread: Column, how: str = "inner",
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``left`` to ``table``, which has one row per ``on``.

    The table is broadcast only after a count; a larger one is joined with salted keys, so that a key held by a third of
    ``left`` is spread over ``SALTS`` tasks.
    """
    if fits_broadcast(table, max_rows):
        return left.join(F.broadcast(table), on, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def running_start(df: DataFrame, order: str | list[str], amount: Column, out: str, group: list[str] | None = None) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all earlier rows (by ``order``) of the row's group.

    ``order`` is one or more columns of any sortable type whose values are distinct inside a group. Only the keys and the amount
    are sorted: they are dealt into ranges of the keys, however dense, so a hot group spans many ranges. Totals per range give each
    range its start, a window inside a range does the rest, and the rows get their sums by one join on the keys.
    """
    group, order = group or [], [order] if isinstance(order, str) else order
    keys = [*group, *order]
    ranges = (
        df.select(*keys, amount.cast("long").alias("_amount"))
        .repartitionByRange(*keys)
        .withColumn("_range", F.spark_partition_id())
    )
    ranges = cut_lineage(ranges)  # a range keeps its number
    before = (W.unboundedPreceding, -1)
    bases = ranges.groupBy(*group, "_range").agg(F.sum("_amount").alias("_total")).select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_range").alias("_number"),
        F.coalesce(F.sum("_total").over(W.partitionBy(*group).orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_base"),
    )
    same = F.col("_range") == F.col("_number")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(*before)
    starts = ranges.join(bases, same).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        (F.col("_base") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))).cast("long").alias(out),
    )
    match = F.lit(True)
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(starts, match).drop(*[f"_k{i}" for i in range(len(keys))])


def positions(df: DataFrame, order: str | list[str], out: str, group: list[str] | None = None) -> DataFrame:
    """Add ``out``: the 0-based position of the row in its group by ``order``."""
    return running_start(df, order, F.lit(1), out, group)


def exact_median(df: DataFrame, group: list[str], value: str, out: str = "median", accuracy: int = 1000) -> DataFrame:
    """Exact median per group (mean of the two middle values) without gathering a group in one task.

    An approximate quantile brackets the middle; rows outside it only count, equal values are combined on the map side,
    and only the distinct values inside the bracket are ranked. The bracket table is checkpointed and counted before it
    is broadcast.
    """
    keys = group or ["_all"]
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if not group:
        rows = rows.withColumn("_all", F.lit(0))
    slack = 3.0 / accuracy
    edges = F.percentile_approx("_v", [0.5 - slack, 0.5 + slack], accuracy)
    bracket = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), edges.alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    # in a small group the sketch error is under one row's share, so the bracket is the whole range
    few = F.col("_n") <= 2 * accuracy
    bracket = cut_lineage(
        bracket.select(
            *keys,
            "_n",
            F.when(few, F.col("_min")).otherwise(F.col("_q")[0]).alias("_lo"),
            F.when(few, F.col("_max")).otherwise(F.col("_q")[1]).alias("_hi"),
        )
    )
    if fits_broadcast(bracket):
        bracket = F.broadcast(bracket)
    counted = (
        rows.join(bracket, keys)
        .where("_v <= _hi")
        .select(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .groupBy(*keys, "_n", "_v")
        .agg(F.count("*").alias("_c"))
    )
    # values below the bracket are one row with a null value, which sorts first
    ranked = running_start(cut_lineage(counted), "_v", F.col("_c"), "_start", keys).withColumn("_end", F.col("_start") + F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_v")))

    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(out)).select(*group, out)
