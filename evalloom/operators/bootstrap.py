"""Bootstrap standard errors of any statistic by Poisson weights.

A replicate gives each row a Poisson weight drawn from the row's key, so a draw depends on nothing but key, replicate and seed. A statistic
of sums (a mean, corpus BLEU, an F1 of confusion cells) needs the weighted sums of its terms per replicate: tasks draw a matrix of
weights, multiply and give out one row per replicate. A median needs weighted ranks: ranges of values are summed per replicate, prefix
sums find the range that holds the rank, and only that range is drawn again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.wordhash import mixed
from evalloom.session import cut_lineage

CHUNK = 256  # rows of one matrix of draws
HELD = 1000  # groups whose sums a task holds
RANGE_ROWS = 100_000  # of one range of values


def poisson_steps(mean: int) -> tuple[int, np.ndarray]:
    """Chances of at most ``k`` for a Poisson variable: the first ``k`` that matters, and the chances from there on."""
    reach = 12 * math.sqrt(mean) + 20
    first = max(0, int(mean - reach))
    k = np.arange(first, int(mean + reach) + 1)
    logs = first * math.log(mean) - mean - math.lgamma(first + 1) + np.concatenate([[0.0], np.cumsum(math.log(mean) - np.log(k[1:]))])
    return first, np.cumsum(np.exp(logs))


def draws(keys: np.ndarray, counts: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Weight of every key (unsigned, with the mean ``counts``) in every replicate."""
    start = mixed(keys + np.uint64(seed))[:, None]
    uniform = (mixed(start + replicates.astype(np.uint64)[None, :]) >> np.uint64(11)) / 2.0**53
    out = np.empty(uniform.shape, dtype=np.int64)
    for count in np.unique(counts).tolist():
        rows = counts == count
        first, steps = poisson_steps(count)
        out[rows] = first + np.searchsorted(steps, uniform[rows], side="right")
    return out


def group_columns(schema: T.StructType, group: list[str], values: tuple, n: int) -> dict[str, pd.Series]:
    """The key of a group as columns of ``n`` rows; pandas gives null keys as NaN and integers beside them as floats."""
    out = {}
    for name, value in zip(group, values, strict=True):
        value = None if pd.isna(value) else int(value) if isinstance(schema[name].dataType, T.IntegralType) else value
        out[name] = pd.Series([value] * n, dtype=object)
    return out


def weighed_rows(df: DataFrame, group: list[str], columns: list[str], key: Column | None) -> DataFrame:
    """Rows with a key and a count: one by one with ``key``, else equal rows as one, whose weight has their number as mean."""
    if key is not None:
        return df.select(*group, *columns, key.cast("long").alias("_key"), F.lit(1).cast("long").alias("_count"))
    counted = df.groupBy(*group, *columns).agg(F.count("*").alias("_count"))
    return counted.withColumn("_key", F.xxhash64(*group, *columns))


def replicate_sums(df: DataFrame, group: list[str], terms: dict[str, Column], replicates: int = 1000, seed: int = 1234,
                   key: Column | None = None) -> DataFrame:
    """Weighted sums of ``terms`` per group and replicate: ``group..., b, weight`` and a double per term.

    ``key`` is an integer that names the row, so that other engines can repeat the draws; without it equal rows are combined first. Null
    terms count as 0. Groups may be null.
    """
    names = list(terms)
    named = df.select(*group, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in terms.items()],
                      *([key.cast("long").alias("_row")] if key is not None else []))
    rows = weighed_rows(named, group, names, F.col("_row") if key is not None else None)
    schema = T.StructType(
        [rows.schema[g] for g in group] + [T.StructField("b", T.IntegerType())]
        + [T.StructField(n, T.DoubleType()) for n in ("weight", *names)]
    )

    def given(held: dict) -> Iterator[pd.DataFrame]:
        for values, sums in held.values():
            yield pd.DataFrame({
                **group_columns(schema, group, values, replicates), "b": np.arange(replicates, dtype=np.int32),
                **dict(zip(("weight", *names), sums, strict=True)),
            })

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        every = np.arange(replicates)
        for batch in batches:
            parts = batch.groupby(group, dropna=False, sort=False) if group else [((), batch)]
            for values, part in parts:
                if str(values) not in held and len(held) >= HELD:
                    yield from given(held)
                    held = {}
                _, sums = held.setdefault(str(values), (values, np.zeros((1 + len(names), replicates))))
                keys, counts = part["_key"].to_numpy().view(np.uint64), part["_count"].to_numpy()
                matrix = part[names].to_numpy(dtype=float)
                for low in range(0, len(part), CHUNK):
                    drawn = draws(keys[low : low + CHUNK], counts[low : low + CHUNK], every, seed)
                    sums[0] += drawn.sum(axis=0)
                    sums[1:] += matrix[low : low + CHUNK].T @ drawn
        yield from given(held)

    sums = rows.mapInPandas(partial, schema).groupBy(*group, "b")
    return sums.agg(*[F.sum(n).alias(n) for n in ("weight", *names)])


def spread(per_replicate: DataFrame, group: list[str], statistic: Column) -> DataFrame:
    """``stderr, replicates`` per group from the statistic of each replicate; replicates without a value are left out."""
    values = per_replicate.select(*group, statistic.cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    return values.groupBy(*group).agg(F.stddev_samp("_x").alias("stderr"), F.count("*").alias("replicates"))


def bootstrap_error(df: DataFrame, group: list[str], terms: dict[str, Column], statistic: Column, replicates: int = 1000,
                    seed: int = 1234, key: Column | None = None) -> DataFrame:
    """Standard error of a statistic of sums: ``statistic`` is an expression of the summed ``terms`` and ``weight``."""
    return spread(replicate_sums(df, group, terms, replicates, seed, key), group, statistic)


def bootstrap_macro_f1(df: DataFrame, group: list[str], gold: str, pred: str, replicates: int = 1000, seed: int = 1234,
                       key: Column | None = None) -> DataFrame:
    """Standard error of the macro F1 over the classes that a replicate holds; the replicates carry confusion cells."""
    cells = replicate_sums(df, [*group, gold, pred], {}, replicates, seed, key).where("weight > 0")
    right = F.when(F.col(gold) == F.col(pred), F.col("weight")).otherwise(0.0)
    side = F.explode(F.array(
        F.struct(F.col(gold).alias("class"), right.alias("tp"), (F.col("weight") - right).alias("off")),
        F.struct(F.col(pred).alias("class"), F.lit(0.0).alias("tp"), (F.col("weight") - right).alias("off")),
    )).alias("c")
    classes = cells.select(*group, "b", side).groupBy(*group, "b", "c.class").agg(F.sum("c.tp").alias("tp"), F.sum("c.off").alias("off"))
    f1 = F.when(2 * F.col("tp") + F.col("off") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("off")))
    macro = classes.where("tp + off > 0").groupBy(*group, "b").agg(F.avg(f1).alias("macro"))
    return spread(macro, group, F.col("macro"))


def bootstrap_median(df: DataFrame, group: list[str], value: str, replicates: int = 1000, seed: int = 1234,
                     key: Column | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Standard error of the median (mean of the two middle rows of a replicate), exactly by ranks; null values are left out.

    A group of any size spans many ranges of values. What is summed is one number per group, range and replicate.
    """
    named = df.select(*group, F.col(value).cast("double").alias("_v"), *([key.cast("long").alias("_row")] if key is not None else []))
    rows = weighed_rows(named.where("_v is not null"), group, ["_v"], F.col("_row") if key is not None else None)
    ranges = max(1, -(-rows.count() // range_rows))
    order = [*group, "_v", "_key"]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    keys = [*group, "_range"]
    weights = T.StructType([dealt.schema[c] for c in keys] + [T.StructField("b", T.IntegerType()), T.StructField("w", T.LongType())])

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.arange(replicates)
        for batch in batches:
            for values, part in batch.groupby(keys, dropna=False, sort=False):
                own, counts, total = part["_key"].to_numpy().view(np.uint64), part["_count"].to_numpy(), np.zeros(replicates, np.int64)
                for low in range(0, len(part), CHUNK):
                    total += draws(own[low : low + CHUNK], counts[low : low + CHUNK], every, seed).sum(axis=0)
                yield pd.DataFrame({**group_columns(weights, keys, values, replicates), "b": every.astype(np.int32), "w": total})

    by_range = cut_lineage(dealt.mapInPandas(totals, weights).groupBy(*keys, "b").agg(F.sum("w").alias("w")))
    along = W.partitionBy(*group, "b")
    before = F.coalesce(F.sum("w").over(along.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = by_range.select(*keys, "b", "w", before.alias("start"), F.sum("w").over(along).alias("n"))
    ranks = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    wanted = placed.where("n > 0").select(*keys, "b", "w", "start", F.explode(ranks).alias("offset"))
    wanted = wanted.withColumn("offset", F.col("offset") - F.col("start"))
    wanted = cut_lineage(wanted.where("offset >= 0 and offset < w").select(*keys, "b", "offset"))
    found = T.StructType([dealt.schema[g] for g in group] + [T.StructField("b", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def look(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = part.sort_values(["_v", "_key"])
        own, counts, held = part["_key"].to_numpy().view(np.uint64), part["_count"].to_numpy(), part["_v"].to_numpy()
        numbers, offsets = asked["b"].to_numpy(), asked["offset"].to_numpy()
        running = np.zeros(len(asked), np.int64)
        for low in range(0, len(part) if len(asked) else 0, CHUNK):
            reach = running + np.cumsum(draws(own[low : low + CHUNK], counts[low : low + CHUNK], numbers, seed), axis=0)
            here = np.flatnonzero((offsets >= running) & (offsets < reach[-1]))
            place = (reach[:, here] <= offsets[here]).sum(axis=0)
            out += list(zip(numbers[here].tolist(), held[low + place].tolist()))
            running = reach[-1]
        own_group = tuple(asked[g].iloc[0] for g in group) if out else (None,) * len(group)
        columns = {n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(("b", "v"))}
        return pd.DataFrame({**group_columns(found, group, own_group, len(out)), **columns})

    near = dealt.join(F.broadcast(wanted.select("_range").distinct()), "_range", "left_semi")
    values = near.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(look, found)
    return spread(values.groupBy(*group, "b").agg(F.avg("v").alias("v")), group, F.col("v"))
