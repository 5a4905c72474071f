"""Heavy hitters and distinct counts from mergeable sketches.

The first pass keeps a frequent-item summary per task: at most ``size`` counters, and the most that any count can be short. Summaries
add up, so what is shuffled is ``size`` rows a task instead of every distinct item. Items that can be among the first are counted
exactly in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.session import cut_lineage

SIZE = 1000  # counters of a task, for each item asked for at least SIZE / 4
BATCH_ITEMS = 1 << 20
LARGEST_SIZE = 1 << 20


class Summary:
    """Counters of the most frequent items: a count is at most ``short`` below the truth, and an item without counter occurs at most so often."""

    def __init__(self, size: int):
        self.size, self.short = size, 0
        self.items, self.counts = pa.array([], pa.string()), np.empty(0, np.int64)

    def add(self, items: pa.Array, counts: np.ndarray) -> None:
        table = pa.table({"i": pa.concat_arrays([self.items, items]), "n": np.concatenate([self.counts, counts])})
        table = table.group_by("i").aggregate([("n", "sum")])
        held = table["n_sum"].to_numpy()
        if len(held) > self.size:
            order = np.argsort(-held, kind="stable")
            cut = int(held[order[self.size]])  # what the first counter left out has: all others give up as much
            kept = order[: self.size][held[order[: self.size]] > cut]
            self.short += cut
            self.items, self.counts = table["i"].combine_chunks().take(pa.array(kept)), held[kept] - cut
        else:
            self.items, self.counts = table["i"].combine_chunks(), held

    def row(self) -> pa.RecordBatch:
        n = len(self.items)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([self.items, pa.array([None], pa.string())]), pa.array(np.append(self.counts, self.short))], ["item", "n"]
        ) if n or self.short else pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["item", "n"])


def summaries(items: DataFrame, item: str, size: int) -> DataFrame:
    """``item, n`` of every task's summary; the row without item holds what its counts may be short. Null items are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, parts, held = Summary(size), [], 0

        def flush() -> None:
            counted = pc.value_counts(pa.chunked_array(parts, pa.string()))
            summary.add(counted.field(0).cast(pa.string()), counted.field(1).to_numpy(zero_copy_only=False).astype(np.int64))

        for batch in batches:
            column = batch.column(0)
            column = pc.list_flatten(column) if pa.types.is_list(column.type) else column
            parts.append(column.drop_null().cast(pa.string()))
            held += len(parts[-1])
            if held >= BATCH_ITEMS:
                flush()
                parts, held = [], 0
        if held:
            flush()
        yield summary.row()

    return items.select(item).mapInArrow(run, "item string, n long")


def heavy_hitters(items: DataFrame, item: str, k: int, size: int = SIZE) -> DataFrame:
    """The ``k`` most frequent items with exact counts, ties to the smaller item: ``item, n``.

    ``item`` is a string column, or an array of strings so that no item becomes a row before it is counted. Candidates are those whose
    count can reach the ``k``-th lower bound. If an item without counter could, the summaries are made larger; a flat distribution ends at
    ``LARGEST_SIZE`` counters, beyond which all items are counted.
    """
    is_list = items.schema[item].dataType.typeName() == "array"
    while True:
        merged = cut_lineage(summaries(items, item, size).groupBy("item").agg(F.sum("n").alias("n")))
        short = merged.where("item is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        first = [r["n"] for r in merged.where("item is not null").orderBy(F.desc("n")).limit(k).collect()]
        least = first[-1] if len(first) == k else 0
        if not short or least > short:
            break
        if size >= LARGEST_SIZE:
            merged = None
            break
        size *= 8
    rows = items.select(F.explode(item).alias("item")) if is_list else items.select(F.col(item).alias("item"))
    if merged is not None:
        # few: counts above the bound add up to at most all items
        able = merged.where(F.col("item").isNotNull() & (F.col("n") + short >= least)).select("item")
        if is_list:
            listed = [r["item"] for r in able.collect()]
            rows = items.select(F.explode(F.filter(item, lambda x: x.isin(listed))).alias("item")) if len(listed) <= 2 * k + 1000 else (
                rows.join(able, "item", "left_semi")
            )
        else:
            rows = rows.join(able, "item", "left_semi")
    counted = rows.where("item is not null").groupBy("item").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "item").limit(k)


def precision_for(error: float, deviations: float = 6.5) -> int:
    """Precision at which an estimate is off by more than ``error`` only beyond that many standard deviations, of 1.04 / 2 ** (precision / 2)."""
    return max(4, min(21, ceil(2 * log2(deviations * 1.04 / error))))


def distinct_sketches(pairs: DataFrame, key: str, value: str, precision: int = 12) -> DataFrame:
    """``key, sketch`` of the distinct ``value`` per key: one batch of a table that grows by batches."""
    return pairs.groupBy(key).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def merged_distinct(sketches: DataFrame, key: str) -> DataFrame:
    """``key, n`` estimated over the sketches of all batches; a value in several batches counts once."""
    return sketches.groupBy(key).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
