"""Fit-or-cut packing of a whole corpus as one sequence, by a parallel prefix over transition functions.

A document takes the tokens used in the open block to the tokens used after it, and adds some blocks. A run of documents does the
same, as a table over all possible starts, and tables compose. So ranges of keys are summarised in parallel, groups of summaries are
composed, the driver walks one table per group, and the ranges are replayed from their true starts. Texts never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.session import cut_lineage

MERGE_EVERY = 8  # documents after which equal states of a summary are merged
PLACED = "doc_id long, block_no long, at long, start long, length long"
SUMMARY = "range int, packed binary"


def advance(used: np.ndarray, n: np.ndarray, block_size: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens used and blocks closed after a document of ``n`` tokens, and whether the open block was padded before it."""
    room = block_size - used
    padded = (used > 0) & (n > room) & (np.minimum(room, n - room) < threshold)
    end = np.where(padded, 0, used) + n
    return end % block_size, end // block_size + padded, padded


class Transition:
    """For every start: tokens used in the open block at the end, and blocks closed. Starts that meet share one state from then on."""

    def __init__(self, block_size: int):
        self.state = np.arange(block_size)  # of each start
        self.closed = np.zeros(block_size, dtype=np.int64)  # by each start before it joined its state
        self.used = np.arange(block_size)  # of each state
        self.blocks = np.zeros(block_size, dtype=np.int64)

    def merge(self) -> None:
        used, where = np.unique(self.used, return_inverse=True)
        if len(used) < len(self.used):
            self.closed += self.blocks[self.state]
            self.state = where[self.state]
            self.used, self.blocks = used, np.zeros(len(used), dtype=np.int64)

    def feed(self, lengths: np.ndarray, block_size: int, threshold: int) -> None:
        for i, n in enumerate(lengths.tolist()):
            self.used, closed, _ = advance(self.used, n, block_size, threshold)
            self.blocks += closed
            if i % MERGE_EVERY == 0 and len(self.used) > 1:
                self.merge()

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return self.used[self.state], self.closed + self.blocks[self.state]

    def pack(self) -> bytes:
        return zlib.compress(np.stack(self.table()).astype(np.int64).tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    used, blocks = np.frombuffer(zlib.decompress(packed), np.int64).reshape(2, -1)
    return used, blocks


def starts_of(tables: list[tuple[int, bytes]], used: int, block: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """``(number, used, block)`` at the start of each table, in order, and the state after the last."""
    out = []
    for number, packed in tables:
        out.append((number, used, block))
        after, closed = unpack(packed)
        used, block = int(after[used]), block + int(closed[used])
    return out, used, block


def range_starts(ranges: DataFrame, block_size: int, threshold: int) -> DataFrame:
    """``range, used, block`` at the start of every range of ``ranges`` (``range, doc_id, n``, sorted inside its partitions)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, None
        for batch in batches:
            if batch.num_rows:
                number = batch.column(0)[0].as_py()
                held = held or Transition(block_size)
                held.feed(batch.column(2).to_numpy(), block_size, threshold)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([held.pack()], pa.binary())], ["range", "packed"])

    tables = cut_lineage(ranges.mapInArrow(summarise, SUMMARY))
    width = isqrt(tables.count()) + 1  # ranges of a group: about as many as there are groups
    grouped = tables.withColumn("part", F.floor(F.col("range") / width).cast("int"))

    def compose(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        used, blocks = np.arange(block_size), np.zeros(block_size, dtype=np.int64)
        for packed in rows.sort_by("range")["packed"].to_pylist():
            after, closed = unpack(packed)
            used, blocks = after[used], blocks + closed[used]
        whole = zlib.compress(np.stack([used, blocks]).astype(np.int64).tobytes(), 1)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([whole], pa.binary())})

    parts = sorted((r["range"], r["packed"]) for r in grouped.groupBy("part").applyInArrow(compose, SUMMARY).toLocalIterator())
    begins = {number: (used, block) for number, used, block in starts_of(parts, 0, 0)[0]}

    def descend(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found, _, _ = starts_of([(r["range"], r["packed"]) for r in rows.sort_by("range").to_pylist()], *begins[key[0].as_py()])
        return pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("range", "used", "block"), zip(*found), (pa.int32(), pa.int64(), pa.int64()))})

    return grouped.groupBy("part").applyInArrow(descend, "range int, used long, block long")


def fit_or_cut_all(docs: DataFrame, length: Column, block_size: int, threshold: int, key: str = "doc_id",
                   ranges: int | None = None) -> DataFrame:
    """Place all documents, in key order, into one sequence of blocks: ``doc_id, block_no, at, start, length`` per fragment.

    A document that overflows its block is cut there, unless the part that fits or the part left over is shorter than ``threshold``:
    then the block stays padded and the document opens the next one. The result is that of one sequential walk for any number of
    ``ranges`` (by default as many as the session has shuffle partitions). Documents of no or unknown length have no fragment; of repeated
    keys the shorter one comes first.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), length.cast("long").alias("n")).where("n > 0")
    dealt = rows.repartitionByRange(ranges, "doc_id", "n") if ranges else rows.repartitionByRange("doc_id", "n")
    ordered = dealt.sortWithinPartitions("doc_id", "n").select(F.spark_partition_id().alias("range"), "doc_id", "n")
    ordered = cut_lineage(ordered)  # a range keeps its number and its order
    starts = cut_lineage(range_starts(ordered, block_size, threshold))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = block = None
        for batch in batches:
            out: list[tuple] = []
            if batch.num_rows and used is None:
                used, block = batch.column(3)[0].as_py(), batch.column(4)[0].as_py()
            for doc, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                room = block_size - used
                if used and n > room and min(room, n - room) < threshold:
                    block, used = block + 1, 0
                done = 0
                while done < n:
                    part = min(block_size - used, n - done)
                    out.append((doc, block, used, done, part))
                    done, used = done + part, used + part
                    if used == block_size:
                        block, used = block + 1, 0
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in PLACED.split(", ")])

    # one row per range: joined without a shuffle of the documents, so that they stay in order
    begun = ordered.join(F.broadcast(starts), "range")
    return begun.select("range", "doc_id", "n", "used", "block").mapInArrow(place, PLACED)


def whole_blocks(docs: DataFrame, placed: DataFrame, tokens: str, block_size: int, pad_token: int, key: str = "doc_id") -> DataFrame:
    """Blocks of exactly ``block_size`` tokens from the fragments of :func:`fit_or_cut_all`: ``block_no, tokens``. Keys are distinct."""
    body = docs.select(F.col(key).alias("doc_id"), F.col(tokens).alias("_tokens"))
    pieces = placed.join(body, "doc_id").select(
        "block_no",
        F.struct("at", F.slice("_tokens", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("p")).alias("f"),
    )
    joined = pieces.groupBy("block_no").agg(F.flatten(F.array_sort(F.collect_list("f"))["p"]).alias("tokens"))
    short = F.lit(block_size) - F.size("tokens")
    return joined.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(pad_token), short)))
