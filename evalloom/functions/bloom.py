"""Blocked Bloom filters over 64-bit keys: built in tasks, merged by tree, and tested on whole arrays of keys.

A key belongs to one block of eight 32-bit words and sets one bit in each, so a test touches 32 bytes. At ``BITS_PER_KEY`` bits a key,
about one foreign key in two hundred passes; a key of the filter always does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.wordhash import mixed

BITS_PER_KEY = 14
LANES = 8  # words of a block
MAX_BYTES = 256 << 20  # of a filter; with more keys than fit, more foreign keys pass and nothing else changes
CHUNK = 1 << 15  # blocks that travel as one row: 1 MB
FAN = 32  # filters merged by one task in the first round
# one odd number a lane, from a rule
TURNS = mixed(np.arange(1, LANES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_BYTES) -> int:
    """Blocks of a filter for so many keys."""
    return max(1, min(-(-keys * bits_per_key // (32 * LANES)), max_bytes // (4 * LANES)))


class Bloom:
    """A filter of ``blocks`` blocks; ``add`` and ``has`` take arrays of unsigned 64-bit keys."""

    def __init__(self, blocks: int, words: np.ndarray | None = None):
        self.words = np.zeros((blocks, LANES), dtype=np.uint32) if words is None else words

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = mixed(keys.astype(np.uint64, copy=False))
        block = ((keys >> np.uint64(32)) * np.uint64(len(self.words))) >> np.uint64(32)
        low = keys.astype(np.uint32)
        bits = np.uint32(1) << ((low[:, None] * TURNS) >> np.uint32(27))
        return block.astype(np.int64), bits

    def add(self, keys: np.ndarray) -> None:
        block, bits = self.places(keys)
        np.bitwise_or.at(self.words, block, bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        block, bits = self.places(keys)
        return ((self.words[block] & bits) == bits).all(axis=1)

    def pack(self) -> bytes:
        return zlib.compress(self.words.tobytes(), 1)

    @staticmethod
    def unpack(packed: bytes) -> Bloom:
        return Bloom(0, np.frombuffer(zlib.decompress(packed), np.uint32).reshape(-1, LANES))


def bloom_of(rows: DataFrame, key: Column | str, keys: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_BYTES) -> Bloom:
    """The filter of the 64-bit column ``key`` of ``rows``, sized for ``keys`` of them. Null keys are left out.

    Each task fills a filter and gives out the chunks that have a bit; chunks meet ``FAN`` tasks at a time and then by number, so the
    driver receives one filter of bounded size whatever the number of tasks.
    """
    blocks = blocks_for(keys, bits_per_key, max_bytes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(blocks)
        for batch in batches:
            own.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
        for number in range(0, -(-blocks // CHUNK)):
            part = own.words[number * CHUNK : (number + 1) * CHUNK]
            if part.any():
                yield chunk_row(number, part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), np.uint32)
                if n != number:
                    if held is not None:
                        yield chunk_row(number, held)
                    number, held = n, part.copy()
                else:
                    held |= part
        if held is not None:
            yield chunk_row(number, held)

    def chunk_row(number: int, part: np.ndarray) -> pa.RecordBatch:
        packed = zlib.compress(np.ascontiguousarray(part).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "packed"])

    shape = "chunk int, packed binary"
    named = rows.select(F.col(key).alias("key") if isinstance(key, str) else key.alias("key"))
    chunks = named.mapInArrow(fill, shape).withColumn("slot", F.floor(F.spark_partition_id() / FAN))
    once = chunks.repartition("chunk", "slot").sortWithinPartitions("chunk").select("chunk", "packed").mapInArrow(merge, shape)
    whole = once.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, shape)
    out = Bloom(blocks)
    for row in whole.toLocalIterator():
        begin = row["chunk"] * CHUNK
        part = np.frombuffer(zlib.decompress(row["packed"]), np.uint32).reshape(-1, LANES)
        out.words[begin : begin + len(part)] |= part
    return out
