"""Words of a batch of texts as flat numpy arrays: offsets, documents and 64-bit hashes, without a loop over words.

A word is a run of bytes other than ASCII white space. Word hashes come from one prefix sum over the bytes of the batch; hashes of
runs of words from shifted sums of the word hashes. Equal runs always have equal hashes; exact comparison of hits is up to the
caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19  # the arrays of a pass over the words take a multiple of it
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    doc: np.ndarray  # number of the text that a word is in
    start: np.ndarray  # first byte of the word in ``data``
    end: np.ndarray  # byte after it
    first: np.ndarray  # number of the first word of each text, and the number of words
    hash: np.ndarray


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of the column with about ``limit`` bytes, at least one text each; with the number of their first row."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, texts.slice(low, high - low)
        low = high


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64."""
    inverse = pow(int(BASE), -1, 1 << 64)
    out = []
    for factor in (BASE, np.uint64(inverse)):
        steps = np.full(size, factor, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(value: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    value = value ^ (value >> np.uint64(32))
    value = value * STEP
    value ^= value >> np.uint64(29)
    value *= BASE
    return value ^ (value >> np.uint64(32))


def words_of(texts: pa.Array, table: np.ndarray | None = None) -> Words:
    """Words of a slice from :func:`pieces`; ``table`` maps bytes to bytes first."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[low:high] if buffer is not None else np.empty(0, np.uint8)
    if table is not None:
        data = table[data]
    bounds = offsets - low
    solid = ~WHITE[data]
    # a word starts where a solid byte follows white space or the start of a text
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    size = 1 << max(20, int(len(data) + 1).bit_length())
    up, down = powers(size)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    return Words(data, doc, start, end, first, mixed(value))


def run_hashes(words: Words, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and whether those words are in one text; ``len(words) - n + 1`` entries.

    Another ``salt`` gives another hash of the same words.
    """
    hashes = mixed(words.hash + np.uint64(salt)) if salt else words.hash
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    value = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        value *= STEP
        value += hashes[k : k + count]
    return mixed(value), words.doc[:count] == words.doc[n - 1 :]
