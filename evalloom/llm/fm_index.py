"""A compressed FM-index over word sequences: suffix-sorted BWT in a bit-packed wavelet matrix, searched backwards for many patterns
at once with numpy."""

from __future__ import annotations

import numpy as np

LOW_BITS = np.array([(1 << i) - 1 for i in range(64)], dtype=np.uint64)


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Prefix doubling; the first ranks may repeat, the suffixes are told apart by what follows."""
    n = len(ranks)
    rank, step = ranks.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        value = rank[order]
        compact = np.empty(n, dtype=np.int64)
        compact[order] = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
        if compact[order[-1]] == n - 1:
            return order
        follow = np.full(n, -1, dtype=np.int64)
        follow[: n - step] = compact[step:]
        rank = compact * (n + 1) + follow + 1
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """Rank of any symbol in a sequence; one packed bit row and its counts per bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.rows: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        n = len(sequence)
        for level in range(self.levels - 1, -1, -1):
            bits = ((sequence >> level) & 1).astype(np.uint8)
            padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            padded[:n] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64)
            ones = bits.astype(bool)
            zeros = n - int(ones.sum())
            self.rows.append((level, packed, counts, zeros))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        symbols = np.arange(alphabet)
        self.base = self.descend(symbols, np.zeros(alphabet, dtype=np.int64))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, counts, zeros in self.rows:
            block = at >> 6
            ones = counts[block] + np.bitwise_count(packed[block] & LOW_BITS[at & 63])
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.descend(symbols, at) - self.base[symbols]


class FMIndex:
    """Index over sequences of positive symbols; 0 is between them. ``owner`` gives the sequence of each suffix, in suffix order."""

    def __init__(self, text: np.ndarray, alphabet: int):
        gaps = text == 0
        n_gaps = int(gaps.sum())
        ranks = np.where(gaps, np.cumsum(gaps) - 1, text + n_gaps)  # every gap is a symbol of its own
        order = suffix_array(ranks)
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])[:-1]
        self.matrix = WaveletMatrix(text[order - 1], alphabet)
        self.owner = (np.cumsum(gaps) - gaps)[order]

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one more symbol in front."""
        return (self.first[symbols] + self.matrix.rank(symbols, low), self.first[symbols] + self.matrix.rank(symbols, high))

    def matches(self, stream: np.ndarray, ends: np.ndarray, length: int,
                indexed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of ``stream`` up to ``length``: for every place in ``ends``, how many symbols up to it (included)
        occur in the index, and the suffix interval of that match.

        With ``indexed`` the streamed runs are in the index themselves, so a search that is down to one suffix has found just the
        run it came from: it ends there, as a match of a single suffix.
        """
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.size, dtype=np.int64)
        matched = np.zeros(len(ends), dtype=np.int64)
        active = np.arange(len(ends))
        for k in range(length):
            place = ends[active] - k
            inside = place >= 0
            symbols = np.where(inside, stream[place], 0)
            active, symbols = active[symbols > 0], symbols[symbols > 0]
            if not len(active):
                break
            a, b = self.step(symbols, low[active], high[active])
            found = b > a
            active, a, b = active[found], a[found], b[found]
            low[active], high[active] = a, b
            matched[active] = k + 1
            if indexed:
                active = active[b - a > 1]
        return matched, low, high
