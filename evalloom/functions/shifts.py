"""Edits of a translation with block shifts: greedy shifts of matching word runs, then the edit distance of what is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import words

# fixed values of the published measure
LONGEST_RUN = 10
FARTHEST = 50
CANDIDATES = 1000
TOGETHER = 64  # moves whose distances are computed at once


def table_of(pred: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """All edit distances of prefixes, a row at a time along the shorter side."""
    if len(gold) < len(pred):
        return table_of(gold, pred).T
    steps = np.arange(len(gold) + 1, dtype=np.int32)
    out = np.empty((len(pred) + 1, len(gold) + 1), dtype=np.int32)
    out[0] = steps
    wrong = gold != pred[:, None]
    for i in range(len(pred)):
        last, row = out[i], out[i + 1]
        row[0] = i + 1
        np.minimum(last[1:] + 1, last[:-1] + wrong[i], out=row[1:])
        row -= steps
        np.minimum.accumulate(row, out=row)
        row += steps
    return out


def distance(pred: np.ndarray, gold: np.ndarray) -> int:
    return int(table_of(pred, gold)[-1, -1])


def distances(preds: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Edit distance of each row of ``preds`` to ``gold``: one table for all rows, along the shorter side."""
    along_gold = len(gold) < preds.shape[1]
    long, short = (preds, np.broadcast_to(gold, (len(preds), len(gold)))) if along_gold else (gold[None, :], preds)
    steps = np.arange(long.shape[1] + 1, dtype=np.int32)
    last = np.repeat(steps[None, :], len(preds), axis=0)
    for i in range(short.shape[1]):
        row = np.empty_like(last)
        row[:, 0] = i + 1
        np.minimum(last[:, 1:] + 1, last[:, :-1] + (long != short[:, i, None]), out=row[:, 1:])
        row -= steps
        np.minimum.accumulate(row, axis=1, out=row)
        row += steps
        last = row
    return last[:, -1]


def aligned(pred: np.ndarray, gold: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Distance, wrong words of ``pred``, wrong words of ``gold``, and the word of ``pred`` that stands at or before each of ``gold``."""
    table = table_of(pred, gold)
    rows = table.tolist()
    wrong_pred, wrong_gold = np.ones(len(pred), dtype=bool), np.ones(len(gold), dtype=bool)
    at = np.empty(len(gold), dtype=np.int64)
    i, j = len(pred), len(gold)
    while j:
        if i and rows[i][j] == rows[i - 1][j - 1] + (pred[i - 1] != gold[j - 1]):
            i, j = i - 1, j - 1
            at[j] = i
            wrong_pred[i] = wrong_gold[j] = pred[i] != gold[j]
        elif rows[i][j] == rows[i][j - 1] + 1:
            j -= 1
            at[j] = i - 1
        else:
            i -= 1
    return int(table[-1, -1]), wrong_pred, wrong_gold, at


def moves(pred: np.ndarray, gold: np.ndarray, wrong_pred: np.ndarray, wrong_gold: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, place)``: runs of ``pred`` that occur in ``gold``, wrong in both places, and where they may be put."""
    out = []
    for i, j in np.argwhere(pred[:, None] == gold[None, :]).tolist():
        if abs(i - j) > FARTHEST:
            continue
        length = 0
        while length < LONGEST_RUN and i + length < len(pred) and j + length < len(gold) and pred[i + length] == gold[j + length]:
            length += 1
            if not wrong_pred[i : i + length].any() or not wrong_gold[j : j + length].any() or i <= at[j] < i + length:
                continue
            for place in dict.fromkeys([0 if j == 0 else int(at[j - 1]) + 1, *(int(p) + 1 for p in at[j : j + length])]):
                if not i <= place <= i + length:
                    out.append((i, length, place))
                    if len(out) == CANDIDATES:
                        return out
    return out


def moved(pred: np.ndarray, start: int, length: int, place: int) -> np.ndarray:
    run, rest = pred[start : start + length], np.delete(pred, np.s_[start : start + length])
    return np.insert(rest, place if place < start else place - length, run)


def shift_edits(pred: np.ndarray, gold: np.ndarray) -> int:
    """Shifts and remaining edits. Every round makes the shift that saves most: of equals the longest, then the first."""
    shifts = 0
    while True:
        left, wrong_pred, wrong_gold, at = aligned(pred, gold)
        if not left or not len(pred) or not len(gold):
            return shifts + left
        found = moves(pred, gold, wrong_pred, wrong_gold, at)
        after = [
            d for low in range(0, len(found), TOGETHER)
            for d in distances(np.stack([moved(pred, *m) for m in found[low : low + TOGETHER]]), gold).tolist()
        ]
        best = max([(left - d, m[1], -m[0], -m[2], m) for d, m in zip(after, found)], default=(0,))
        if best[0] <= 0:
            return shifts + left
        pred, shifts = moved(pred, *best[4]), shifts + 1


@F.arrow_udf(T.IntegerType())
def row_edits(preds: pa.Array, golds: pa.Array) -> pa.Array:
    codes = pa.concat_arrays([preds.flatten(), golds.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (preds, golds)]
    ends = [np.cumsum(s) for s in sizes]
    shift = int(ends[0][-1]) if len(preds) else 0
    out = []
    for row in range(len(preds)):
        p = codes[ends[0][row] - sizes[0][row] : ends[0][row]]
        g = codes[shift + ends[1][row] - sizes[1][row] : shift + ends[1][row]]
        out.append(shift_edits(p, g) if preds[row].is_valid and golds[row].is_valid else None)
    return pa.array(out, pa.int32())


def edits_with_shifts(pred: Column, gold: Column) -> Column:
    """Edits of one row over its words; null if a side is null."""
    return row_edits(words(pred), words(gold))


def corpus_ter(pred: str, gold: str) -> Column:
    """Translation edit rate of a group in percent, as published: edits with shifts over the words of the references."""
    return 100.0 * F.sum(edits_with_shifts(F.col(pred), F.col(gold))) / F.sum(F.size(words(F.col(gold))))
