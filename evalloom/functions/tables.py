"""Table functions for SQL: one row in, many rows out, by name.

``register(spark)`` makes them known as ``ngram_offsets(text, n)``, ``ngram_totals(text, n)`` and ``option_swaps(choices, gold)`` for ``LATERAL``, and
``conversation_spans(TABLE(...) PARTITION BY conversation ORDER BY turn)`` over partitions. Rows travel in Arrow batches.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

DROP = str.maketrans("", "", string.punctuation)
WORD = re.compile(r"\S+")


class NgramOffsets:
    """N-grams of normalised words with the characters they cover in the text; null and short texts give no row."""

    def eval(self, text: str, n: int) -> Iterator[tuple]:
        kept = []
        for match in WORD.finditer(text or ""):
            word = match.group().lower().translate(DROP)
            if word:
                kept.append((word, *match.span()))
        for i in range(len(kept) - n + 1):
            run = kept[i : i + n]
            yield i, " ".join(w for w, _, _ in run), run[0][1], run[-1][2]


class NgramTotals(NgramOffsets):
    """Number, sums of the offsets and the smallest of a text's n-grams in one row; null and short texts give no row."""

    def eval(self, text: str, n: int) -> Iterator[tuple]:
        count = starts = stops = 0
        first = None
        for _, ngram, start, stop in super().eval(text, n):
            count, starts, stops = count + 1, starts + start, stops + stop
            first = ngram if first is None or ngram < first else first
        if count:
            yield count, starts, stops, first


class OptionSwaps:
    """A copy of the choices for every label, with the correct option at that label; none without choices or with a label outside."""

    def eval(self, choices: list, gold: int) -> Iterator[tuple]:
        if not choices or gold is None or not 0 <= gold < len(choices):
            return
        others = choices[:gold] + choices[gold + 1 :]
        for place in range(len(choices)):
            yield place, others[:place] + [choices[gold]] + others[place:]


class ConversationSpans:
    """Characters of each turn in its conversation, turns joined by one line feed; called per partition, in turn order."""

    def __init__(self):
        self.at = 0

    def eval(self, row) -> Iterator[tuple]:
        size = len(row["text"] or "")
        yield row["conv_id"], row["turn"], self.at, self.at + size
        self.at += size + 1


FUNCTIONS = {
    "ngram_offsets": (NgramOffsets, "pos int, ngram string, start int, stop int"),
    "ngram_totals": (NgramTotals, "n_ngrams bigint, sum_start bigint, sum_stop bigint, first_ngram string"),
    "option_swaps": (OptionSwaps, "place int, choices array<string>"),
    "conversation_spans": (ConversationSpans, "conv_id bigint, turn bigint, start bigint, stop bigint"),
}


def register(spark: SparkSession) -> None:
    for name, (handler, returns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=returns, useArrow=True))
