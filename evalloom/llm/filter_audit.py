"""Interaction of quality filters: what each one removes in every order, from counts of failure masks.

A document is its mask, one bit for each filter that it fails, so the corpus shrinks to counts per part and mask. All sets of active
filters are then visited in Gray-code order: one filter is switched on or off at a time, the masks that hold it move their counter of
active failures, and a mask whose counter leaves or reaches zero leaves or joins the running survivors. The survivors of
every set are stored; a step of an order is the difference of two sets.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import SPACE, column, table

LEAST_WORDS = 100
LEAST_DISTINCT = 80  # percent of the words
MOST_CAPITALS = 10  # percent of the characters
SYMBOLS = "[#$%&*|]"
NAMES = "ABCDE"
COUNTS = ("n", "good", "toxic")
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def text_failures(text: Column) -> list[Column]:
    """Failure of A (few words), B (few distinct words), C (many capitals) and D (symbols), for a text that is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    few, repeated = F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words)
    capitals = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text)
    return [few, repeated, capitals, text.rlike(SYMBOLS)]


def failure_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, mask, good, toxic`` per row of ``docs``; bit ``i`` of ``mask`` is set if the row fails filter ``NAMES[i]``.

    E fails rows whose text occurs with a smaller id. Repeated texts are found by two 64-bit hashes with a combining aggregate; the
    join back has one row per text on one side, so Spark splits a text of very many rows. Null and empty texts are one text. Rows without
    id never fail E and make no other row fail; they have no labels. Of several labels of an id, any 1 counts.
    """
    body = F.coalesce(column(text), F.lit(""))
    own = docs.select(
        column(doc_id).cast("long").alias("id"), F.coalesce(column(part).cast("string"), F.lit("")).alias("part"), body.alias("text")
    )
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), F.col("text")).alias("h2")]
    repeated = (
        own.select("id", *hashes).groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    ).drop("last")
    flags = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = own.select("id", "part", flags.alias("mask"), *hashes).join(repeated, ["h1", "h2"], "left")
    marked = labels.select(
        F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")
    ).where("label_id is not null and (q or t)")
    marked = marked.groupBy("label_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("q", "t")])
    late = F.when(F.col("id") > F.col("first"), F.lit(1 << 4)).otherwise(F.lit(0))
    return rows.join(marked, F.col("id") == F.col("label_id"), "left").select(
        "part", F.col("mask").bitwiseOR(late).alias("mask"),
        *[F.coalesce(F.col(c), F.lit(False)).cast("long").alias(name) for c, name in (("q", "good"), ("t", "toxic"))],
    )


def mask_counts(rows: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: at most one row per part and mask, combined before the shuffle."""
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def survivors(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every set of active filters, a row of ``counts`` columns each, by the Gray-code walk."""
    states = np.zeros((1 << filters, counts.shape[1]), dtype=np.int64)
    failing = np.zeros(len(masks), dtype=np.int64)  # active filters that each mask fails
    running = counts.sum(axis=0)
    states[0] = running
    active = 0
    for number in range(1, 1 << filters):
        toggled = (number & -number).bit_length() - 1
        active ^= 1 << toggled
        touched = (masks >> toggled) & 1 == 1
        if active >> toggled & 1:
            running = running - counts[touched & (failing == 0)].sum(axis=0)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            running = running + counts[touched & (failing == 0)].sum(axis=0)
        states[active] = running
    return states


def step_table(states: np.ndarray, names: str) -> dict[str, list]:
    """Every step of every order from the stored states: column name to values."""
    size = len(names)
    everything = (1 << size) - 1
    failing = [int(states[0, 0] - states[1 << f, 0]) for f in range(size)]
    alone = [int(states[everything ^ 1 << f, 0] - states[everything, 0]) for f in range(size)]
    shares = []  # of each filter: its removals, each set before it as often as orders have it
    for f in range(size):
        before = [s for s in range(1 << size) if not s >> f & 1]
        orders = [factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()) for s in before]
        shares.append(sum(o * int(states[s, 0] - states[s | 1 << f, 0]) for o, s in zip(orders, before)))
    out: dict[str, list] = {name.split()[0]: [] for name in AUDIT.split(", ")[1:]}
    for order in permutations(range(size)):
        active = 0
        for step, f in enumerate(order, 1):
            lost = states[active] - states[active | 1 << f]
            active |= 1 << f
            values = (
                "".join(names[i] for i in order), step, int(states[active, 0]), int(lost[0]), failing[f] - int(lost[0]),
                alone[f], int(lost[1]), int(lost[2]), shares[f],
            )
            for column, value in zip(out.values(), values):
                column.append(value)
    return out


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """The steps of all orders of the filters ``names``, per part. ``counts`` is :func:`mask_counts`, ``2 ** filters`` rows a part at most.

    A part without rows does not exist; so an empty corpus has no row.
    """

    def walk(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        states = survivors(cells["mask"].to_numpy(np.int64), cells[list(COUNTS)].to_numpy(np.int64), len(names))
        return pd.DataFrame({"part": key[0], **step_table(states, names)})

    return counts.groupBy("part").applyInPandas(walk, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the five filters and step: what is kept, removed and lost there; see :func:`failure_masks`.

    ``redundant`` are failures of the step's filter removed before it, ``unique_fails`` those that fail only it, ``shapley`` its removals
    summed over all orders. Only the named columns are read, so other columns may have any name; repeated rows count one by one.
    """
    return audit(mask_counts(failure_masks(docs, labels, **columns)))


SQL = r"""
WITH own AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM own),
flags AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM split),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS t FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(q), 0) AS good, coalesce(sum(t), 0) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(range(0, 5)) AS f, unnest(['A', 'B', 'C', 'D', 'E']) AS name),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS fs
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, fs[step] AS f,
         CAST(coalesce(list_sum(list_transform(fs[1 : step - 1], lambda i: 1 << i)), 0) AS BIGINT) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT c.part, s.filter_order, s.step, s.f,
    sum(n) FILTER (WHERE mask & (earlier | (1 << f)) = 0) AS kept,
    sum(n) FILTER (WHERE mask & earlier = 0 AND mask & (1 << f) <> 0) AS removed,
    sum(n) FILTER (WHERE mask & earlier <> 0 AND mask & (1 << f) <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = 1 << f) AS unique_fails,
    sum(good) FILTER (WHERE mask & earlier = 0 AND mask & (1 << f) <> 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & (1 << f) <> 0) AS toxic_lost
  FROM cells c, steps s GROUP BY c.part, s.filter_order, s.step, s.f, s.earlier)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM counted
"""


def op11_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
