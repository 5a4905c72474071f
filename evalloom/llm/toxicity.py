"""Toxicity by a classifier chain: categories in order, each a linear model that also sees the probabilities of the earlier ones.

The models are fitted on a bounded sample of labelled rows, whose texts become hashed word counts inside Spark tasks. In training
the earlier probabilities are out-of-fold predictions; in scoring they come from the models fitted on all folds. Every document
is scored over its whole text in one pass that shuffles nothing.

The ``labels`` table marks two things. The chain has three categories: ``junk`` (quality 0), ``toxic`` (toxic 1) and ``severe``: a
toxic document whose share of marker words is at least the median of toxic documents, where marker words are those that
the sample shows at least ``MARKER_ODDS`` times as often in toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.wordhash import Words, mixed, pieces, powers, words_of
from evalloom.llm.common import column, matched_rows, table, text_key, uniform
from evalloom.llm.contamination import NEUTRAL
from evalloom.llm.linear import Sparse, fit, sigmoid

CATEGORIES = ("junk", "toxic", "severe")
SAMPLE_ROWS = (5000, 2500)  # labelled documents at most whose toxic label is 0, and 1
WIDTH_BITS = 20  # hashed features
STEM = 5  # bytes of the word beginning that is a feature too
WIDEST_GAP = 6  # bytes between words that the shape feature tells apart
SCALE = 50.0  # of the share of a document's words that a feature has
LEAST_DOCUMENTS = 3  # sample documents that a feature must occur in, and at least this share of the sample
LEAST_SHARE = 0.002
SAMPLE_BLOCK = 128  # rows of the sample that become columns at once
MARKER_ODDS = 8.0
FOLDS = 3
THRESHOLD = 0.3
SEED = 4


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three hashed features per word: the word, its first bytes, and its shape (the bytes up to the next word of the text, and
    whether that is the same word)."""
    mask = np.uint64((1 << WIDTH_BITS) - 1)
    stop = np.minimum(words.end, words.start + STEM)
    up, down = powers(1 << max(20, int(len(words.data) + 1).bit_length()))
    total = np.zeros(len(words.data) + 1, dtype=np.uint64)
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * up[: len(words.data)], out=total[1:])
    stem = mixed((total[stop] - total[words.start]) * down[words.start] + np.uint64(1))
    shape = np.zeros(len(words.hash), dtype=np.uint64)
    gap = np.minimum(words.start[1:] - words.end[:-1], WIDEST_GAP).astype(np.uint64)
    same = (words.hash[1:] == words.hash[:-1]).astype(np.uint64)
    shape[:-1] = np.where(words.doc[1:] == words.doc[:-1], 2 * gap + same, 0)
    return tuple((h & mask).astype(np.int64) for h in (words.hash, stem, mixed(shape + np.uint64(1))))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, rows: tuple[int, int]) -> DataFrame:
    """Counts of the labelled documents drawn by a hash of the id, at most ``rows[v]`` with the toxic label ``v``.

    ``doc_id, junk, toxic, n_words, feature, n``. Rows without id, text or toxic label are not drawn; a quality that is null
    counts as good.
    """
    marked = labels.select(
        F.col("doc_id").cast("long").alias("_id"),
        (F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int").alias("junk"),
        F.col("toxic").cast("int").alias("toxic"),
    ).where("_id is not null and toxic in (0, 1)")
    draw = uniform("_id", SEED)
    parts = [marked.where(F.col("toxic") == v).orderBy(draw, "_id", "junk").limit(rows[v]) for v in (0, 1)]
    both = parts[0].unionByName(parts[1])  # bounded by sum(rows), and narrow
    # of several labels of an id the smallest
    drawn = both.groupBy("_id").agg(F.min(F.struct("toxic", "junk")).alias("y")).select("_id", "y.junk", "y.toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, piece in pieces(batch.column(3)):
                words = words_of(piece, NEUTRAL)
                one, two, three = word_features(words)
                for row in range(len(piece)):
                    a, b = words.first[row], words.first[row + 1]
                    feature, n = np.unique(np.concatenate([one[a:b], two[a:b], three[a:b]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(i).slice(low + row, 1) for i in range(3)], pa.array([int(b - a)], pa.int64()),
                         pa.array([feature.astype(np.int32)]), pa.array([n.astype(np.int32)])],
                        ["doc_id", "junk", "toxic", "n_words", "feature", "n"],
                    )

    bodies = docs.select(column(doc_id).cast("long").alias("doc_id"), F.lower(column(text)).alias("text"))
    return (
        bodies.join(F.broadcast(drawn), bodies["doc_id"] == drawn["_id"])
        .where("text is not null")
        .select("doc_id", "junk", "toxic", "text")
        .mapInArrow(count, "doc_id long, junk int, toxic int, n_words long, feature array<int>, n array<int>")
    )


class Chain(NamedTuple):
    """Dense weights over all hashed features, one row per category, and the weights of the earlier probabilities."""

    names: tuple[str, ...]
    weight: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """``sums``: per document the weighted feature sums of each category, already divided by its words."""
        out = np.zeros_like(sums)
        for j in range(len(self.names)):
            out[:, j] = sigmoid(sums[:, j] + out[:, :j] @ self.earlier[j, :j] + self.bias[j])
        return out


def fit_chain(rows: Sparse, targets: np.ndarray, folds: np.ndarray) -> list:
    """One model per column of ``targets``; later ones see out-of-fold probabilities of the earlier ones."""
    models, dense = [], np.zeros((len(targets), 0))
    for j in range(targets.shape[1]):
        out = np.zeros(len(targets))
        for fold in np.unique(folds):
            inside, outside = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
            part = fit(rows.take(outside), dense[outside], targets[outside, j])
            out[inside] = part.predict(rows.take(inside), dense[inside])
        models.append(fit(rows, dense, targets[:, j]))
        dense = np.column_stack([dense, out])
    return models


def severity(rows: Sparse, toxic: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Toxic rows whose share of marker features is at least the median of the toxic rows.

    Markers and median of a fold come from the other folds, so the target of a row does not depend on its own label and features alone.
    """
    out = np.zeros(len(toxic))
    smooth = 0.5 * SCALE / 100
    for fold in np.unique(folds):
        others = folds != fold
        totals = [rows.back(toxic * others), rows.back((1.0 - toxic) * others)]
        share = [(t + smooth / max(1, rows.width)) / (t.sum() + smooth) for t in totals]
        density = rows.dot((share[0] >= MARKER_ODDS * share[1]).astype(float))
        known = density[others & (toxic == 1)]
        if len(known):
            mine = ~others & (toxic == 1)
            out[mine] = density[mine] >= np.median(known)
    return out


def frequent_columns(sample: pa.Table, order: np.ndarray, place: np.ndarray, width: int, entries: int) -> Sparse:
    """Rows of the sample in that order, with the columns that have a ``place``; read some rows at a time."""
    start = np.zeros(len(order) + 1, dtype=np.int64)
    column, value = np.empty(entries, np.int32), np.empty(entries, np.float32)
    for low in range(0, len(order), SAMPLE_BLOCK):
        some = sample.select(["feature", "n", "n_words"]).take(pa.array(order[low : low + SAMPLE_BLOCK])).combine_chunks()
        feature, n = some["feature"].combine_chunks(), some["n"].combine_chunks()
        lengths = feature.value_lengths().to_numpy()
        words = np.repeat(np.maximum(some["n_words"].to_numpy(), 1), lengths)
        at = place[feature.flatten().to_numpy()]
        kept = at >= 0
        row = np.repeat(np.arange(len(lengths)), lengths)[kept]
        first = start[low]
        start[low + 1 : low + 1 + len(lengths)] = first + np.cumsum(np.bincount(row, minlength=len(lengths)))
        part = slice(first, start[low + len(lengths)])
        column[part], value[part] = at[kept], (SCALE * n.flatten().to_numpy() / words)[kept]
    return Sparse(start, column, value, width)


def train_chain(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                sample_rows: tuple[int, int] = SAMPLE_ROWS) -> Chain:
    """Fit the chain on at most ``sum(sample_rows)`` labelled documents (their counts reach the driver, not their texts)."""
    sample = labelled_sample(docs, labels, doc_id, text, sample_rows).toArrow()
    order = np.lexsort([sample["n_words"].to_numpy(), sample["toxic"].to_numpy(), sample["doc_id"].to_numpy()])
    holders = np.zeros(1 << WIDTH_BITS, dtype=np.int64)
    for part in sample["feature"].iterchunks():
        np.add.at(holders, part.flatten().to_numpy(), 1)
    frequent = np.flatnonzero(holders >= max(LEAST_DOCUMENTS, LEAST_SHARE * len(order)))
    place = np.full(1 << WIDTH_BITS, -1, dtype=np.int32)
    place[frequent] = np.arange(len(frequent), dtype=np.int32)
    rows = frequent_columns(sample, order, place, len(frequent), int(holders[frequent].sum()))
    sample = sample.select(["doc_id", "junk", "toxic"]).take(pa.array(order))
    pa.default_memory_pool().release_unused()  # only the kept columns stay in the driver's memory
    folds = mixed(sample["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(FOLDS)
    toxic, junk = sample["toxic"].to_numpy().astype(float), sample["junk"].to_numpy().astype(float)
    targets = np.column_stack([junk, toxic, severity(rows, toxic, folds)])
    models = fit_chain(rows, targets, folds)
    weight = np.zeros((len(models), 1 << WIDTH_BITS), dtype=np.float32)
    earlier = np.zeros((len(models), len(models)))
    for j, model in enumerate(models):
        weight[j, frequent] = model.weight
        earlier[j, : len(model.extra)] = model.extra
    return Chain(CATEGORIES, weight, earlier, np.array([m.bias for m in models]))


def score_documents(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, p_<category>...`` for every row, over whole texts; texts without a word get 0 in each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 12 MB whatever the data
    columns = [f"p_{name}" for name in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for low, piece in pieces(batch.column(2)):
                words = words_of(piece, NEUTRAL)
                one, two, three = word_features(words)
                n = np.diff(words.first)
                sums = np.zeros((len(piece), len(chain.names)))
                for j, weight in enumerate(chain.weight):
                    total = np.concatenate([[0.0], np.cumsum(weight[one].astype(float) + weight[two] + weight[three])])
                    sums[:, j] = SCALE * (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(n, 1)
                found = np.where(n[:, None] > 0, np.round(chain.probabilities(sums), 6), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(low, len(piece)) for i in range(2)],
                     *[pa.array(found[:, j]) for j in range(len(chain.names))]],
                    ["doc_id", "text_key", *columns],
                )

    rows = docs.select(
        column(doc_id).cast("long").alias("doc_id"), text_key(column(text)).alias("text_key"), F.lower(column(text)).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, text_key long, " + ", ".join(f"{c} double" for c in columns))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             sample_rows: tuple[int, int] = SAMPLE_ROWS) -> DataFrame:
    """Probabilities of every category for every row, and ``rejected`` where ``p_toxic`` reaches ``THRESHOLD``.

    One row per input row, repeated rows included. Null texts and texts without a word get probability 0. Without labelled rows,
    or with labels of one class, every document gets that class (0 without any). Null ids and labels are not trained on.
    Only the named columns are read, so other columns may have any name.
    """
    chain = train_chain(docs, labels, doc_id, text, sample_rows)
    return score_documents(docs, chain, doc_id, text).withColumn("rejected", F.col("p_toxic") >= THRESHOLD)


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rejected rows; all columns are kept, whatever their names. See :func:`toxicity` for nulls and repeats."""
    rejected = toxicity(docs, labels, doc_id, text, **options).where("rejected")
    return matched_rows(docs, rejected, doc_id, text, "left_anti")


def op4_toxicity(spark, sf_dir):
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_key")
