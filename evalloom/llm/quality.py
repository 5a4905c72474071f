"""Quality by compression: one zstandard dictionary of good text, one of bad; the normalised difference of a text's compressed
sizes becomes a probability.

Texts are compressed in chunks of a fixed size, so a long text does not outgrow the dictionary; the sizes of all its chunks are summed.
Dictionaries come from one half of a bounded sample of labelled documents, the calibration from the other half.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import column, held_out, table, uniform
from evalloom.llm.linear import sigmoid

CHUNK = 2048  # bytes compressed at once
FEATURES = 4
SAMPLE_DOCUMENTS = 4000  # labelled documents at most, of each label
SAMPLE_CHUNKS = 4000  # of a label that a dictionary is built from
DICTIONARY = 64 << 10
LEVEL = 3
THRESHOLD = 0.7
SEED = 7


def chunks_of(text: str | None) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the plain text of the samples when there are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Model(NamedTuple):
    good: bytes
    bad: bytes
    center: np.ndarray  # of the features
    spread: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of :func:`features`; a feature that is not a number counts as average."""
        scaled = np.where(np.isnan(x), 0.0, (x - self.center) / self.spread)
        return sigmoid(scaled @ self.weight + self.bias)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL)
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_dict_id=False)


def features(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """Per text the size difference (bad - good) normalised by the bytes, and what calibrates it: the compressed share of the
    bytes, its square and the logarithm of the bytes. Empty texts have a difference of 0 and no share.
    """
    one, two = compressor(good), compressor(bad)
    out = np.full((len(texts), FEATURES), np.nan)
    for i, text in enumerate(texts):
        parts = chunks_of(text)
        if not parts:
            out[i, 0] = 0.0
            continue
        size = sum(map(len, parts))
        a, b = sum(len(one.compress(p)) for p in parts), sum(len(two.compress(p)) for p in parts)
        share = min(a, b) / size
        out[i] = (b - a) / size, share, share * share, np.log(size)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Center, spread, weights and bias of a logistic curve by Newton's method with a light prior; constant for one class."""
    positives = float(y.sum())
    if not 0 < positives < len(y):
        bias = 0.0 if not len(y) else float(np.log((positives + 1) / (len(y) - positives + 1)))
        return np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), bias
    real = ~np.isnan(x)
    number = np.maximum(real.sum(axis=0), 1)
    filled = np.where(real, x, 0.0)
    center = filled.sum(axis=0) / number
    spread = np.sqrt((np.where(real, x - center, 0.0) ** 2).sum(axis=0) / number)
    spread = np.where(spread > 0, spread, 1.0)
    matrix = np.column_stack([np.where(real, (filled - center) / spread, 0.0), np.ones(len(x))])
    prior = np.diag([0.1] * FEATURES + [1e-6])
    theta = np.append(np.zeros(FEATURES), np.log(positives / (len(y) - positives)))
    for _ in range(steps):
        p = sigmoid(matrix @ theta)
        slope = matrix.T @ (p - y) + prior @ theta
        curve = (matrix * (p * (1 - p))[:, None]).T @ matrix + prior
        step = np.linalg.solve(curve, slope)
        theta = theta - step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
    return center, spread, theta[:-1], float(theta[-1])


def train_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  sample_documents: int = SAMPLE_DOCUMENTS, sample_chunks: int = SAMPLE_CHUNKS) -> Model:
    """Fit on at most ``sample_documents`` documents of each label that are not held out.

    The dictionaries see at most ``sample_chunks`` chunks of a label, the calibration a few numbers per document.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality")).where(
        F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("_id")
    )
    draw = uniform("_id", SEED)
    parts = [marked.where(F.col("quality") == v).orderBy(draw, "_id").limit(sample_documents) for v in (0, 1)]
    both = parts[0].unionByName(parts[1]).groupBy("_id").agg(F.min("quality").alias("quality"))  # of several labels the smaller
    drawn = both.withColumn("fits", uniform("_id", SEED + 1) < 0.5)
    bodies = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    chosen = bodies.join(F.broadcast(drawn), bodies["doc_id"] == drawn["_id"]).where("text is not null")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, label, body in zip(*batch.columns):
                parts = chunks_of(body.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(parts), pa.int64()), pa.array([label.as_py()] * len(parts), pa.int32()),
                     pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "quality", "part", "chunk"],
                )

    split = chosen.where("not fits").select("doc_id", "quality", "text").mapInArrow(
        pieces, "doc_id long, quality int, part long, chunk binary"
    )
    order = uniform(F.concat_ws("|", "doc_id", "part"), SEED + 2)
    dictionaries = []
    for v in (1, 0):
        rows = split.where(F.col("quality") == v).orderBy(order, "doc_id", "part", "chunk").limit(sample_chunks).collect()
        dictionaries.append(dictionary([bytes(r["chunk"]) for r in rows]))
    good, bad = dictionaries

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2).to_pylist(), good, bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"]
            )

    rows = chosen.where("fits").select("doc_id", "quality", "text").mapInArrow(measure, "doc_id long, quality int, x array<double>")
    found = sorted(map(tuple, rows.collect()), key=repr)  # a few numbers per sampled document
    y = np.array([r[1] for r in found], dtype=float)
    x = np.array([r[2] for r in found], dtype=float).reshape(len(found), FEATURES)
    return Model(good, bad, *calibrate(x, y))


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row over whole texts, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.round(model.score(features(batch.column(1).to_pylist(), model.good, model.bad)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; ``predicted`` is 1 from ``THRESHOLD`` on.

    One row per input row, repeated rows included. Null and empty texts have a size difference of 0 and get the score
    of that at average other features. Without usable labels every score is 0.5, with labels of one class the smoothed share of that class. Null ids are
    scored, not learned from. Only the named columns are read, so other columns may have any name.
    """
    scored = score_quality(docs, train_quality(docs, labels, doc_id, text, **options), doc_id, text)
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op7_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
