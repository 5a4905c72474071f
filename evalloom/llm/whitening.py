"""Embedding whitening: exact integer covariance in tasks, spectral divide and conquer on the driver, broadcast projection.

Components are made integers, so the sums over all vectors are exact and the same for any partitioning: tasks add up shifted vectors and
their products, and the sums meet ``FAN`` tasks at a time. What reaches the driver is one matrix of the vectors' dimension. The
projection on the leading components goes to every task; its size depends on the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.common import column, fresh, table
from evalloom.llm.qdwh import EPS, eigen

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST = float(1 << 30)  # of a component; beyond it the integers leave their range, and the vector counts as not finite
LIMB = 20  # bits of half an integer, so that products of CHUNK rows are exact in doubles
CHUNK = 1 << 12
FLUSH = 1 << 21  # rows added up in 64 bits
FAN = 32
FINE = float(1 << 30)  # steps of one in which the check of the whitened covariance is added up
LONG_MAX = (1 << 63) - 1


class Whitening(NamedTuple):
    """``n`` vectors with integer sums ``sums``; leading eigenvalues, their vectors as columns, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def shift(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and the rest of it."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [(s - self.n * w) / self.n for s, w in zip(self.sums, whole)]
        return np.array(whole, np.int64), np.array(rest)

    def varies(self) -> np.ndarray:
        """Components of some variance; the others are whitened to 0."""
        return self.values > len(self.sums) * EPS * self.trace

    def projection(self) -> np.ndarray:
        safe = np.where(self.varies(), self.values, 1.0)
        return np.where(self.varies(), self.vectors / np.sqrt(safe), 0.0)

    def explained(self) -> list[float]:
        return (np.maximum(self.values, 0) / self.trace if self.trace > 0 else np.zeros(len(self.values))).tolist()


def integers(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of ``floor(SCALE * c) + OFFSET``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.floor(SCALE * flat).astype(np.int64) + OFFSET


def usable(embeddings: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has components, all of them numbers of at most ``LARGEST``."""
    body = column(vector).cast("array<double>")
    return embeddings.where(
        F.coalesce(F.size(body) > 0, F.lit(False)) & F.forall(body, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    )


def packed_row(kind: int, total: np.ndarray, high: np.ndarray | None = None) -> pa.RecordBatch:
    """Integers as two limbs of 32 bits and more, so that sums of any number of rows stay exact."""
    high = (total >> 32) + (0 if high is None else high)
    both = np.stack([total & 0xFFFFFFFF, high]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([both.tobytes()], pa.binary())], ["kind", "packed"])


def exact_totals(rows: DataFrame, partial) -> dict[int, list[int]]:
    """Sums by kind of the integer vectors that ``partial`` gives for the Arrow batches of a task, as Python integers."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(packed, np.int64).reshape(2, -1)
                held[kind] = part + held[kind] if kind in held else part
        for kind, (low, high) in held.items():
            yield packed_row(kind, low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, total in partial(batches):
            yield packed_row(kind, total)

    shape = "kind int, packed binary"
    parts = rows.mapInArrow(run, shape).withColumn("slot", F.floor(F.spark_partition_id() / FAN))
    once = parts.repartition("slot").select("kind", "packed").mapInArrow(merge, shape)
    out = {}
    for row in once.repartition("kind").mapInArrow(merge, shape).toLocalIterator():
        low, high = np.frombuffer(row["packed"], np.int64).reshape(2, -1).tolist()
        out[row["kind"]] = [(h << 32) + v for v, h in zip(low, high)]
    return out


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean, covariance and leading components of the usable vectors; None if there is none.

    Vectors of another length than the most frequent one (of equally frequent ones the longest) are not usable.
    """
    rows = usable(embeddings, vector).select(column(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    size, n = sizes["d"], sizes["n"]
    rows = rows.where(F.size("v") == size)

    def sums(batches):
        total, count = np.zeros(size, np.int64), 0
        for batch in batches:
            total += integers(batch.column(0), size).sum(axis=0)
            count += batch.num_rows
            if count >= FLUSH:
                yield 0, total
                total, count = np.zeros(size, np.int64), 0
        yield 0, total

    model = Whitening(n, exact_totals(rows, sums)[0], np.empty(0), np.empty((size, 0)), 0.0)
    whole, _ = model.shift()

    def products(batches):
        """Of centred vectors: sums and products of low halves (kind 0), of mixed halves (1) and of high halves (2)."""
        held, count = {}, 0

        def add(kind: int, values: np.ndarray) -> None:
            held[kind] = held.get(kind, 0) + values

        for batch in batches:
            centred = integers(batch.column(0), size) - whole
            for begin in range(0, len(centred), CHUNK):
                part = centred[begin : begin + CHUNK]
                high = (part + (1 << (LIMB - 1))) >> LIMB
                low = (part - (high << LIMB)).astype(float)
                add(0, np.concatenate([part.sum(axis=0), (low.T @ low).astype(np.int64).ravel()]))
                if high.any():
                    high = high.astype(float)
                    mixed = (low.T @ high).astype(np.int64)
                    add(1, (mixed + mixed.T).ravel())
                    add(2, (high.T @ high).astype(np.int64).ravel())
            count += len(centred)
            if count >= FLUSH:
                yield from held.items()
                held, count = {}, 0
        yield from held.items()

    found = exact_totals(rows, products)
    rest, square = found[0][:size], found[0][size:]
    for kind in (1, 2):
        for i, value in enumerate(found.get(kind, ())):
            square[i] += value << (kind * LIMB)
    covariance = np.array([(n * square[i * size + j] - rest[i] * rest[j]) / (n * n) for i in range(size) for j in range(size)])
    covariance = covariance.reshape(size, size)
    values, vectors = eigen(covariance, components)
    return model._replace(values=values, vectors=vectors, trace=float(np.trace(covariance)))


def whitened(vectors: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Projections of integer vectors, and their exact squared deviations as Python or 64-bit integers."""
    whole, rest = model.shift()
    centred = vectors - whole
    off = np.array([s - model.n * int(w) for s, w in zip(model.sums, whole)], dtype=object)
    bound = model.n * int(np.abs(centred).max(initial=0)) + max(abs(v) for v in off)
    exact = model.n * centred.astype(object if len(off) * bound * bound > LONG_MAX else np.int64) - (
        off if len(off) * bound * bound > LONG_MAX else off.astype(np.int64)
    )
    return (centred - rest) @ model.projection(), (exact * exact).sum(axis=1)


def whiten(embeddings: DataFrame, model: Whitening, vector: str = "embedding") -> tuple[DataFrame, str, str]:
    """The usable rows of ``embeddings`` with two more columns, whose names are returned: the whitened vector and the deviation.

    The deviation, the sum over all dimensions of ``(n * x - sums) ** 2``, is null beyond 64 bits.
    """
    size = len(model.sums)
    shape = T.StructType([T.StructField("white", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])

    @F.arrow_udf(shape)
    def project(vectors: pa.Array) -> pa.Array:
        white, deviation = whitened(integers(vectors, size), model)
        offsets = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(white.ravel())),
             pa.array([int(x) if x <= LONG_MAX else None for x in deviation.tolist()], pa.int64())],
            ["white", "deviation"],
        )

    both, white, deviation = fresh(embeddings.columns, "both", "whitened", "deviation")
    body = column(vector).cast("array<double>")
    rows = usable(embeddings, vector).where(F.size(body) == size).withColumn(both, project(body))
    kept: list[Column] = [column(c) for c in embeddings.columns]
    return rows.select(*kept, F.col(both)["white"].alias(white), F.col(both)["deviation"].alias(deviation)), white, deviation


def identity_error(embeddings: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity, over the components that vary.

    Tasks give sums in steps of ``1 / FINE``, so the value does not depend on their order.
    """
    size, several = len(model.sums), int(model.varies().sum())
    body = column(vector).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white = whitened(integers(batch.column(0), size), model)[0][:, :several]
            values = np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(values)), pa.int32()), pa.array(np.rint(values * FINE).astype(np.int64))], ["place", "value"]
            )

    rows = usable(embeddings, vector).where(F.size(body) == size).select(body.alias("v"))
    added = rows.mapInArrow(run, "place int, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    flat = np.zeros(several + several * several)
    for row in added.collect():
        flat[row["place"]] = float(row["s"]) / FINE / model.n
    mean, second = flat[:several], flat[several:].reshape(several, several)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(several)).max(initial=0.0))


RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whitened_components(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``embeddings`` and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, empty, of another length than most, or that hold a null, a NaN, an infinity or an entry beyond ``LARGEST``
    are left out. Null ids stay null and repeated rows count one by one. Vectors of fewer dimensions than ``components`` have as many
    components as dimensions. A component without variance (one vector, equal vectors) is whitened to 0, and the identity is measured on the
    others. An empty table gives no row. Only the two columns are read, so other columns may have any name.
    """
    rows = embeddings.select(column(vec_id).cast("long").alias("vec_id"), column(vector).cast("array<double>").alias("v"))
    model = fit(rows, "v", components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    error = identity_error(rows, model, "v")
    out, white, deviation = whiten(rows, model, "v")
    share = F.array(*[F.lit(x) for x in model.explained()])
    return out.select("vec_id", F.col(deviation).alias("deviation"), F.posexplode(white).alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir):
    return whitened_components(table(spark, sf_dir, "embeddings"))
