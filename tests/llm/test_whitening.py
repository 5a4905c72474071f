"""Whitening against numpy's own eigenvectors and Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import catalog, qdwh, whitening

FOLDER = "/root/testdata/sf0.01"


def plain(rows):
    """(vec_id, component) to (n, deviation, |whitened|, explained), from a list of (vec_id, vector)."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    size = max(set(lengths), key=lambda d: (lengths.count(d), d))
    good = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in good if len(v) == size]
    n = len(good)
    sums = [sum(v[k] for _, v in good) for k in range(size)]
    centred = np.array([[v[k] - sums[k] / n for k in range(size)] for _, v in good])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    out = []
    for (i, v), c in zip(good, centred):
        deviation = sum((n * x - s) ** 2 for x, s in zip(v, sums))
        deviation = deviation if deviation < 1 << 63 else None
        for k in range(min(8, size)):
            e = values[-1 - k]
            out.append((i, k + 1, n, deviation, abs(c @ vectors[:, -1 - k]) / math.sqrt(e), e / np.trace(covariance)))
    return out


def agree(frame, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3] or 0)
    mine = sorted((tuple(r) for r in frame.collect()), key=key)
    theirs = sorted(plain(rows), key=key)
    assert [r[:4] for r in mine] == [r[:4] for r in theirs]
    assert np.allclose([abs(r[4]) for r in mine], [r[4] for r in theirs], rtol=1e-8, atol=1e-8)
    assert np.allclose([r[5] for r in mine], [r[5] for r in theirs], rtol=1e-9)
    assert len({r[6] for r in mine}) == 1 and mine[0][6] < 1e-6


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    agree(catalog.QUERIES["op12_whitening"](spark, FOLDER), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, [1, 2, 3, 4, 5]).tolist()) for i in range(60)]
    rows += [
        (60, None), (61, []), (62, [1.0, None, 2.0, 3.0, 4.0]), (63, [float("nan")] * 5), (64, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
        (65, [1.0, 2.0]), (1, rows[1][1]), (None, rows[2][1]), (None, None), (66, [5.0, -20.0, 30.0, 0.5, 0.25]),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("_both", F.lit(1))
    docs = docs.withColumn("a.b", F.lit(2)).withColumn("v", F.lit(None).cast("string"))
    agree(whitening.whitened_components(docs), rows)
    for tasks in (1, 13):
        again = whitening.whitened_components(docs.repartition(tasks))
        assert np.allclose(
            sorted(abs(r.whitened) for r in again.collect()), sorted(r[4] for r in plain(rows)), rtol=1e-8, atol=1e-8
        )
    out, white, _ = whitening.whiten(docs, whitening.fit(docs))
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 63 and white not in docs.columns
    assert whitening.whitened_components(docs.limit(0)).count() == 0
    assert whitening.whitened_components(docs.where("vec_id in (60, 61, 63)")).count() == 0


def test_without_variance(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    rows = whitening.whitened_components(same).collect()
    assert len(rows) == 4 and all(r.whitened == r.explained == r.identity_error == 0 and r.deviation == 0 for r in rows)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whitened_components(line).collect()
    assert abs(sum(r.whitened**2 for r in rows if r.component == 1) / 5 - 1) < 1e-9
    assert all(r.whitened == 0 for r in rows if r.component > 1) and rows[0].identity_error < 1e-8


def test_large_entries_are_exact(spark):
    rows = [(i, [(-1) ** i * (2.0**29 - i), -(2.0**28) + 3 * i * i, float(i)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitened_components(frame).collect()} == {None}  # beyond 64 bits
    model = whitening.fit(frame, components=3)
    ints = [[int(math.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    assert model.sums == [sum(v[k] for v in ints) for k in range(3)]
    exact = sum((12 * v[k] - model.sums[k]) ** 2 for v in ints for k in range(3)) / 12**3
    assert abs(model.trace - exact) <= 1e-15 * exact


@pytest.mark.parametrize("size", [1, 2, 3, 8, 33, 64])
def test_eigenvectors(size):
    rng = np.random.default_rng(size)
    turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
    for spectrum in (rng.random(size) * 100, 2.0 ** -np.arange(size), np.ones(size), np.repeat([5.0, 1.0], [size // 2, size - size // 2])):
        a = (turn * spectrum) @ turn.T
        values, vectors = qdwh.eigen(a)
        assert np.allclose(values, np.sort(spectrum)[::-1], atol=1e-13 * spectrum.max())
        assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-12)
        assert np.linalg.norm(a @ vectors - vectors * values) < 1e-12 * np.linalg.norm(a)
        some, first = qdwh.eigen(a, 2)
        assert np.allclose(some, values[:2]) and first.shape == (size, min(2, size))


def test_diagonal_and_polar():
    values, vectors = qdwh.eigen(np.diag([3.0, 3.0, 7.0, 0.0]))
    assert np.allclose(values, [7, 3, 3, 0]) and np.allclose(np.abs(vectors).sum(axis=0)[[0, 3]], 1)
    assert np.allclose(qdwh.eigen(np.zeros((3, 3)))[0], 0)
    a = np.random.default_rng(0).standard_normal((20, 20))
    u, _, v = np.linalg.svd(a)
    assert np.allclose(qdwh.polar(a), u @ v, atol=1e-12)
