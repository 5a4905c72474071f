import math

import numpy as np
import pytest

from evalloom.llm import topk


def plain(rows, k=5):
    clean = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = set()
    for q, a in clean:
        if q is None or q % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in clean if i != q]
        out |= {(q, r + 1, None if n else i, -s) for r, (s, n, i) in enumerate(sorted(scored)[:k])}
    return sorted(out, key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, norm string")
    out = topk.top_products(table, table.where("vec_id % 50 = 0"), **options)
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("bucket, block", [(16, 4), (7, 3), (2048, 1024)])
def test_against_all_products(spark, bucket, block):
    rng = np.random.default_rng(3)
    size = rng.lognormal(0, 1.0, 400)[:, None]
    spikes = rng.normal(size=(400, 8)) ** 3 * size
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(spikes)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # a large group of ties
    assert found(spark, rows, bucket=bucket, query_block=block) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, [-1.0, -1.0]), (150, None), (200, [None, 1.0]), (250, [float("nan"), 1.0]),
        (300, [float("inf"), 1.0]), (350, []), (1, [1.0, 2.0, 3.0]), (2, [0.5]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [1.0, 2.0]),
        (400, [1.0, 1.0]), (400, [1.0, 1.0]), (5, [-0.001, 0.001]), (6, [1e30, 0.0]), (450, [0.25] * 300),
    ]
    mine = found(spark, rows, bucket=3, query_block=2)
    exact = [r for r in plain(rows)]
    clamp = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in exact]
    assert mine == sorted(clamp, key=repr)
    assert found(spark, rows[:1]) == []
    assert found(spark, rows[3:4]) == []


def test_candidates_never_lose_a_reachable_row():
    rng = np.random.default_rng(9)
    matrix = np.floor(rng.normal(size=(500, 12)) * 100)
    norms = np.linalg.norm(matrix, axis=1)
    order = np.argsort(-norms)
    matrix, norms = matrix[order], norms[order]
    bucket = topk.Bucket(np.arange(500).tobytes(), np.ones(500, bool).tobytes(), norms.tobytes(), 12, matrix.tobytes())
    for _ in range(60):
        query = np.floor(rng.normal(size=12) * 100) * (rng.random(12) < 0.3)
        norm = float(np.linalg.norm(query))
        scores = matrix @ query
        for bound in np.sort(scores)[[-1, -5, -50, 250]]:
            rows = bucket.candidates(query, norm, float(bound))
            kept = set(range(500)) if rows is None else set(rows.tolist())
            assert set(np.flatnonzero(scores >= bound).tolist()) <= kept
