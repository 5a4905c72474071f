"""Exact top-k inner products by norm buckets.

Vectors are sorted by length and packed into buckets. A query first meets the bucket of the longest vectors, which gives it a lower
bound for its k-th score. Against every other bucket that bound becomes a local threshold on the cosine: above 1 the whole bucket is
skipped; otherwise either the bucket's length order or one of its sorted coordinates cuts the candidates, whichever leaves fewer, and
the products of what is left are computed. Components are integers, so scores are exact and ties are decided by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.llm.common import table
from evalloom.session import cut_lineage

BUCKET = 2048
QUERY_BLOCK = 1024
FOCUS = 3  # coordinates tried: the query's largest
SLACK = 1e-9  # relative, over every floating-point bound
EXACT = float(2**53)
VECTOR = "vec_id long, norm double, packed binary"
BLOCK = "ids binary, valid binary, norms binary, width int, packed binary, longest double"


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """``vec_id, norm, packed``: floor(scale * x) of each component; null and non-finite vectors are left out."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
            cut = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            parts = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(np.sqrt(p @ p)) for p in parts], pa.float64()),
                 pa.array([p.tobytes() for p in parts], pa.binary())],
                ["vec_id", "norm", "packed"],
            )

    return rows.mapInArrow(run, VECTOR)


def packed_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of each partition, in their order, as blocks of at most ``size`` vectors; shorter vectors are filled with zeros."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        parts = [np.frombuffer(p) for _, _, p in rows]
        width = max(len(p) for p in parts)
        matrix = np.zeros((len(parts), width))
        for i, p in enumerate(parts):
            matrix[i, : len(p)] = p
        ids = np.array([0 if r[0] is None else r[0] for r in rows], dtype=np.int64)
        valid = np.array([r[0] is not None for r in rows])
        norms = np.array([r[1] for r in rows])
        values = [ids.tobytes(), valid.tobytes(), norms.tobytes(), width, matrix.tobytes(), float(norms.max())]
        types = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                          ["ids", "valid", "norms", "width", "packed", "longest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:]
        if held:
            yield block(held)

    return vectors.select("vec_id", "norm", "packed").mapInArrow(run, BLOCK)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64, clamped to its range."""
    bound = np.abs(rows).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(1, len(query))
    if bound < EXACT:
        return (rows @ query).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in whole], dtype=np.int64)


def best(ids: np.ndarray, valid: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, null ids last."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort([ids[at], ~valid[at], -scores[at].astype(object) if scores[at].min(initial=0) == -(2**63) else -scores[at]])][:k]


class Bucket:
    """An unpacked block with its sorted coordinates."""

    def __init__(self, ids: bytes, valid: bytes, norms: bytes, width: int, packed: bytes):
        self.ids, self.valid = np.frombuffer(ids, np.int64), np.frombuffer(valid, bool)
        self.norms = np.frombuffer(norms)
        self.rows = np.frombuffer(packed).reshape(len(self.ids), width)
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None

    def coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        """Per coordinate of the directions: row order and sorted values."""
        if self._sorted is None:
            unit = self.rows / np.where(self.norms > 0, self.norms, 1.0)[:, None]
            order = np.argsort(unit, axis=0)
            self._sorted = order, np.take_along_axis(unit, order, axis=0)
        return self._sorted

    def candidates(self, query: np.ndarray, norm: float, bound: float) -> np.ndarray | None:
        """Rows whose product with the query can reach ``bound``; None for all of them. Rows are in falling length."""
        if bound <= 0 or norm <= 0:
            return None
        longest = self.norms[0]
        cosine = bound / (norm * longest) * (1 - SLACK) if longest > 0 else 2.0
        if cosine > 1:
            return np.empty(0, np.int64)
        long_enough = int(np.searchsorted(-self.norms, -bound / norm * (1 - SLACK), side="right"))
        order, values = self.coordinates()
        direction = query / norm
        fewest, chosen = long_enough, None
        for f in np.argsort(-np.abs(direction[: values.shape[1]]))[:FOCUS]:
            middle = direction[f] * cosine
            reach = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - direction[f] ** 2))) + SLACK
            # the feasible interval ends at 1 on the query's side once its own coordinate is within reach
            low = -1.0 - SLACK if direction[f] <= -cosine else middle - reach
            high = 1.0 + SLACK if direction[f] >= cosine else middle + reach
            a, b = np.searchsorted(values[:, f], low, side="left"), np.searchsorted(values[:, f], high, side="right")
            if b - a < fewest:
                fewest, chosen = b - a, (f, a, b)
        if chosen is None:
            return np.arange(long_enough)
        f, a, b = chosen
        rows = order[a:b, f]
        return rows[rows < long_enough]


def block_best(query_ids: np.ndarray, query_norms: np.ndarray, queries: np.ndarray, bounds: np.ndarray, bucket: Bucket,
               k: int) -> Iterator[tuple]:
    """Per query the best of one bucket that reach the query's bound: ``query number, positions, scores``."""
    shared = min(queries.shape[1], bucket.rows.shape[1])
    for i in range(len(query_ids)):
        rows = bucket.candidates(queries[i], query_norms[i], bounds[i])
        rows = np.arange(len(bucket.ids)) if rows is None else rows
        rows = rows[~((bucket.ids[rows] == query_ids[i]) & bucket.valid[rows])]
        if not len(rows):
            continue
        taken = bucket.rows[:, :shared] if len(rows) == len(bucket.ids) else bucket.rows[rows, :shared]
        scores = products(taken, queries[i, :shared])
        kept = scores >= bounds[i]
        rows, scores = rows[kept], scores[kept]
        at = best(bucket.ids[rows], bucket.valid[rows], scores, k)
        yield i, rows[at], scores[at]


def compared(pairs: DataFrame, k: int) -> DataFrame:
    """Run :func:`block_best` on joined blocks: query block columns, ``bounds``, bucket columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(j)[r].as_py() for j, name in enumerate(batch.schema.names)}
                bucket = Bucket(row["ids"], row["valid"], row["norms"], row["width"], row["packed"])
                ids, norms = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_norms"])
                queries = np.frombuffer(row["q_packed"]).reshape(len(ids), row["q_width"])
                bounds = np.frombuffer(row["bounds"]) if row["bounds"] else np.full(len(ids), -np.inf)
                out: list[list] = [[], [], [], []]
                for i, at, scores in block_best(ids, norms, queries, bounds, bucket, k):
                    out[0] += [row["q_block"]] * len(at)
                    out[1] += [i] * len(at)
                    out[2] += [int(x) if v else None for x, v in zip(bucket.ids[at], bucket.valid[at])]
                    out[3] += scores.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in out], ["q_block", "q_row", "vec_id", "score"]
                )

    return pairs.select(
        "q_block", "q_ids", "q_norms", "q_width", "q_packed", "bounds", "ids", "valid", "norms", "width", "packed"
    ).mapInArrow(run, "q_block long, q_row long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q_block", "q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
                 scale: float = 256.0, bucket: int = BUCKET, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest inner products of each query with all vectors but those of its own id: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id`` and ``vector``. Vectors that are null or hold null or non-finite components take no part; shorter
    vectors count as filled with zeros; an empty table gives no row. Repeated candidate rows all count, repeated query rows
    once. A query has a non-null id; a candidate with a null id comes last among ties. Scores beyond 64 bits are clamped.
    """
    all_vectors = cut_lineage(quantised(vectors, vec_id, vector, scale))
    asked = cut_lineage(quantised(queries, vec_id, vector, scale).where("vec_id is not null").distinct())
    n, n_asked = all_vectors.count(), asked.count()
    parts = max(1, -(-n // (4 * bucket)))
    by_length = all_vectors.repartitionByRange(parts, F.col("norm").desc(), "vec_id").sortWithinPartitions(
        F.col("norm").desc(), "vec_id"
    )
    buckets = cut_lineage(packed_blocks(by_length, bucket).withColumn("bucket", F.monotonically_increasing_id()))
    blocks = packed_blocks(asked.repartition(max(1, -(-n_asked // query_block)), "vec_id"), query_block)
    blocks = cut_lineage(
        blocks.select(
            F.monotonically_increasing_id().alias("q_block"),
            *[F.col(c).alias(f"q_{c}") for c in ("ids", "norms", "width", "packed")],
        )
    )
    # the bucket of the longest vectors gives every query its first bound
    first = buckets.orderBy(F.col("longest").desc(), "bucket").limit(1)
    opening = blocks.withColumn("bounds", F.lit(None).cast("binary")).withColumn("_one", F.lit(1)).join(
        F.broadcast(first.withColumn("_one", F.lit(1))), "_one"  # one packed block
    )
    opened = cut_lineage(ranked(compared(opening, k), k).drop("rank"))

    def bound_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, norms, lists in zip(*batch.columns):
                norms = np.frombuffer(norms.as_py())
                bounds = np.full(len(norms), -np.inf)
                for item in lists.as_py() or []:
                    bounds[item["q_row"]] = item["edge"]
                shortest = np.where((bounds > 0) & (norms > 0), bounds / np.where(norms > 0, norms, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()], pa.int64()), pa.array([bounds.tobytes()], pa.binary()),
                     pa.array([float(shortest.min(initial=np.inf))], pa.float64())],
                    ["q_block", "bounds", "shortest"],
                )

    edges = (
        opened.groupBy("q_block", "q_row")
        .agg(F.min("score").alias("edge"), F.count("*").alias("_n"))
        .where(F.col("_n") >= k)
        .groupBy("q_block")
        .agg(F.collect_list(F.struct("q_row", "edge")).alias("edges"))  # at most one per query of the block
    )
    bounded = cut_lineage(
        blocks.select("q_block", "q_ids", "q_norms").join(edges, "q_block", "left").mapInArrow(
            bound_blocks, "q_block long, bounds binary, shortest double"
        )
    )
    # pairs of blocks that can matter, as numbers; then their vectors
    lengths = buckets.select("bucket", "longest", F.row_number().over(W.orderBy(F.col("longest").desc(), "bucket")).alias("place"))
    lengths = cut_lineage(lengths.where("place > 1"))
    n_buckets = lengths.count()
    pairs = (
        bounded.withColumn("place", F.explode(F.sequence(F.lit(2), F.lit(n_buckets + 1))))
        .join(lengths, "place")
        .where(F.col("longest") >= F.col("shortest") * (1 - SLACK))
        .select("q_block", "bounds", "bucket")
        if n_buckets
        else bounded.where("false").select("q_block", "bounds", F.lit(0).cast("long").alias("bucket"))
    )
    joined = pairs.join(blocks, "q_block").join(buckets, "bucket").repartition(F.xxhash64("q_block", "bucket"))
    found = ranked(opened.unionByName(compared(joined, k)), k)
    names = blocks.select("q_block", "q_ids")

    def query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(*batch.columns):
                ids = np.frombuffer(ids.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), pa.array(ids)],
                    ["q_block", "q_row", "query_id"],
                )

    named = names.mapInArrow(query_ids, "q_block long, q_row long, query_id long")
    return found.join(named, ["q_block", "q_row"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_top_products(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where("vec_id % 50 = 0"))
