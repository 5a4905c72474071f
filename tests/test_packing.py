"""Fit-or-cut over a whole corpus against one sequential walk, for any number of ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import tokens as tk
from evalloom.operators import packing as pk
from evalloom.operators import prefix_packing as pp
from evalloom.sources import writers as wr


def plain(rows, block_size, threshold):
    out, block, used = [], 0, 0
    for doc, n in sorted((d, n) for d, n in rows if n):
        room = block_size - used
        if used and n > room and min(room, n - room) < threshold:
            block, used = block + 1, 0
        done = 0
        while done < n:
            part = min(block_size - used, n - done)
            out.append((doc, block, used, done, part))
            done, used = done + part, used + part
            if used == block_size:
                block, used = block + 1, 0
    return out


@pytest.mark.parametrize("ranges", [1, 7, 64])
@pytest.mark.parametrize("threshold", [0, 9, 40])
def test_any_partitioning(spark, ranges, threshold):
    rng = random.Random(ranges)
    rows = [(rng.randrange(-(10**12), 10**12), rng.choice((0, 1, 5, 31, 32, 33, 64, rng.randrange(1, 300)))) for _ in range(3000)]
    rows += [(7, 12), (7, 3), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, n long")
    placed = pp.fit_or_cut_all(docs, F.col("n"), 32, threshold, ranges=ranges)
    assert sorted(map(tuple, placed.collect()), key=lambda r: (r[1], r[2])) == plain(rows, 32, threshold)
    assert pp.fit_or_cut_all(docs.limit(0), F.col("n"), 32, threshold).count() == 0


def test_summaries_compose():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 200, 400)
    whole, parts = pp.Transition(64), []
    whole.feed(lengths, 64, 10)
    for piece in np.array_split(lengths, 9):
        parts.append(pp.Transition(64))
        parts[-1].feed(piece, 64, 10)
    used, blocks = np.arange(64), np.zeros(64, dtype=np.int64)
    for part in parts:
        after, closed = part.table()
        used, blocks = after[used], blocks + closed[used]
    assert all(np.array_equal(a, b) for a, b in zip((used, blocks), whole.table()))
    assert len(np.unique(used)) < 64  # starts meet, so a summary shrinks


def test_blocks_hold_every_token(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.sequence(F.lit(1), (F.col("id") % 90 + 1).cast("int")).alias("t"))
    placed = pp.fit_or_cut_all(docs, F.size("t"), 32, 8, ranges=5)
    blocks = pp.whole_blocks(docs, placed, "t", 32, -1)
    row = blocks.select(F.min(F.size("tokens")), F.max(F.size("tokens")), F.sum(F.size(F.filter("tokens", lambda x: x > 0)))).first()
    assert tuple(row) == (32, 32, docs.agg(F.sum(F.size("t"))).first()[0])


def test_shards_are_packed_where_they_are_written(spark, tmp_path):
    """The blocks of the plain way; texts, not tokens, meet their offsets, and pieces are dealt once."""
    rows = [(i, "x" * ((i * 37) % 90)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", tk.wrapped_length("text"))
    made = tk.wrap(tk.byte_tokens("text"))
    plain = pk.assign_shards(pk.pack_flat(docs.withColumn("tokens", made), "tokens", F.col("n"), 32), 5, 4)
    shards = pk.pack_shards(docs, made, F.col("n"), 32, 5, 4)
    names = ["split", "shard", "block_id", "tokens"]
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(shards.select(names).collect()) == key(plain.select(names).collect())
    back = spark.read.parquet(wr.write_token_shards(shards, str(tmp_path / "shards"), dealt=True))
    assert key(back.select(names).collect()) == key(plain.select(names).collect())
    plan = shards._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition ") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Join")
