"""Exact dedup against a dictionary of texts: collisions, full tables, salts and odd rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom.llm import exact_dedup


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for at, i in enumerate(sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True)):
            out[i, keep, len(ids), at == 0, digest] += 1
    return out


def found(frame):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect())


ODD = [
    (1, "same"), (9, "same"), (4, "same"), (4, "same"), (2, ""), (3, None), (None, None), (None, "only nulls"), (None, "only nulls"),
    (5, "Same"), (6, "same "), (7, "é"), (8, "é"), (10, "long " * 60_000), (11, "long " * 60_000), (12, "long " * 59_999),
    (-3, "negative"), (-2, "negative"), (13, "one"), (14, "\x00"), (15, "\x00\x00"),
]


@pytest.mark.parametrize("options", [
    {}, {"hash_bits": 2}, {"table_bytes": 1500, "hash_bits": 1}, {"copies": 2}, {"copies": 2, "hash_bits": 0, "table_bytes": 1500},
])
def test_odd_rows(spark, documents, options):
    docs = documents(*ODD).repartition(7).withColumn("entry", F.lit("clash")).withColumn("h", F.lit(0)).withColumn("a.b", F.lit(1))
    assert found(exact_dedup.exact_groups(docs, **options)) == plain(ODD)


def test_large_group_over_many_tasks(spark, documents):
    rng = random.Random(2)
    rows = [(i, "hot text") for i in range(3000)] + [(5000 + i, f"text {rng.randrange(900)}") for i in range(3000)]
    docs = documents(*rows).repartition(40).cache()
    out = exact_dedup.exact_groups(docs, copies=8, table_bytes=20_000)
    assert found(out) == plain(rows)


def test_dropped_rows_and_other_columns(spark, documents):
    docs = documents(*ODD).withColumn("_digest", F.lit("clash")).withColumn("_KEEP", F.lit(0)).withColumn("a.b", F.lit(1))
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    kept = Counter((i, t) for (i, k, _, kept, t), n in plain(ODD).items() if kept for _ in range(n))
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in ODD}
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == Counter((i, texts[t]) for i, t in kept)
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    lower = exact_dedup.exact_groups(docs, normalise=F.lower)
    assert lower.where("doc_id = 5").first()["group_size"] == 5


def test_table_compares_content():
    held = exact_dedup.ContentTable(10_000)
    names = [f"content {i}".encode() for i in range(40)]
    assert [held.owner(7, c, i) for i, c in enumerate(names)] == list(range(40))
    assert [held.owner(7, c, 99) for c in names] == list(range(40))
    assert held.owner(7, b"x" * 20_000, 99) is None
    big = exact_dedup.ContentTable(10)
    assert big.owner(-5, b"x" * 100, 1) == 1 and big.owner(-5, b"y", 2) is None and big.owner(-5, b"x" * 100, 3) == 1
    many = exact_dedup.ContentTable()
    assert all(many.owner(i * 1024, b"%d" % i, i) == i for i in range(3000)) and len(many.slots) >= 6000
