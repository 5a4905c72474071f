import math

import pytest
from pyspark.sql import functions as F

from evalloom.llm import mixing
from evalloom.llm.common import join_lookup


def plain_targets(sizes):
    """Iterated resharing, as stated: what a capped source leaves goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, pot, open_sources = {s: 0.0 for s in names}, 1.5 * sum(sizes.values()), set(names)
    while pot > 1e-9 and open_sources:
        total = sum(weight[s] for s in open_sources)
        share = {s: pot * weight[s] / total for s in open_sources}
        pot = 0.0
        for s in list(open_sources):
            target[s] += share[s]
            if target[s] > 2 * sizes[s]:
                pot += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_sources.discard(s)
    return target


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 7}, {"a": 0, "b": 3, None: 50}, {"é": 5, "z": 90, "Z": 90, None: 1, "b": 0}, {"a": 0}]
)
def test_targets(spark, sizes):
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(table).collect()}
    for source, target in plain_targets(sizes).items():
        assert math.isclose(found[source], target, rel_tol=1e-9, abs_tol=1e-6)


def test_odd_rows(spark, documents):
    rows = [
        *((i, "word " * (i % 7 + 1), f"s{i % 3}") for i in range(60)), (100, None, "s0"), (101, "", None), (102, " \t\x0b", None),
        (103, "one word only", None), (None, "no id here", "s1"), (104, "twice here", "s2"), (104, "twice here", "s2"),
        (104, "same id, other text", "s2"), (105, "%%% && !! ##", "s2"), (106, "long " * 30_000, "t"),
    ]
    docs = documents(*rows).withColumn("size", F.lit("clash")).withColumn("_rest", F.lit(1)).withColumn("key", F.lit(2))
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows)
    assert {r.size for r in found if r.doc_id in (100, 101, 102)} == {0}
    assert [r.size for r in found if r.doc_id == 103] == [1]
    for source in {r.source for r in found}:
        mine = [r for r in found if r.source == source]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert sum(r.taken for r in mine) == math.floor(mine[0].target)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        # complete epochs first: within a source nobody has two more copies than another
        copies = [r.taken / r.size for r in mine if r.size]
        assert not copies or max(copies) - min(copies) <= 1
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=repr)
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_large_lookup_gives_the_same(spark, documents):
    docs = documents(*((i, "a b c " * (i % 5), None if i % 9 == 0 else f"s{i % 4}") for i in range(200)))
    small = sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr)
    assert small == sorted(map(tuple, mixing.mix_sources(docs, lookup_rows=0).collect()), key=repr)
    lookup = spark.createDataFrame([(None, 1), ("s1", 2)], "source string, v int")
    left = [join_lookup(docs, lookup, "source", F.col("doc_id"), limit, "left").groupBy("v").count() for limit in (0, 10)]
    assert sorted(map(tuple, left[0].collect()), key=repr) == sorted(map(tuple, left[1].collect()), key=repr)


def test_better_documents_come_first(spark, documents):
    good = [(i, "plain words of prose go here", "s") for i in range(400)]
    bad = [(1000 + i, "##$$ %%&& !!!! ((()) ==== //", "s") for i in range(400)]
    taken = mixing.mix_sources(documents(*good, *bad)).groupBy((F.col("doc_id") < 1000).alias("good")).agg(F.sum("taken").alias("n"))
    words = {r.good: r.n for r in taken.collect()}
    assert words[True] > 1.2 * words[False]


def test_mixed_documents_and_words(spark, documents):
    docs = documents(*((i, f"w{i} x y", "s") for i in range(8)), (50, "", "s")).withColumn("mix", F.lit(1))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "mix_size", "mix_taken"]
    words = mixed.select(F.explode(mixing.words_taken("text", "mix_size", "mix_taken")).alias("t"))
    assert words.select(F.sum(mixing.word_count("t"))).first()[0] == mixed.select(F.sum("mix_taken")).first()[0] == 36
