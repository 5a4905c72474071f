import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalloom.llm import simhash
from evalloom.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = []
    for word in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        dict.fromkeys([9, 10, 11, 12, 13], " ")
    ).split(" "):
        if word:
            words.append(word)
    grams = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    votes = [0] * 64
    for gram in grams:
        value = xxhash.xxh64(" ".join(gram).encode(), seed=42).intdigest()
        for bit in range(64):
            votes[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(grams))


def plain_components(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if label[b] != label[a] and (x ^ y).bit_count() <= 4:
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    out = []
    for a, (i, x) in enumerate(prints):
        ids = [prints[b][0] for b in range(len(prints)) if label[b] == label[a] and prints[b][0] is not None]
        out.append((i, f"{x:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def result(docs):
    found = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = sorted((tuple(r) for r in simhash.op8_simhash(spark, FOLDER).collect()), key=repr)
    assert found == plain_components(rows)


def test_odd_rows(spark, documents):
    words = [f"w{i}" for i in range(400)]
    near = [" ".join(words[:k] + ["x"] + words[k:]) for k in (10, 200, 390)]
    rows = [
        (7, " ".join(words)), (3, " ".join(words).upper()), *((20 + i, t) for i, t in enumerate(near)),
        (5, ""), (6, None), (4, "  \t\n"), (8, "a"), (9, "a b"), (9, "a b"), (None, "a b"), (None, "only here, without an id"),
        (11, " "), (12, "É é"), (13, "é é"), (14, "long " * 50_000),
    ]
    docs = documents(*rows).withColumn("component_id", F.lit("clash")).withColumn("fp", F.lit(1))
    assert result(docs) == plain_components(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for _, _, c in plain_components(rows)})
    assert result(documents(*rows).limit(0)) == []


@pytest.mark.parametrize("run_length", [2, 3, 7, 4096])
def test_long_runs_lose_no_link(spark, run_length):
    """A dense ball and scattered values: blocks of a long run give the same components as all pairs."""
    rng = np.random.default_rng(5)
    values = {0, -1}
    for center in (0x1234_5678_9ABC_DEF0, 0):
        for _ in range(40):
            bits = rng.permutation(64)[: rng.integers(0, 5)]
            value = center
            for b in bits:
                value ^= 1 << int(b)
            values.add(value - (1 << 64) if value >> 63 else value)
    values |= {int(v) for v in rng.integers(-(2**63), 2**63 - 1, 30)}
    nodes = sorted(values)
    distinct = spark.createDataFrame([(v,) for v in nodes], "fp long")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(distinct, run_length=run_length)).collect()}
    expected = {}
    for v in nodes:
        group, todo = {v}, [v]
        while todo:
            x = todo.pop()
            near = {y for y in nodes if ((x ^ y) & (2**64 - 1)).bit_count() <= 4} - group
            group |= near
            todo += near
        expected[v] = min(group)
    assert {v: roots.get(v, v) for v in nodes} == expected


def test_equal_codewords_within_two_bits():
    tables = simhash.golay_tables()
    assert sorted(set(tables[1])) == [1, 6]
    rng = np.random.default_rng(1)
    for value in rng.integers(0, 1 << 23, 200):
        flips = rng.permutation(23)[:2]
        other = value ^ (1 << flips[0]) ^ (1 << flips[1])
        index, valid = simhash.codeword_indices(np.array([value, other]), tables)
        assert set(index[0][valid[0]]) & set(index[1][valid[1]])


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 150), (150, 300), (500, 500)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 200: 150, 300: 150}
