"""Near copies against all pairs by the Jaccard similarity of their shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalloom.llm import near_copies, simhash
from evalloom.llm.common import text_key


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        dict.fromkeys([9, 10, 11, 12, 13], " ")
    ).split(" ")
    words = [w for w in words if w]
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_kept(rows):
    """Smallest (id, text) of every group, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - both
            if 10 * both >= 8 * union:
                label[top(a)] = top(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append((d is None, d))
    return sorted((min(g, key=lambda x: (x[0], x[1] or 0))[1] for g in groups.values()), key=repr)


def kept(docs, **options):
    return sorted((r.doc_id for r in near_copies.drop_similar(docs, **options).select("doc_id").collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 9 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [3, 2048])
def test_edited_copies_against_all_pairs(spark, documents, block):
    rng = random.Random(4)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((8, 40, 300)))]
        rows.extend((len(rows) + k, " ".join(edited(rng, base, rng.choice((0.005, 0.02, 0.03))))) for k in range(14))
    assert kept(documents(*rows), block=block) == plain_kept(rows)
    assert len(plain_kept(rows)) not in (12, len(rows))


def test_stage_drops_what_four_bits_miss(spark, documents):
    """Similarity of 0.8 and more, with more than four bits between the fingerprints."""
    rng = random.Random(1)
    rows = []
    for family in range(30):
        base = [f"w{rng.randrange(9000)}" for _ in range(300)]
        other = list(base)
        for at in range(20, 300, 60):
            other[at] = f"x{at}"
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join(other))]
    docs = documents(*rows)
    assert simhash.drop_near_duplicates(docs).count() > 30
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == list(range(0, 60, 2))


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept(docs) == plain_kept(rows)


def test_odd_rows(spark, documents):
    words = [f"w{i}" for i in range(400)]
    rows = [
        (7, " ".join(words)), (3, " ".join(words).upper()), (20, " ".join(words[:200] + ["x"] + words[200:])), (5, ""), (6, None),
        (4, "  \t\n"), (8, "a"), (9, "a b"), (9, "a b"), (None, "a b"), (None, "only here, without an id"), (12, "\u00c9 \u00e9"),
        (13, "\u00e9 \u00e9"), (14, "long " * 50_000), (15, "long " * 40), (16, "a b c d e"), (17, "a b c d f"),
    ]
    docs = documents(*rows).withColumn("node", F.lit("clash")).withColumn("key", F.lit(1))
    out = near_copies.drop_similar(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == plain_kept(rows)
    assert near_copies.drop_similar(docs.limit(0)).count() == 0


def test_bands_find_pairs_at_the_threshold():
    """10,000 pairs of similarity 0.8 share a key, and pass the screen."""
    rng = np.random.default_rng(2)
    for _ in range(100):
        sets = []
        for _ in range(100):
            values = rng.integers(0, 1 << 64, 110, dtype=np.uint64)  # two sets of 100 - 1 and 110 - 10: 88 of 110
            sets += [values[:99], values[11:]]
        least = near_copies.minima(sets, near_copies.BANDS * near_copies.ROWS)
        keys = near_copies.band_keys(least)
        assert ((keys[::2] == keys[1::2]).any(axis=1)).all()
        sign = (least[:, : near_copies.SIGNATURE] >> np.uint64(20)).astype(np.uint8)
        assert ((sign[::2] == sign[1::2]).sum(axis=1) >= near_copies.AGREE).all()


def test_sets_of_a_slice():
    sets = near_copies.shingle_sets(pa.array([b"A b c d e f", b"", b"a b", b"a B"], pa.large_binary()))
    assert [len(s) for s in sets] == [2, 0, 1, 1] and sets[2][0] == sets[3][0]


def test_golay_keys_link_close_fingerprints(spark, documents):
    """With bands that no two texts share, links come from the Golay keys of the fingerprints, and the shingle sets still decide."""
    rng = random.Random(6)
    texts = []
    for family in range(12):
        base = [f"w{rng.randrange(9000)}" for _ in range(900)]
        texts.append(base)
        for changes in (1, 2, 4):
            other = list(base)
            for at in rng.sample(range(900), changes):
                other[at] = f"x{at}"
            texts.append(other)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = documents(*rows).select("doc_id", text_key("text").alias("text_key"), "text")
    found = near_copies.text_nodes(docs).withColumn("bands", F.array("node"))
    fps = {r.node: r.fp for r in found.collect()}
    close = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= simhash.DISTANCE]
    label = {n: n for n in fps}
    for _ in fps:
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    expected = {n: r for n, r in label.items() if n != r}
    linked = {r.node: r.root for r in near_copies.similar_roots(docs, found).collect()}
    assert all(label[n] == label[r] for n, r in linked.items())
    assert len(linked) >= 0.8 * len(expected) > 15  # one candidate per node; bands give the rest
    assert near_copies.similar_roots(docs, found, similarity=0.9999).count() == 0


def test_golay_candidates_are_no_more_than_nodes(spark):
    fps = [0, 0, 0, 1, 3, 1 << 40, (1 << 40) + 31, -1]
    nodes = spark.createDataFrame(list(enumerate(fps, 10)), "node long, fp long")
    rows = [(r.a, r.b) for r in near_copies.golay_candidates(nodes).collect()]
    assert all(a < b for a, b in rows) and {(10, 11), (10, 12)} <= set(rows)
    assert sorted(b for _, b in rows) == [11, 12, 13, 14, 15, 16]
