"""Toxicity, language and quality: held-out accuracy, bounds of the samples, and odd rows."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import language, linear, quality, toxicity
from evalloom.llm.common import held_out

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def odd(documents):
    return documents(
        (1, None), (2, ""), (3, " \t\n"), (4, "12 34 !!"), (None, "words without an id"), (5, "same"), (5, "same"), (6, "long " * 40_000),
        (7, "Ünï cödé ünd ß"), (8, "中文"),
    ).withColumn("p_toxic", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("_id", F.lit(1))


def test_toxicity_on_documents_not_trained_on(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train_chain(docs, labels.where(F.col("doc_id") % 2 == 0))
    found = toxicity.score_documents(docs, chain).join(labels, "doc_id").where(F.col("doc_id") % 2 == 1)
    rows = found.select("toxic", "p_toxic").collect()
    caught = [r.p_toxic >= toxicity.THRESHOLD for r in rows if r.toxic == 1]
    wrong = [r.p_toxic >= toxicity.THRESHOLD for r in rows if r.toxic == 0]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.005


def test_chain_uses_earlier_categories():
    """A category that is exactly an earlier one, with features that say nothing else, is learned from its probability."""
    rng = np.random.default_rng(0)
    n = 400
    first = rng.integers(0, 2, n).astype(float)
    rows = linear.Sparse(np.arange(n + 1), first.astype(np.int64), np.ones(n), 2)
    models = toxicity.fit_chain(rows, np.column_stack([first, first]), np.arange(n) % 3)
    assert models[1].extra[0] > 0.5 and len(models[0].extra) == 0
    constant = linear.fit(rows, np.zeros((n, 0)), np.zeros(n))
    assert constant.predict(rows, np.zeros((n, 0))).max() < 1e-6


def test_toxicity_of_odd_rows(spark, corpus, odd):
    docs, labels = corpus
    found = toxicity.toxicity(odd, labels.limit(0))
    assert found.count() == 10 and found.agg(F.max("p_toxic")).first()[0] < 1e-6
    chain = toxicity.train_chain(docs, labels.unionByName(spark.createDataFrame(
        [(None, 1, 1), (10**9, None, 1), (0, 1, None)], "doc_id long, quality int, toxic int")))
    rows = toxicity.score_documents(odd, chain).collect()
    assert [r.p_toxic for r in rows if r.doc_id in (1, 2, 3)] == [0.0] * 3
    assert len({r.p_toxic for r in rows if r.doc_id == 5}) == 1
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == 10


def test_sample_is_bounded_and_whole(corpus):
    docs, labels = corpus
    sample = toxicity.labelled_sample(docs, labels, "doc_id", "text", (7, 5)).collect()
    assert sorted(r.toxic for r in sample) == [0] * 7 + [1] * 5
    assert all(sum(r.n) == 3 * r.n_words for r in sample)


def test_language_held_out(corpus):
    docs, _ = corpus
    rows = language.identify(docs, steps=80).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, corpus, odd):
    docs, _ = corpus
    net, names = language.learn(docs, documents=20, steps=20)
    assert names == ["de", "en", "es", "fr"]
    rows = language.predict(odd, net, names).collect()
    assert len(rows) == 10
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 4)} == {"und"}
    assert {r.score for r in rows if r.doc_id in (1, 2, 3, 4)} == {0.0}
    assert all(r.lang_pred in names for r in rows if r.doc_id not in (1, 2, 3, 4))
    assert {r.lang_pred for r in language.identify(odd).collect()} == {"und"}  # all languages are null
    one = odd.withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in language.identify(one).collect()} == {"xx", "und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_recurrent_slopes():
    """Derivatives of backpropagation through time against differences; the fast pass against the plain one."""
    rng = np.random.default_rng(0)
    net = language.initial(3, 4, rng)
    symbols = rng.integers(97, 110, (5, 9))
    symbols[0, 6:] = language.PAD
    labels = rng.integers(0, 3, 5)
    _, slopes = language.loss_and_slopes(net, symbols, labels)
    for part in range(4):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in net[part].shape) if part else (rng.integers(0, 2), int(symbols[1, 2]), rng.integers(0, 12))
            sides = []
            for e in (1e-5, -1e-5):
                moved = [p.copy() for p in net]
                moved[part][at] += e
                sides.append(language.loss_and_slopes(language.Network(*moved), symbols, labels)[0])
            assert abs((sides[0] - sides[1]) / 2e-5 - slopes[part][at]) < 1e-6
    text = rng.integers(97, 110, (language.SEGMENT, 3)).astype(np.int16)
    sums = language.position_sums(net, text, np.full(3, language.SEGMENT))
    assert np.allclose(sums.sum(axis=1), language.SEGMENT, atol=1e-3)
    losses = [language.loss_and_slopes(net, text.T[[i]], np.array([k]))[0] for i in range(3) for k in range(3)]
    assert np.all(np.array(losses).reshape(3, 3).argmin(axis=1) == sums.argmax(axis=1))


def test_quality_held_out(corpus):
    docs, labels = corpus
    rows = quality.quality(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == v] for v in (1, 0))
    above = np.mean([g > b for g in good for b in bad])
    assert above > 0.9 and np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_quality_of_odd_rows(corpus, odd):
    docs, labels = corpus
    rows = quality.quality(odd, labels.limit(0)).collect()
    assert len(rows) == 10 and {r.score for r in rows} == {0.5}
    model = quality.train_quality(docs, labels, sample_documents=30, sample_chunks=20)
    rows = quality.score_quality(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.quality(odd.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality(odd, labels.where("quality = 1")).collect()} > set()


def test_labels_of_held_out_rows_are_never_read(corpus):
    """Flipping every held-out label and language changes no result."""
    docs, labels = corpus
    flipped = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = quality.train_quality(docs, labels, sample_documents=60, sample_chunks=60)
    two = quality.train_quality(docs, flipped, sample_documents=60, sample_chunks=60)
    assert one.good == two.good and one.bad == two.bad and one.bias == two.bias
    other = docs.withColumn("lang", F.when(held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    _, names = language.learn(other, documents=5, steps=1)
    assert "zz" not in names


def test_fit_on_the_driver_needs_little_beside_its_rows():
    """Steps over blocks: the values scaled once, and no other copy of a column of the rows."""
    rng = np.random.default_rng(8)
    start = np.concatenate([[0], np.cumsum(rng.integers(0, 2000, 2000))])
    rows = linear.Sparse(start, rng.integers(0, 5000, start[-1]).astype(np.int32), rng.random(start[-1]).astype(np.float32), 5000)
    target = (np.arange(2000) % 3 == 0).astype(float)
    tracemalloc.start()
    model = linear.fit(rows, np.zeros((2000, 0)), target, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.value.nbytes + (8 << 20) < 3 * rows.value.nbytes
    whole = np.concatenate([[0.0], np.cumsum(rows.value * model.weight[rows.column], dtype=float)])
    assert np.array_equal(rows.dot(model.weight), whole[start[1:]] - whole[start[:-1]])
    spread = np.repeat(target, np.diff(start)) * rows.value
    assert np.array_equal(rows.back(target), np.bincount(rows.column, weights=spread, minlength=5000))
    some = rows.take(np.array([5, 3, 1999, 0]))
    assert np.array_equal(some.value, np.concatenate([rows.value[start[i] : start[i + 1]] for i in (5, 3, 1999, 0)]))
