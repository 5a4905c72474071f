"""Streams over tables that are one file or a folder of files."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.functions import wordhash
from evalloom.operators import decontam as dc
from evalloom.operators import runs as rn
from evalloom.plans import catalog
from evalloom.session import run_dir
from evalloom.streaming import ingest as st

ENTRIES = catalog.load()


@pytest.mark.parametrize("files", [1, 3])
def test_streams_of_a_folder_of_files(spark, files):
    base = run_dir(spark, "tables")
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven twelve last") for i in range(6)], "doc_id long, text string")
    docs.repartition(files).write.parquet(f"{base}/documents.parquet")
    docs.limit(1).write.parquet(f"{base}/documents.parquet.old")
    t = catalog.Tables(spark, base)
    assert [r.n for r in ENTRIES["streamed_ngrams"].build(t).collect()] == [6]
    assert ENTRIES["streamed_tokens"].build(t).count() == 6
    assert ENTRIES["streamed_blocks"].build(t).count() == 6


def test_ingested_ngrams_are_kept_as_runs(spark):
    """A word is written about three times, not once for each of its n-grams; equal n-grams are in one bucket, files are sorted."""
    base, rng = run_dir(spark, "kept"), random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(200))) for i in range(60)] + [(60, None), (61, "a b"), (None, "a b c d e f g h i j k l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{base}/in")
    st.ingest_ngrams(st.file_stream(spark, f"{base}/in", docs.schema, files_per_batch=2), f"{base}/out", f"{base}/offsets", 13, 4)
    files = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*")
    strings = [c for c, kind in files.dtypes if kind == "string"]
    words = files.agg(F.sum(sum(F.size(F.split(c, " ")) for c in strings))).first()[0]
    assert words < 4 * 60 * 200
    got = st.read_batches(spark, f"{base}/out")
    want = dc.ngram_postings(docs, 13).select("ngram", "doc_id").collect()
    assert sorted(map(repr, got.select("ngram", "doc_id").collect())) == sorted(map(repr, want))
    assert got.groupBy("ngram").agg(F.count_distinct("bucket").alias("b")).where("b > 1").count() == 0
    assert {r["bucket"] for r in got.select("bucket").distinct().collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("run_bytes", [rn.RUN_BYTES, 400])
def test_repeated_ngrams_of_batches(spark, run_bytes):
    """Counts of n-grams over batches, as SQL has them, also of a mark and of an n-gram that fill many partitions; n-grams are not dealt one by one."""
    base, rng = run_dir(spark, "counted"), random.Random(6)
    passage = " ".join(f"p{k}" for k in range(9))
    rows = [(i, " ".join([*(f"w{rng.randrange(6)}" for _ in range(rng.randrange(40))), passage, *["tick"] * rng.randrange(30)])) for i in range(150)]
    docs = spark.createDataFrame(rows + [(150, None), (151, ""), (152, "a b")], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{base}/in")
    st.ingest_ngrams(st.file_stream(spark, f"{base}/in", docs.schema, files_per_batch=2), f"{base}/out", f"{base}/offsets", 4, 4)
    for more_than in (1, 40):
        found = rn.repeated_ngrams(st.written(spark, f"{base}/out"), 4, more_than, run_bytes)
        want = dc.ngram_postings(docs, 4).groupBy("ngram").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
        assert found.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert "ngram" not in found._jdf.queryExecution().sparkPlan().toString().split("Exchange", 1)[1]


def test_ngrams_of_one_hash_are_told_apart(monkeypatch):
    def same(words, n, salt=0):
        value, inside = wordhash.run_hashes(words, n, salt)
        return value * 0, inside

    monkeypatch.setattr(rn, "run_hashes", same)
    batch = pa.RecordBatch.from_arrays([pa.array([2, 1, 1, 1]), pa.array(["a b c", "b c d", "x y z", "\u00e9 b"])], ["copies", "words"])
    rows = [r for b in rn.often(iter([batch]), 2, 1) for r in b.to_pylist()]
    assert sorted((r["ngram"], r["n"]) for r in rows) == [("a b", 2), ("b c", 3)]


def test_packed_runs_come_back():
    rows = pa.RecordBatch.from_arrays(
        [pa.array([2, 0, 2, 2], pa.int32()), pa.array(["k", None, "k", "l"]), pa.array(["a b", "c d e", "a b", "\u00e9 f"])], ["part", "key", "words"])
    schema = pa.schema([("key", pa.string())])
    for held in (1, 1 << 20):
        blobs = list(rn.packed(iter([rows, rows.slice(1, 2)]), held=held))
        back = [r for b in rn.unpacked(iter(blobs), schema) for r in b.to_pylist()]
        assert sorted(map(repr, back)) == sorted(repr({"key": r["key"], "words": r["words"]}) for r in rows.to_pylist() + rows.slice(1, 2).to_pylist())
    summed = list(rn.packed(iter([rows.select(["part", "words"])]), sums=True))
    back = [r for b in rn.unpacked(iter(summed), pa.schema([("copies", pa.int64())])) for r in b.to_pylist()]
    assert sorted((r["words"], r["copies"]) for r in back) == [("a b", 2), ("c d e", 1), ("\u00e9 f", 1)]
