"""Operators against brute force on small frames, skewed inputs and the paths beyond the broadcast limit."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom import registry
from evalloom.functions import tokens as tk
from evalloom.operators import aggregates as ag
from evalloom.operators import decontam as dc
from evalloom.operators import fewshot as fs
from evalloom.operators import generate as g
from evalloom.operators import packing as pk
from evalloom.operators import requests as rq
from evalloom.operators import rollup as rp
from evalloom.operators import scale
from evalloom.session import run_dir
from evalloom.sources import readers as rd
from evalloom.sources import writers as wr
from evalloom.streaming import ingest as st


def test_positions_and_running_start(spark):
    rng = random.Random(1)
    rows = [(i * 3, "hot" if i % 3 else f"k{i}", rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = {r["id"]: (r["p"], r["s"]) for r in scale.positions(scale.running_start(df, "id", F.col("v"), "s"), "id", "p", ["k"]).collect()}
    seen, total = Counter(), 0
    for i, k, v in rows:
        assert got[i] == (seen[k], total)
        seen[k] += 1
        total += v


def test_exact_median(spark):
    rng = random.Random(2)
    rows = [("a", rng.choice([1.0, 2.0, 5.0])) for _ in range(5000)] + [("b", rng.random()) for _ in range(4001)] + [("c", 1.0), ("c", 10.0), ("c", 2.0), ("c", 3.0)]
    got = {r["k"]: r["median"] for r in scale.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: statistics.median(v for q, v in rows if q == k) for k in "abc"}
    assert got["c"] == 2.5


def test_joins_beyond_the_broadcast_limit(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    keys = spark.createDataFrame([(i,) for i in range(5, 20)], "k long")
    small = scale.semi_join_sized(left, keys, "k", F.col("id"))
    large = scale.semi_join_sized(left, keys, "k", F.col("id"), max_rows=2)
    assert sorted(small.collect()) == sorted(large.collect())
    anti = scale.semi_join_sized(left, keys, "k", F.col("id"), max_rows=2, anti=True)
    assert small.count() + anti.count() == 1000
    table = keys.withColumn("x", F.col("k") * 2)
    for how in ("inner", "left"):
        a = scale.lookup_sized(left, table, ["k"], F.col("id"), how)
        b = scale.lookup_sized(left, table, ["k"], F.col("id"), how, max_rows=2)
        assert sorted(map(str, a.select("id", "k", "x").collect())) == sorted(map(str, b.select("id", "k", "x").collect()))


def test_cleaning_small_document(spark):
    dirty = "one two three"
    text = "a" * 10 + " clean start " + dirty + " tail words here " + "z" * 10
    docs = spark.createDataFrame([(1, text), (2, "nothing to see")], "doc_id long, text string")
    grams = spark.createDataFrame([(dirty,)], "ngram string")
    got = [tuple(r) for r in dc.clean_documents(docs, grams, 3, window=2, minimum=5, too_dirty=10).orderBy("doc_id", "start").collect()]
    at = text.index(dirty)
    begin, stop = at - 2, at + len(dirty) + 2
    assert got == [(1, 0, 0, text[:begin]), (1, 1, stop, text[stop:]), (2, 0, 0, "nothing to see")]
    none = dc.clean_documents(docs, grams, 3, window=2, minimum=5, too_dirty=1)
    assert [r["doc_id"] for r in none.collect()] == [2]


def test_overlap_ignores_frequent(spark):
    train = spark.createDataFrame([(i, "Common phrase, here!" if i else "common phrase here rare words now") for i in range(20)], "doc_id long, text string")
    evals = spark.createDataFrame([("t", "test", 1, "common phrase here"), ("t", "test", 2, "RARE words: now")], "task string, set string, item_id long, text string")
    assert {r["item_id"] for r in dc.train_overlap(train, evals, 3).collect()} == {1, 2}
    assert {r["item_id"] for r in dc.train_overlap(train, evals, 3, max_documents=10).collect()} == {2}
    assert [tuple(r) for r in dc.frequent_ngrams(train, 3).collect()] == [("common phrase here", 20)]


def test_buckets_are_sorted(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(9))) for i in range(30)], "doc_id long, text string")
    parts = dc.sorted_buckets(dc.ngram_postings(docs, 3), 4).select(F.spark_partition_id().alias("p"), "bucket", "ngram", "doc_id").collect()
    for p in {r["p"] for r in parts}:
        rows = [tuple(r)[1:] for r in parts if r["p"] == p]
        assert rows == sorted(rows)


def test_packing_keeps_every_token(spark):
    texts = [(i, "x" * ((i * 37) % 90)) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", tk.wrap(tk.byte_tokens("text")).alias("tokens"), tk.wrapped_length("text").alias("n"))
    stream = [t for r in docs.orderBy("doc_id").collect() for t in r["tokens"]]
    blocks = pk.pack_flat(docs, "tokens", F.col("n"), 32).orderBy("block_id").collect()
    assert [t for b in blocks for t in b["tokens"]] == stream
    assert all(len(b["tokens"]) == 32 for b in blocks[:-1])
    plan = pk.fit_or_cut(docs, F.col("n"), 32, 8, 64)
    packed = pk.cut_fragments(docs, plan, "tokens", 32, tk.SPECIAL_IDS["<|endoftext|>"]).orderBy("shard", "block_no").collect()
    assert all(len(b["tokens"]) == 32 for b in packed)
    assert [t for b in packed for t in b["tokens"] if t != tk.SPECIAL_IDS["<|endoftext|>"]] == stream


def test_positions_of_sparse_and_text_keys(spark):
    """Hashed and text ids, a hot group and null groups: positions do not depend on how dense the keys are."""
    rows = [(hash((i, "x")) , f"id-{(i * 7919) % 100_003:06d}", None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, name string, k string").repartition(7)
    for key in ("id", "name"):
        got = {r[key]: r["p"] for r in scale.positions(df, key, "p", ["k"]).collect()}
        want = {}
        for group in {r[2] for r in rows}:
            mine = sorted(r[0 if key == "id" else 1] for r in rows if r[2] == group)
            want.update({v: i for i, v in enumerate(mine)})
        assert got == want
    both = scale.positions(df, ["k", "id"], "p").collect()
    assert sorted(r["p"] for r in both) == list(range(3000))


def test_broadcast_is_sized_in_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert scale.fits_broadcast(wide) and not scale.fits_broadcast(wide, max_rows=9)
    assert not scale.fits_broadcast(wide, max_bytes=5000)


def test_word_edits_have_no_limit(one):
    from evalloom.operators.aggregates import word_edits

    many = F.array_join(F.transform(F.sequence(F.col("id"), F.lit(40_000)), lambda x: x.cast("string")), " ")
    assert one(word_edits(many, F.concat(F.lit("0 1 2"), F.substring(many, 1, 0)))) == 39_998
    assert one(word_edits(F.concat(F.lit("a b c "), F.substring(many, 1, 1)), F.lit("b c x y"))) == 3


def test_deep_and_cyclic_hierarchies(spark):
    from evalloom.operators.rollup import expand_hierarchy

    chain = [(f"n{i:03d}", f"n{i + 1:03d}", "group") for i in range(70)]
    found = expand_hierarchy(spark.createDataFrame(chain, "parent string, child string, kind string"))
    assert found.where("ancestor = 'n000'").agg(F.max("distance")).first()[0] == 70
    with pytest.raises(ValueError, match="cyclic"):
        expand_hierarchy(spark.createDataFrame([("a", "b", "group"), ("b", "a", "group")], "parent string, child string, kind string"))


def test_tokens(one):
    assert one(tk.byte_tokens(F.lit("aé"))) == [97, 195, 169]
    nothing = F.substring(F.col("id").cast("string"), 9, 1)
    assert one(tk.parsed_tokens(F.concat(F.lit("a<|return|>é"), nothing))) == [97, tk.SPECIAL_IDS["<|return|>"], 195, 169]
    assert one(tk.parsed_tokens(F.concat(F.lit("a\u0001b"), nothing))) == [97, 1, 98]
    assert one(tk.parsed_tokens(F.when(F.col("id") > 0, F.lit("x")))) is None
    assert one(tk.compact(tk.wrap(tk.byte_tokens(F.lit("a"))))) == [256, 97, 260]
    assert tk.COMPACT_VOCABULARY == 277
    row = F.array(*[F.lit(ord(c)) for c in "1=23"])
    assert one(tk.context_mask(tk.pad(row, 6), F.lit(4))) == [1, 1, 0, 0, 1, 1]
    with pytest.raises(Exception, match="row longer"):
        one(tk.pad(row, 3))
    with pytest.raises(Exception, match="inside the training range"):
        one(pk.held_out_lengths(F.lit("48,12"), F.lit(32)))


def test_generator_examples(one):
    assert one(g.addition_text(F.lit(1234), F.lit(5), 4)) == "[4321] + [5000] = [93210]"
    tokens = F.split(F.lit("4815 R 5839 5598 R 5835"), " ")
    assert one(g.interval_text(tokens)) == "4815 R 5839 5598 R 5835 ?interval = 11437"
    assert one(g.last_text(F.split(F.lit("4815 R 5839 5598 5835"), " "))) == "4815 R 5839 5598 5835 ?last = 17272"
    marked = g.marked_sequence(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))
    assert one(marked) == ["1", "R", "2", "R"]
    assert one(g.filler_steps(F.lit(10), F.lit(3), F.lit(100), 5)) == 30


def test_random_shots(spark):
    pool = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(90)], "id long, text string")
    evals = pool.select(F.col("id").alias("eval_id"), "text")
    rows = fs.random_shots(pool, evals, 6, 5, "id", "eval_id", "text").collect()
    own = {r["eval_id"]: r["text"] for r in evals.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["eval_id"], []).append(r)
    assert len(by) == 90
    for e, shots in by.items():
        assert len({s["id"] for s in shots}) == 6
        assert all(s["text"] != own[e] for s in shots)
    with pytest.raises(Exception, match="few-shot candidates"):
        fs.random_shots(pool, evals, 89, 5, "id", "eval_id", "text").collect()


def test_requests(spark):
    docs = spark.createDataFrame([(1, "Q", ["A", "B", "C"])], "doc_id long, ctx string, choices array<string>")
    assert [r["continuation"] for r in rq.choice_requests(docs, ["doc_id"], "ctx", "choices", prefix="Answer: ").orderBy("idx").collect()] == ["A", "B", "C"]
    runs = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (2, 1, "z")], "q long, seed int, a string")
    assert [tuple(r) for r in rq.merge_runs(runs.where("q = 1"), ["q"], "seed", "a", [1, 2]).collect()] == [(1, "x", "y")]
    with pytest.raises(Exception, match="not unique"):
        rq.merge_runs(runs, ["q"], "seed", "a", [1, 2]).collect()
    with pytest.raises(Exception, match="different task sets"):
        rq.paired(runs.where("q = 1").select("q"), runs.where("q = 2").select("q"), ["q"]).collect()


def test_materialised(spark):
    base = run_dir(spark, "requests")
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for mode in ("reuse", "reuse", "refresh"):
        assert rq.materialised(spark, build, {"a": 1}, base, mode).count() == 3
    assert len(made) == 2
    assert rq.materialised(spark, build, {"a": 1}, base, "delete") is None
    rq.materialised(spark, build, {"a": 1}, base)
    assert len(made) == 3


def test_dict_metric_and_bootstrap(spark):
    rows = spark.createDataFrame([({"pass@1": 1.0, "pass@3": 0.5},)] * 3, "m map<string,double>")
    assert {r["metric"]: r["value"] for r in ag.dict_metrics(rows, "m", "sum").collect()} == {"pass@1": 3.0, "pass@3": 1.5}
    uniform = spark.range(1000).select(F.lit("t").alias("task"), F.rand(42).alias("x"))
    uniform = spark.createDataFrame(uniform.collect())
    boot = ag.bootstrap_stderr(uniform, ["task"], "x", 4000).first()["bootstrap_stderr"]
    exact = uniform.agg(ag.mean_stderr("x")).first()[0]
    assert boot == pytest.approx(exact, rel=0.05)
    hits = spark.range(2000).select((F.col("id") % 2).cast("double").alias("x"))
    assert ag.bootstrap_stderr(hits, [], "x", 2000).first()["bootstrap_stderr"] == pytest.approx(0.5 / math.sqrt(2000), rel=0.08)


def test_consistency_by_pairs(spark):
    rng = random.Random(4)
    rows = [(i % 20, rng.choice("AB")) for i in range(100)]
    rate = ag.consistency_rate(spark.createDataFrame(rows, "q long, a string"), ["q"], F.col("a")).first()[0]
    same = total = 0
    for q in range(20):
        said = [a for k, a in rows if k == q]
        for i in range(len(said)):
            for j in range(i):
                total += 1
                same += said[i] == said[j]
    assert rate == pytest.approx(same / total)


def test_best_threshold(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random() < 0.6, round(rng.random(), 2), rng.random() < 0.2) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, h boolean, p double, e boolean")
    got = ag.best_threshold(df, F.col("s"), F.col("h"), F.col("p"), F.col("e"), chunks=7).first()["best"]
    base = sum(not h for _, h, _, _ in rows)
    best = run = base
    for p in sorted({r[2] for r in rows}):
        run += sum(s if h else (0 if e else -1) for s, h, q, e in rows if q == p)
        best = max(best, run)
    assert got == pytest.approx(100 * best / len(rows))


def test_hierarchy(spark):
    edges = spark.createDataFrame([("g", "sub", "inline"), ("g::sub", "t1", "task"), ("g", "tag", "tag"), ("tag", "t2", "task")], "parent string, child string, kind string")
    closure = rp.expand_hierarchy(edges)
    assert {(r["group"], r["task"]) for r in rp.leaves(closure).collect()} == {("g", "t1"), ("g", "t2"), ("g::sub", "t1"), ("tag", "t2")}
    settings = spark.createDataFrame([("g", "shots", "5"), ("tag", "shots", "3"), ("t1", "shots", "0")], "node string, key string, value string")
    assert {r["task"]: r["value"] for r in rp.resolve_overrides(settings, closure).collect()} == {"t1": "0", "t2": "5"}
    loop = spark.createDataFrame([("a", "b", "group"), ("b", "a", "group")], "parent string, child string, kind string")
    with pytest.raises(ValueError, match="cyclic"):
        rp.expand_hierarchy(loop)


def test_archive_round_trip(spark):
    folder = run_dir(spark, "lines")
    lines = ['{"text": "a\\nb", "meta": {"k": "v"}}', '{"text": ["p", "q"]}', '"bare"', '{"text": "[x"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    got = sorted((r["text"], dict(r["meta"])) for r in rd.read_archive(spark, folder).collect())
    assert got == sorted([("a\nb", {"k": "v"}), ("p\n\nq", {}), ("bare", {}), ("[x", {})])
    posting = spark.createDataFrame([("a b c 12",)], "v string").select(rd.split_posting(F.col("v")).alias("p")).first()["p"]
    assert tuple(posting) == ("a b c", 12)


def test_stream_resumes(spark):
    base = run_dir(spark, "stream")
    docs = spark.createDataFrame([(i, f"one two three four {i}") for i in range(10)], "doc_id long, text string")
    docs.where("doc_id < 6").write.parquet(f"{base}/in")

    def ingest():
        stream = st.file_stream(spark, f"{base}/in", docs.schema, files_per_batch=2)
        return st.ingest_ngrams(stream, f"{base}/out", f"{base}/offsets", 3, 4)

    assert ingest() > 0
    assert ingest() == 0
    docs.where("doc_id >= 6").write.mode("append").parquet(f"{base}/in")
    ingest()
    got = st.read_batches(spark, f"{base}/out").select("ngram", "doc_id").collect()
    want = dc.ngram_postings(docs, 3).select("ngram", "doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_examples_sink(spark):
    prompts = spark.createDataFrame([("t", i, f"p{i}") for i in range(5)], "task string, doc_id long, prompt string")
    rows = wr.rendered_examples(prompts, "task", "doc_id", "prompt", 2).orderBy("example").collect()
    assert [r["block"] for r in rows] == [f"{wr.DIVIDER}{i}\np{i}\n" for i in range(2)]


def test_registries():
    @registry.register_filter("test_only")
    def test_only(r):
        return r

    with pytest.raises(ValueError):
        registry.register_filter("test_only")(test_only)
    with pytest.raises(KeyError):
        registry.call("no.such")
