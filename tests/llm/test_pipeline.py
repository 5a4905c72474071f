"""The stages in order, each against a plain version on its own input, and planted cases through the whole pipeline."""

import math

from pyspark.sql import functions as F

import corpus_pipeline
from evalloom.llm import contamination, mixing, toxicity
from tests_llm_plain import plain_contained, plain_kept, plain_removed_lines, plain_targets

FOLDER = "/root/testdata/sf0.001"


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "near dedup", "decontamination", "mixing"
    ]


def test_every_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, FOLDER).write.parquet(path)
        out = spark.read.parquet(path)
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count()
        if name != "mixing":
            assert out.columns == columns
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            gone = set(before) - set(after)
            assert {i for i in gone if i in labels} == {i for i, t in labels.items() if t == 1 and i in before}
        elif name == "line dedup":
            removed = plain_removed_lines([(i, r.text) for i, r in before.items()])
            assert set(after) == set(before)
            for i, r in before.items():
                kept = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in removed[i])
                assert (after[i].text, after[i].n_chars) == (kept, len(kept) if removed[i] else r.n_chars)
        elif name == "near dedup":
            assert set(after) == set(plain_kept([(i, r.text) for i, r in before.items()]))
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            dirty = {d for d, *_ in plain_contained([(i, r.text) for i, r in before.items()], items)}
            assert dirty and set(after) == set(before) - dirty
        else:
            sizes = {}
            for r in before.values():
                sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
            targets = plain_targets(sizes)
            for source, target in targets.items():
                taken = sum(r.mix_taken for r in after.values() if r.source == source)
                assert abs(taken - math.floor(target + 1e-6)) <= 1
            assert all(0 < r.mix_taken <= 2 * r.mix_size and r.text == before[i].text for i, r in after.items())
        docs = out


def test_run_agrees_with_itself(spark):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) for _ in range(2))
    assert one and one == two


def test_stages_keep_clean_documents_and_other_columns(spark, documents):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6))
    docs = documents((1, text, "s"), (2, None, None), (3, "short", "s")).withColumn("mix_taken_note", F.lit("kept"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert toxicity.drop_toxic(docs, labels).count() == 3
    assert contamination.drop_contaminated(docs, items).count() == 3
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns


def test_clashing_columns_in_every_stage(spark, documents, tmp_path):
    """Columns named like helpers of the stages, and a dotted one, come out as they went in."""
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6))
    names = [
        "_line_key", "_covered", "_starts", "_cut_id", "_near_key", "_mix_text", "_text_key", "_id", "_key", "_other_key", "_dirty_id",
        "_keep_id", "_lines", "a.b", "node", "key", "_lang",
    ]
    docs = documents((1, text, "s"), (2, None, None), (3, "short", "s"), (3, "short", "s"), (4, "a\nb\nc\na\nb\nc", "s"))
    docs = docs.select("*", *[F.concat(F.lit("mine "), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.withColumn("mix_size", F.lit(-1)) if name == "mixing" else docs
        out = stage(spark, rows, FOLDER)
        out.write.parquet(str(tmp_path / name))
        assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        for row in spark.read.parquet(str(tmp_path / name)).collect():
            assert all(row[n] == f"mine {row.doc_id}" for n in names), (name, row)
