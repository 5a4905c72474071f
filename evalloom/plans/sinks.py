"""Sinks, read back: what was written must be what was there."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import tokens as tk
from evalloom.operators import buckets as bk
from evalloom.operators import decontam as dc
from evalloom.operators import packing as pk
from evalloom.operators import rollup as rp
from evalloom.operators import runs as rn
from evalloom.plans import corpus as cq
from evalloom.plans.catalog import query
from evalloom.plans.contamination import TRAIN
from evalloom.sources import writers as wr


@query("token_shards", "SNK-2", f"""with b as (select g // {cq.BLOCK} block_id, count(*) n, sum(token)::bigint total
  from (with {cq.PLACED} select at_token + p g, token from ({cq.WRAPPED}) join placed using (doc_id)) group by 1)
select case when block_id < 4 then 'val' else 'train' end split,
  case when block_id < 4 then 'val_000000' else 'train_' || lpad(((block_id - 4) // 100 + 1)::varchar, 6, '0') end shard,
  count(*) n_blocks, sum(n)::bigint n_tokens, sum(total)::bigint total from b group by 1, 2""")
def token_shards(t):
    docs = t.documents.select("doc_id", "text", tk.wrapped_length("text").alias("n"))
    blocks = pk.pack_shards(docs, tk.wrap(tk.byte_tokens("text")), F.col("n"), cq.BLOCK, 100, 4)
    back = t.spark.read.parquet(wr.write_token_shards(blocks, wr.new_folder(t.spark, "shards"), dealt=True))
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.groupBy("split", "shard").agg(
        F.count("*").alias("n_blocks"), F.sum(F.size("tokens").cast("long")).alias("n_tokens"), F.sum(total).alias("total")
    )


@query("matrix_sink", "SNK-3", """select case when l_orderkey % 50 = 0 then 'val' else 'train' end split, 'fixed_d2' variant, count(*) num_examples,
  32::bigint seq_len, 32::bigint mask_len from lineitem group by 1""")
def matrix_sink(t):
    rows = cq.sum_rows(t).withColumn("row", tk.pad(F.col("tokens"), 32))
    matrix = rows.select(
        F.when(F.col("l_orderkey") % 50 == 0, "val").otherwise("train").alias("split"), F.col("row").alias("tokens"),
        tk.context_mask(F.col("row"), F.size("tokens")).alias("context_mask"),
    )
    folder = wr.write_matrix(matrix, wr.new_folder(t.spark, "matrix"), "fixed_d2")
    meta = t.spark.read.parquet(f"{folder}/meta")
    rows_back = t.spark.read.parquet(f"{folder}/rows").groupBy("variant", "split").agg(F.count("*").alias("n"))
    return meta.join(rows_back, ["variant", "split"]).where("n = num_examples").select(
        "split", "variant", "num_examples", F.col("seq_len").cast("long").alias("seq_len"), F.col("mask_len").cast("long").alias("mask_len")
    )


@query("rendered_examples", "SNK-4", """select source, string_agg('!!@@##@@!! -- Example ' || (r - 1)::varchar || chr(10) || doc_id::varchar || ': ' || lang || chr(10), '|' order by r) block
from (select *, row_number() over (partition by source order by doc_id) r from documents) where r <= 3 group by source""")
def rendered_examples(t):
    prompts = t.documents.select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(": "), "lang").alias("prompt"))
    examples = wr.rendered_examples(prompts, "source", "doc_id", "prompt", 3)
    folder = wr.write_examples(examples, wr.new_folder(t.spark, "examples"), "source")
    written = t.spark.read.text(folder).groupBy("source").agg(F.sum(F.length("value") + 1).alias("chars"))
    shown = examples.groupBy("source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "block"))), lambda e: e["block"]), "|").alias("block"),
        F.sum(F.length("block") + 1).alias("chars"),
    )
    return shown.join(written, ["source", "chars"]).select("source", "block")


def samples(t):
    said = t.conversations
    return said.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), F.col("role").alias("filter"), F.lit("gold").alias("target"), F.col("text").alias("ctx"),
        F.array(F.lit(" yes"), F.lit(" no")).alias("continuations"), F.array(F.lower("text")).alias("filtered"),
        (F.length("text") % 2 == 0).alias("is_greedy"), F.create_map(F.lit("acc"), (F.length("text") % 7).cast("double")).alias("metrics"),
    )


@query("dataset_export", "SNK-5", """select (conv_id * 100 + turn)::varchar || '.' || role id, md5(text || chr(10) || chr(10) || '-  yes' || chr(10) || '-  no') digest,
  (length(text) + 14)::bigint input_len, 'gold' labels, ' yes' first_choice from conversations""")
def dataset_export(t):
    many = rp.sample_dataset(samples(t), "multiple_choice", True)
    one = rp.sample_dataset(samples(t), "loglikelihood", True).select("id", F.col("labels").alias("first_choice"))
    return many.join(one, "id").select("id", F.md5("data").alias("digest"), F.col("input_len").cast("long").alias("input_len"), "labels", "first_choice")


@query("system_export", "SNK-5", """select (conv_id * 100 + turn)::varchar id, lower(text) output, length(lower(text))::bigint output_length,
  case when length(text) % 2 = 0 then 'correct' else 'incorrect' end greedy, (length(text) % 7)::double acc from conversations""")
def system_export(t):
    text = rp.sample_system(samples(t), "generate_until", ["acc"])
    greedy = rp.sample_system(samples(t), "loglikelihood", ["acc"]).select("id", F.col("output").alias("greedy"))
    return text.join(greedy, "id").select("id", "output", F.col("output_length").cast("long").alias("output_length"), "greedy", "acc")


@query("ngram_package", "SNK-6 DEC-5", f"""with {TRAIN}, d as (select distinct doc_id, ngram from train)
select count(*) n_postings, count(distinct ngram) n_ngrams, 13::bigint ngram_size from d""")
def ngram_package(t):
    folder = wr.new_folder(t.spark, "package")
    table = wr.write_marked_package(rn.ngram_runs(t.documents, dc.NGRAM), folder, dc.NGRAM, bk.bucket_count(t.spark))
    size = t.spark.read.json(f"{folder}/info").first()["ngram_size"]
    back = t.spark.table(table).groupBy("mark", "ngram").agg(F.count("*").alias("n"))  # equal n-grams lie in one bucket: no shuffle
    return back.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_postings"), F.count("*").alias("n_ngrams")).withColumn("ngram_size", F.lit(size).cast("long"))
