"""Streams over the table files; the final state must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import generate as g
from evalloom.plans import corpus as cq
from evalloom.plans import generators as gq
from evalloom.plans.catalog import query
from evalloom.plans.contamination import TRAIN
from evalloom.session import run_dir
from evalloom.streaming import ingest as st


def stream(t, table: str):
    return st.file_stream(t.spark, t.folder, t.spark.read.parquet(t.path(table)).schema, f"{table}.parquet")


@query("streamed_ngrams", "DEC-15 STR-1", f"""with {TRAIN} select ngram, count(*) n from train group by ngram having count(*) > 1""")
def streamed_ngrams(t):
    base = run_dir(t.spark, "ngrams")
    docs = stream(t, "documents").select("doc_id", "text")
    st.ingest_ngrams(docs, f"{base}/out", f"{base}/offsets", buckets=8)
    st.ingest_ngrams(docs, f"{base}/out", f"{base}/offsets", buckets=8)  # nothing new: the second run adds no row
    return st.repeated_in_batches(t.spark, f"{base}/out", 1)


@query("streamed_tokens", "STR-2", cq.summary_sql(cq.WRAPPED, "doc_id"))
def streamed_tokens(t):
    base = run_dir(t.spark, "tokens")
    st.catch_up(st.tokenised(stream(t, "documents").select("doc_id", "text")), f"{base}/out", f"{base}/offsets")
    return cq.token_summary(st.read_batches(t.spark, f"{base}/out"), "tokens", "doc_id")


@query("streamed_blocks", "STR-2 PCK-3", """select doc_id, ((octet_length(encode(text)) + 1) // 512 + 1)::bigint n_blocks,
  (octet_length(encode(text)) + 2)::bigint n_tokens, (((octet_length(encode(text)) + 1) // 512 + 1) * 512 - octet_length(encode(text)) - 2)::bigint n_pad from documents""")
def streamed_blocks(t):
    base = run_dir(t.spark, "blocks")
    docs = st.padded_blocks(st.tokenised(stream(t, "documents").select("doc_id", "text")), 512)
    st.catch_up(docs, f"{base}/out", f"{base}/offsets")
    pads = F.size(F.filter("tokens", lambda x: x == cq.tk.SPECIAL_IDS["<|endoftext|>"])).cast("long")
    rows = st.read_batches(t.spark, f"{base}/out").select("doc_id", F.size("tokens").cast("long").alias("n"), pads.alias("p"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_blocks"), F.sum(F.col("n") - F.col("p")).alias("n_tokens"), F.sum("p").alias("n_pad")
    )


@query("streamed_examples", "STR-3", f"""select o_orderkey, '[' || {gq.rev('a')} || '] + [' || {gq.rev('b')} || '] = ['
  || {gq.rev('a + b')} || ']' line from (select o_orderkey, {gq.number_sql('a')} a, {gq.number_sql('b')} b from orders)""")
def streamed_examples(t):
    base = run_dir(t.spark, "examples")
    a, b = (g.variable_width_number(4, F.lit(tag), "o_orderkey") for tag in "ab")
    rows = stream(t, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    st.catch_up(rows.select("o_orderkey", g.addition_text(F.col("a"), F.col("b")).alias("line")), f"{base}/out", f"{base}/offsets")
    return st.read_batches(t.spark, f"{base}/out")
