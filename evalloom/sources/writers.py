"""Sinks: archives, token shards, rendered prompts and packaged n-gram buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators import buckets as bk
from evalloom.operators import runs as rn
from evalloom.session import run_dir
from evalloom.sources import zstd_lines


def new_folder(spark: SparkSession, label: str) -> str:
    return run_dir(spark, label)


def write_archive(docs: DataFrame, text: str, meta: list[str], folder: str, codec: str = "gzip") -> str:
    """Compressed JSON-lines archive of ``{text, meta}``."""
    fields = [x for c in meta for x in (F.lit(c), F.col(c).cast("string"))]
    rows = docs.select(F.col(text).alias("text"), F.create_map(*fields).alias("meta"))
    rows.write.mode("errorifexists").option("compression", codec).json(folder)
    return folder


def write_zstd_archive(docs: DataFrame, text: str, meta: list[str], folder: str, **options) -> str:
    """Archive of ``{text, meta}`` lines in zstandard frames that several tasks can read; appends to ``folder``."""
    zstd_lines.register(docs.sparkSession)
    fields = [x for c in meta for x in (F.lit(c), F.col(c).cast("string"))]
    lines = docs.select(F.to_json(F.struct(F.col(text).alias("text"), F.create_map(*fields).alias("meta"))).alias("value"))
    lines.write.format("zstd_lines").mode("append").options(**options).save(folder)
    return folder


def write_json_lines(df: DataFrame, folder: str) -> str:
    df.write.mode("errorifexists").json(folder)
    return folder


def write_token_shards(blocks: DataFrame, folder: str, dealt: bool = False) -> str:
    """Blocks laid out as ``split=/shard=``; a shard is a bounded run of blocks, sorted by block. ``dealt`` blocks lie together by shard already."""
    rows = blocks if dealt else blocks.repartitionByRange("split", "shard", "block_id")
    (
        rows.sortWithinPartitions("split", "shard", "block_id")
        .write.mode("errorifexists")
        .partitionBy("split", "shard")
        .parquet(folder)
    )
    return folder


def write_matrix(rows: DataFrame, folder: str, variant: str, tokens: str = "tokens", mask: str = "context_mask",
                 split: str = "split") -> str:
    """Row-aligned ids and masks under ``variant=/split=`` plus a one-row-per-split meta table."""
    named = rows.withColumn("variant", F.lit(variant))
    named.write.mode("errorifexists").partitionBy("variant", split).parquet(f"{folder}/rows")
    meta = named.groupBy("variant", split).agg(
        F.count("*").alias("num_examples"),
        F.max(F.size(tokens)).alias("seq_len"),
        F.min(F.size(mask)).alias("mask_len"),
    )
    meta.write.mode("errorifexists").parquet(f"{folder}/meta")
    return folder


# Fixed value: the line before each rendered example.
DIVIDER = "!!@@##@@!! -- Example "


def rendered_examples(prompts: DataFrame, task: str, key: str, prompt: str, n: int) -> DataFrame:
    """First ``n`` prompts per task, each after a divider line with its number."""
    rank = F.row_number().over(W.partitionBy(task).orderBy(key))
    numbered = prompts.withColumn("_r", rank).where(F.col("_r") <= n).withColumn("_pos", F.col("_r").cast("long") - 1)
    return numbered.select(
        task, F.col("_pos").alias("example"),
        F.concat(F.lit(DIVIDER), F.col("_pos").cast("string"), F.lit("\n"), F.col(prompt), F.lit("\n")).alias("block"),
    )


def write_examples(examples: DataFrame, folder: str, task: str) -> str:
    (
        examples.repartitionByRange(task, "example")
        .sortWithinPartitions(task, "example")
        .select(task, "block")
        .write.mode("errorifexists")
        .partitionBy(task)
        .text(folder)
    )
    return folder


def write_ngram_package(sorted_postings: DataFrame, folder: str, n: int) -> str:
    """Compressed, sorted buckets and an info row with the true n-gram size."""
    sorted_postings.write.mode("errorifexists").option("compression", "zstd").partitionBy("bucket").parquet(
        f"{folder}/buckets"
    )
    info = sorted_postings.sparkSession.range(1).select(F.lit("dataset ngrams").alias("title"), F.lit(n).alias("ngram_size"))
    info.coalesce(1).write.mode("errorifexists").json(f"{folder}/info")
    return folder


def write_marked_package(runs: DataFrame, folder: str, n: int, buckets: int) -> str:
    """Package of the n-grams of ``runs`` in compressed buckets by mark, sorted by mark and n-gram, with the info row; the table of its buckets.

    Runs are dealt and spelled out afterwards, so an n-gram is not moved word by word.
    """
    table = bk.write_bucketed(
        runs, "package", buckets, "mark", ("ngram", "doc_id"), f"{folder}/buckets", lambda dealt: rn.spelled(dealt, n), compression="zstd"
    )
    info = runs.sparkSession.range(1).select(F.lit("dataset ngrams").alias("title"), F.lit(n).alias("ngram_size"))
    info.coalesce(1).write.mode("errorifexists").json(f"{folder}/info")
    return table
