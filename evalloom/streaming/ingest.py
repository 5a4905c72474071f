"""Incremental forms of the corpus jobs: file streams that stop when caught up and continue where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import tokens as tk
from evalloom.operators.decontam import NGRAM, with_bucket
from evalloom.operators.runs import ngram_runs, repeated_ngrams, spelled


def file_stream(spark: SparkSession, folder: str, schema, only: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; ``only`` is a pattern of entries of the folder, each a file or a folder of files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if only:
        # a stream takes a single file only by a pattern, and a name without signs is made one
        folder = f"{folder}/{only if set(only) & set('*?[{') else f'{only[:-1]}[{only[-1]}]'}"
    return reader.parquet(folder)


def catch_up(stream: DataFrame, out: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None,
             partition_by: list[str] | None = None, **options) -> int:
    """Process everything new, then stop; returns the number of rows read. ``options`` are those of the writer.

    Each micro-batch goes to its own ``batch=`` folder and overwrites it, so a batch that is run again after a failure
    leaves the same files. The offsets live in ``checkpoint``, which belongs in shared storage.
    """
    def write(batch: DataFrame, number: int) -> None:
        note()
        shaped = shape(batch) if shape else batch
        shaped.write.mode("overwrite").partitionBy(*(partition_by or [])).options(**options).parquet(f"{out}/batch={number}")

    started, rows = [], {}

    def note() -> None:
        """Take over the progress records; only the last ones are kept by the query."""
        for query in started:
            rows.update({p["batchId"]: p["numInputRows"] for p in query.recentProgress if p["numInputRows"]})

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.append(query)
    query.awaitTermination()
    note()
    return sum(rows.values())


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """Rows of all batches; n-grams that :func:`ingest_ngrams` wrote are spelled out."""
    rows = written(spark, out)
    return spelled_batches(rows) if {"bucket", "words", "n"} <= set(rows.columns) else rows


def written(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def words_per_ngram(runs: DataFrame) -> int | None:
    """The one value of ``n``, None without runs."""
    least, most = runs.agg(F.min("n"), F.max("n")).first()
    if least != most:
        raise ValueError(f"n-grams of {least} and of {most} words in one folder")
    return least


def spelled_batches(runs: DataFrame) -> DataFrame:
    return spelled(runs.drop("n"), words_per_ngram(runs) or NGRAM)


def repeated_in_batches(spark: SparkSession, out: str, more_than: int = 1) -> DataFrame:
    """``ngram, n`` of the n-grams that stand more than ``more_than`` times in all batches of :func:`ingest_ngrams`, with how often."""
    runs = written(spark, out)
    return repeated_ngrams(runs, words_per_ngram(runs) or NGRAM, more_than)


def ingest_ngrams(docs: DataFrame, out: str, checkpoint: str, n: int = NGRAM, buckets: int = 64) -> int:
    """N-gram postings of new documents, kept as runs of words, hash-bucketed by mark and sorted inside a bucket's files.

    All occurrences of an n-gram are in one bucket. A task writes the runs of its own documents, so nothing is dealt and no word is
    written ``n`` times; :func:`read_batches` spells the postings out.
    """
    def by_bucket(batch: DataFrame) -> DataFrame:
        return batch.sortWithinPartitions("bucket", "words", "doc_id")

    runs = with_bucket(ngram_runs(docs, n, distinct=False), buckets, F.col("mark")).drop("mark").withColumn("n", F.lit(n))
    return catch_up(runs, out, checkpoint, by_bucket, ["bucket"], compression="zstd")


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Wrapped byte tokens of raw text, row by row, so it runs on a stream or a table alike."""
    return docs.select(key, tk.wrap(tk.byte_tokens(text)).alias("tokens"))


def padded_blocks(docs: DataFrame, length: int, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Each document in its own padded blocks of ``length`` tokens: ``key, block, tokens``; no state between rows."""
    n = F.size(tokens)
    last = F.floor((n - 1) / length).cast("int")
    blocks = docs.select(key, tokens, F.explode(F.sequence(F.lit(0), last)).alias("block"))
    piece = F.slice(tokens, F.col("block") * length + 1, F.lit(length))
    return blocks.select(key, "block", piece.alias("piece")).select(key, "block", tk.pad(F.col("piece"), length).alias("tokens"))
