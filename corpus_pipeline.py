"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination and mixing, in this order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalloom.llm.common import table
from evalloom.llm.contamination import drop_contaminated
from evalloom.llm.line_dedup import dedup_lines
from evalloom.llm.mixing import mixed_documents
from evalloom.llm.near_copies import drop_similar
from evalloom.llm.toxicity import drop_toxic
from evalloom.session import run_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line passages; ``n_chars`` follows the text. Documents left empty stay."""
    cut = dedup_lines(docs)
    return cut.selectExpr(
        *[
            "CASE WHEN n_removed_lines > 0 THEN length(text) ELSE n_chars END AS n_chars" if c == "n_chars" else f"`{c}`"
            for c in docs.columns
        ]
    )


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, texts that share 0.8 of their five-word runs: the one of smallest id."""
    return drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with ``mix_size`` words and the ``mix_taken`` words that the mixture takes of them."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# a trained classifier and min-hash candidates have no SQL; the tests run every stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = run_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
