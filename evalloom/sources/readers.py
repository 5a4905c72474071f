"""Scans: text archives, n-gram files, result files and sample logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.text import let
from evalloom.operators.scale import lookup_sized, positions
from evalloom.session import cut_lineage
from evalloom.sources import zstd_lines

SAMPLE_LOG = (
    "task string, model string, doc_id bigint, doc map<string,string>, target string, resps array<array<string>>, "
    "filtered_resps array<string>, filter string, metrics map<string,double>, doc_hash string, prompt_hash string, "
    "target_hash string"
)


def parse_archive_line(line: Column, joiner: str = "\n\n") -> Column:
    """``struct<text, meta>`` of one archive line: an object with text (string or list) and meta, or a bare string.

    The line is parsed once; nested meta is kept as JSON. Lines that are not JSON, or repeat a key, have a null text and no meta.
    """
    empty = F.create_map().cast("map<string,string>")

    def fields(v: Column) -> Column:
        listed = F.try_variant_get(v, "$.text", "array<string>")
        text = F.coalesce(F.array_join(listed, joiner), F.try_variant_get(v, "$.text", "string"))
        is_object = F.startswith(F.ltrim(line), F.lit("{"))
        return F.struct(
            F.when(is_object, text).otherwise(F.try_variant_get(v, "$", "string")).alias("text"),
            F.coalesce(F.when(is_object, F.try_variant_get(v, "$.meta", "map<string,string>")), empty).alias("meta"),
        )

    return let(F.try_parse_json(line), fields)


def read_archive(spark: SparkSession, path: str, joiner: str = "\n\n") -> DataFrame:
    """JSON-lines archive (any codec Spark's text reader knows): ``text, meta``."""
    return spark.read.text(path).select(parse_archive_line(F.col("value"), joiner).alias("d")).select("d.*")


def read_zstd_archive(spark: SparkSession, path: str, joiner: str = "\n\n", **options) -> DataFrame:
    """JSON-lines archive in zstandard frames, several tasks to a file: ``text, meta``."""
    zstd_lines.register(spark)
    lines = spark.read.format("zstd_lines").options(**options).load(path)
    return lines.select(parse_archive_line(F.col("value"), joiner).alias("d")).select("d.*")


def split_posting(line: Column) -> Column:
    """``struct<ngram, doc_id>`` of an ``"ngram doc_id"`` line, split at the last space."""
    return F.struct(
        F.regexp_extract(line, r"\A(.*) (\S+)\z", 1).alias("ngram"),
        F.regexp_extract(line, r"\A(.*) (\S+)\z", 2).cast("long").alias("doc_id"),
    )


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(split_posting(F.col("value")).alias("p")).select("p.*")


def file_statistics(docs: DataFrame, file: str, text: str) -> DataFrame:
    """Per file: documents, characters and the exclusive running document count by file name."""
    stats = docs.groupBy(file).agg(F.count("*").alias("n_docs"), F.sum(F.length(text)).alias("n_chars"))
    before = F.sum("n_docs").over(W.orderBy(file).rowsBetween(W.unboundedPreceding, -1))
    return stats.withColumn("start_offset", F.coalesce(before, F.lit(0)))


def global_offsets(docs: DataFrame, file: str, row: str, out: str = "offset") -> DataFrame:
    """Document number over all files in name order: position in the file plus the file's start offset."""
    counts = docs.groupBy(file).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(file).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(file, F.coalesce(before, F.lit(0)).alias("_start"))
    placed = positions(docs, row, "_pos", [file])
    joined = lookup_sized(placed, starts, [file], F.col(row))
    return joined.withColumn(out, F.col("_start") + F.col("_pos")).drop("_start", "_pos")


def bind_split(spark: SparkSession, path: str, **partition: str) -> DataFrame:
    """Dataset folder narrowed to one subset/split; equality on partition columns prunes the scan."""
    df = spark.read.parquet(path)
    for name, value in partition.items():
        df = df.where(F.col(name) == value)
    return df


def read_sample_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_LOG).json(path)


def melt_results(results: DataFrame, keys: list[str], metrics: str = "metrics") -> DataFrame:
    """``"metric,filter"`` / ``"metric_stderr,filter"`` maps to rows ``keys, metric, filter, value, stderr``."""
    long = results.select(*keys, F.explode(metrics).alias("k", "v")).select(
        *keys,
        F.regexp_replace(F.split_part("k", F.lit(","), F.lit(1)), r"_stderr\z", "").alias("metric"),
        F.split_part("k", F.lit(","), F.lit(2)).alias("filter"),
        F.endswith(F.split_part("k", F.lit(","), F.lit(1)), F.lit("_stderr")).alias("is_stderr"),
        "v",
    )
    return long.groupBy(*keys, "metric", "filter").agg(
        F.max(F.when(~F.col("is_stderr"), F.col("v"))).alias("value"),
        F.max(F.when(F.col("is_stderr"), F.col("v"))).alias("stderr"),
    )


def latest(files: DataFrame, group: list[str], stamp: str) -> DataFrame:
    """Newest row per group; one map-side combined aggregate, no sort."""
    rest = [c for c in files.columns if c not in group]
    return files.groupBy(*group).agg(F.max_by(F.struct(*rest), F.col(stamp)).alias("_r")).select(*group, "_r.*")


def limit_per_task(docs: DataFrame, task: str, key: str, limit: int | float) -> DataFrame:
    """First ``limit`` documents of each task (a whole number), or that fraction of them rounded up.

    Adds ``original`` and ``effective`` counts. ``key`` is the document number. A whole number is a rank that Spark cuts in every
    partition before rows move; for a fraction the last key to keep is found first, on keys alone, and then filters the documents.
    """
    sizes = docs.groupBy(task).agg(F.count("*").alias("original"))
    cap = F.ceil(F.col("original") * F.lit(float(limit))) if isinstance(limit, float) else F.lit(limit)
    sizes = sizes.withColumn("effective", F.least(F.col("original"), cap.cast("long")))
    if not isinstance(limit, float):
        rank = F.row_number().over(W.partitionBy(task).orderBy(key))
        kept = docs.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")
        return lookup_sized(kept, sizes, [task], F.col(key))
    placed = lookup_sized(positions(docs.select(task, key), key, "_pos", [task]), sizes, [task], F.col(key))
    cuts = cut_lineage(placed.where("_pos < effective").groupBy(task, "original", "effective").agg(F.max(key).alias("_last")))
    return lookup_sized(docs, cuts, [task], F.col(key)).where(F.col(key) <= F.col("_last")).drop("_last")


def first_fraction(docs: DataFrame, key: str, fraction: float) -> DataFrame:
    """Leading ``floor(fraction * n)`` rows in key order: the last key to keep is found on keys alone."""
    keep = int(fraction * docs.count())
    if not keep:
        return docs.limit(0)
    last = positions(docs.select(key), key, "_pos").where(F.col("_pos") == keep - 1).first()[key]
    return docs.where(F.col(key) <= F.lit(last))


def keep_buckets(docs: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose bucket is allowed (all rows when nothing is listed); the column must exist."""
    if column not in docs.columns:
        raise ValueError(f"column {column} not found")
    return docs.where(F.col(column).isin(*allowed)) if allowed else docs


def resolve_catalogue(entries: DataFrame, name: str = "name", path: str = "path_no", file: str = "file") -> DataFrame:
    """One definition per name: later paths override earlier ones, within a path the first file wins."""
    rank = W.partitionBy(name).orderBy(F.col(path).desc(), F.col(file))
    return entries.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")
