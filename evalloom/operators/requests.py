"""Documents to requests, and responses back to documents; joins between runs and models."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import ends_with_space


def choice_requests(docs: DataFrame, keys: list[str], context: str, choices: str, delimiter: str = " ",
                    prefix: str = "") -> DataFrame:
    """One likelihood request per (document, choice): ``keys, idx, request_type, ctx, continuation``.

    The delimiter is left out after a generation prefix that ends in white space.
    """
    joined = F.concat(F.lit(delimiter), F.col("choice"))
    bare = ends_with_space(F.lit(prefix)) if prefix else F.lit(False)
    return docs.select(*keys, F.col(context).alias("_c"), F.posexplode(choices).alias("idx", "choice")).select(
        *keys, "idx", F.lit("loglikelihood").alias("request_type"),
        F.concat(F.col("_c"), F.lit(prefix)).alias("ctx"),
        F.when(bare, F.col("choice")).otherwise(joined).alias("continuation"),
    )


def with_unconditional(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Append the same continuations without context; their ``idx`` follows the conditional block."""
    both = F.array(
        F.struct(F.lit("conditional").alias("kind"), F.col("ctx").alias("c"), F.lit(0).alias("block")),
        F.struct(F.lit("unconditional").alias("kind"), F.lit("").alias("c"), F.lit(1).alias("block")),
    )
    width = F.col("n_choices")
    return (
        requests.withColumn("_k", F.explode(both))
        .withColumn("kind", F.col("_k.kind"))
        .withColumn("ctx", F.col("_k.c"))
        .withColumn("idx", F.col("idx") + F.col("_k.block") * width)
        .drop("_k")
    )


def repeated(requests: DataFrame, times: int) -> DataFrame:
    """Each request ``times`` times, numbered by ``repeat`` from 0."""
    return requests.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def generation_and_likelihood(docs: DataFrame, keys: list[str], context: str, continuation: str) -> DataFrame:
    """Two requests per document from one pass: generate until a line end, and the likelihood of a fixed continuation."""
    kinds = F.array(
        F.struct(F.lit("generate_until").alias("request_type"), F.lit(None).cast("string").alias("continuation")),
        F.struct(F.lit("loglikelihood").alias("request_type"), F.lit(continuation).alias("continuation")),
    )
    return docs.select(*keys, F.col(context).alias("ctx"), F.explode(kinds).alias("r")).select(
        *keys, "ctx", "r.request_type", "r.continuation"
    )


def gather_responses(responses: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Responses back in request order: ``keys, resps`` ordered by ``idx`` and ``repeat``."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "repeat", value)))
    return responses.groupBy(*keys).agg(ordered.alias("_r")).select(*keys, F.col("_r")[value].alias("resps"))


def merge_runs(runs: DataFrame, keys: list[str], run: str, value: str, run_ids: list) -> DataFrame:
    """Inner merge of many runs on ``keys``: one column ``run_<id>`` each, rows present in every run.

    One pivot aggregate instead of a chain of joins; ``keys`` must be unique inside a run.
    """
    seen = [F.count_if(F.col(run) == r).alias(f"_n{r}") for r in run_ids]
    values = [F.max(F.when(F.col(run) == r, F.col(value))).alias(f"run_{r}") for r in run_ids]
    merged = runs.where(F.col(run).isin(*run_ids)).groupBy(*keys).agg(*seen, *values)
    counts = F.array(*[F.col(f"_n{r}") for r in run_ids])
    unique = F.assert_true(F.array_max(counts) <= 1, "keys are not unique inside a run")
    return merged.where(unique.isNull() & (F.array_min(counts) == 1)).select(*keys, *[f"run_{r}" for r in run_ids])


def paired(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Two models side by side; a task of only one of them is an error."""
    a = first.select(*on, F.struct(*[c for c in first.columns if c not in on]).alias("a"))
    b = second.select(*on, F.struct(*[c for c in second.columns if c not in on]).alias("b"))
    both = F.assert_true(F.col("a").isNotNull() & F.col("b").isNotNull(), "models have different task sets")
    return a.join(b, on, "full_outer").withColumn("_ok", both).where("_ok is null").drop("_ok")


def against_baseline(baseline: DataFrame, branch: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer join with missing values as 0 and the difference."""
    a = baseline.select(*on, F.col(value).alias("_a"))
    b = branch.select(*on, F.col(value).alias("_b"))
    base, other = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return a.join(b, on, "full_outer").select(
        *on, base.alias("baseline"), other.alias("branch"), (other - base).alias("diff")
    )


def common_tasks(results: DataFrame, model: str, task: str) -> DataFrame:
    """Tasks that every model has."""
    pairs = results.select(model, task).distinct()
    n_models = results.agg(F.count_distinct(model)).first()[0]
    return pairs.groupBy(task).agg(F.count("*").alias("_n")).where(F.col("_n") == n_models).select(task)


def best_over_references(references: Column, score) -> Column:
    """Highest score of a text metric over the references."""
    return F.array_max(F.transform(references, score))


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def materialised(spark: SparkSession, build, config: dict, base: str, mode: str = "reuse") -> DataFrame | None:
    """Requests stored under a hash of their configuration.

    ``reuse`` reads what is there or builds it, ``refresh`` always builds, ``delete`` removes it.
    """
    path = f"{base.rstrip('/')}/requests_{config_key(config)}"
    fs, place = _file_system(spark, path)
    if mode == "delete":
        fs.delete(place, True)
        return None
    done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))
    if mode == "refresh" or not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
