"""Few-shot sampling and context assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.text import stable_hash
from evalloom.operators.generate import STEP_PRIMES
from evalloom.operators.scale import lookup_sized, positions
from evalloom.session import cut_lineage

def content_positions(pool: DataFrame, key: str, content: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Seeded dense order of the pool in which equal contents are neighbours, as keys and positions only.

    Returns ``key, _pos`` and a table ``_h, _lo, _copies`` with the block of each content.
    """
    tagged = pool.select(key, stable_hash(F.lit(seed), content).alias("_h"))
    placed = cut_lineage(positions(tagged, ["_h", key], "_pos"))
    blocks = cut_lineage(placed.groupBy("_h").agg(F.min("_pos").alias("_lo"), F.count("*").alias("_copies")))
    return placed.drop("_h"), blocks


def random_shots(pool: DataFrame, evals: DataFrame, n: int, seed: int, pool_key: str, eval_key: str,
                 content: str) -> DataFrame:
    """``n`` pool rows per evaluation row, without replacement and never one whose content equals the evaluation row.

    ``eval_key, shot, <pool columns>``. Positions are probed by arithmetic (a hashed start and a prime step in the pool
    without the evaluation row's own block), so evaluation rows meet the pool in one equi-join, not a cross join.
    Fewer than ``n`` candidates is an error.
    """
    size = pool.count()
    placed, blocks = content_positions(pool, pool_key, content, seed)
    placed = placed.withColumnRenamed(pool_key, "_key")
    asked = evals.select(eval_key, stable_hash(F.lit(seed), content).alias("_h"))
    asked = lookup_sized(asked, blocks, ["_h"], F.col(eval_key), "left")
    lo, copies = F.coalesce("_lo", F.lit(0)), F.coalesce("_copies", F.lit(0))
    others = F.lit(size) - copies
    enough = F.assert_true(others >= n, f"fewer than {n} few-shot candidates")
    p, q = STEP_PRIMES
    step = F.when(others % p != 0, F.lit(p)).otherwise(F.lit(q))
    start = F.pmod(stable_hash(F.lit(seed), eval_key), F.greatest(others, F.lit(1)))
    probes = (
        asked.select(
            eval_key, (lo + copies).alias("_skip"), others.alias("_others"), step.alias("_step"), start.alias("_at"),
            enough.alias("_ok"),
        )
        .where("_ok is null")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shot") if n else F.lit(0).alias("shot"))
        .select(
            eval_key, "shot",
            F.pmod(F.col("_skip") + F.pmod(F.col("_at") + F.col("shot") * F.col("_step"), F.col("_others")), F.lit(size))
            .alias("_pos"),
        )
    )
    # numbers meet numbers; the pool's columns come last, by its key
    chosen = probes.join(placed, "_pos").drop("_pos")
    return chosen.join(pool, chosen["_key"] == pool[pool_key]).drop("_key")


def first_shots(pool: DataFrame, n: int, key: str, group: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (per group) in canonical order, with ``shot`` from 0. Only ``n`` rows per group are shuffled."""
    if not group:
        return positions(pool.orderBy(key).limit(n), key, "shot")
    rank = F.row_number().over(W.partitionBy(*group).orderBy(key))
    return pool.withColumn("_r", rank).where(F.col("_r") <= n).withColumn("shot", F.col("_r").cast("long") - 1).drop("_r")


def indexed_shots(pool: DataFrame, indices: list[int], key: str) -> DataFrame:
    """Rows at fixed 0-based positions, with ``shot`` in the order of the list."""
    wanted = F.map_from_arrays(
        F.array(*[F.lit(i).cast("long") for i in indices]), F.sequence(F.lit(0), F.lit(len(indices) - 1))
    )
    return (
        positions(pool, key, "_pos").where(F.col("_pos").isin(*indices))
        .withColumn("shot", F.try_element_at(wanted, F.col("_pos")))
    )


def without_document(pool: DataFrame, content: str, document: str, key: str, n: int | None = None) -> DataFrame:
    """Pool without rows equal to one document; optionally only the first ``n`` left, in key order."""
    rest = pool.where(~F.col(content).eqNullSafe(F.lit(document)))
    return rest if n is None else rest.orderBy(key).limit(n)


def assemble_context(shots: DataFrame, evals: DataFrame, eval_key: str, question: str, shot_text: str, description: str,
                     delimiter: str = "\n\n") -> DataFrame:
    """``eval_key, context``: description, the shots in order and the question, joined by the delimiter.

    A prompt is one cell: the few shots of one evaluation row are gathered, never more.
    """
    lists = shots.groupBy(eval_key).agg(F.array_sort(F.collect_list(F.struct("shot", shot_text))).alias("_s"))
    joined = evals.join(lists, eval_key, "left")
    parts = F.concat(
        F.coalesce(F.transform("_s", lambda s: s[shot_text]), F.array().cast("array<string>")), F.array(F.col(question))
    )
    return joined.select(eval_key, F.concat(F.lit(description), F.array_join(parts, delimiter)).alias("context"))


def assemble_messages(shots: DataFrame, evals: DataFrame, eval_key: str, question: str, shot_question: str, shot_answer: str,
                      description: str = "") -> DataFrame:
    """``eval_key, messages``: the few-shot context as chat turns, an array of ``struct<role, content>``.

    A system turn with the description (when there is one), a user and an assistant turn per shot, and the question as the last
    user turn.
    """
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    lists = shots.groupBy(eval_key).agg(F.array_sort(F.collect_list(F.struct("shot", shot_question, shot_answer))).alias("_s"))
    joined = evals.join(lists, eval_key, "left")
    pairs = F.transform("_s", lambda s: F.array(turn("user", s[shot_question]), turn("assistant", s[shot_answer])))
    none = F.slice(F.array(turn("user", F.lit(""))), F.lit(1), F.lit(0))
    system = F.array(turn("system", F.lit(description))) if description else none
    return joined.select(
        eval_key,
        F.concat(system, F.coalesce(F.flatten(pairs), none), F.array(turn("user", F.col(question)))).alias("messages"),
    )


def single_turn(messages: Column) -> Column:
    """Chat turns collapsed into one user turn: the contents joined by blank lines, a system turn first on its own."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    rest = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: m["content"]), "\n\n")
    return F.concat(system, F.array(F.struct(F.lit("user").alias("role"), rest.alias("content"))))


Sampler = Callable[..., DataFrame]
SAMPLERS: dict[str, Sampler] = {
    "default": random_shots,
    "first_n": first_shots,
    "indices": indexed_shots,
}


def register_sampler(name: str):
    """Make a function ``(pool, ...) -> DataFrame`` available under ``name``."""
    def add(fn: Sampler) -> Sampler:
        if name in SAMPLERS:
            raise ValueError(f"sampler {name} registered twice")
        SAMPLERS[name] = fn
        return fn

    return add


def seeded(seed: int) -> Column:
    """Seed column to keep with the results."""
    return F.lit(seed).cast("long").alias("seed")
