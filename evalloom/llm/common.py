"""Words, row keys and table access shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# a word is a run of anything but the six ASCII white-space characters
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], *bases: str) -> list[str]:
    """A name for each of ``bases`` that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for base in bases:
        name = f"_{base}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def word_count(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column | str) -> Column:
    """64-bit identity of a text, so that rows sharing an id but not a text stay apart; null has its own value."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(text, text.isNull())


def matched_rows(docs: DataFrame, decided: DataFrame, doc_id: str, text: str, how: str, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id and text are (``how`` is ``left_semi``) or are not (``left_anti``) in ``decided`` (``doc_id, text_key``).

    All columns are kept, whatever their names. With ``once``, repeated rows of one id and text leave one of them.
    """
    mine, key, other, other_key = fresh(docs.columns, "id", "key", "other_id", "other_key")
    keyed = docs.select("*", column(doc_id).cast("long").alias(mine), text_key(column(text)).alias(key))
    listed = decided.select(F.col("doc_id").alias(other), F.col("text_key").alias(other_key)).distinct()
    out = keyed.join(listed, F.col(mine).eqNullSafe(F.col(other)) & (F.col(key) == F.col(other_key)), how)
    return (out.dropDuplicates([mine, key]) if once else out).drop(mine, key)


# rows of a lookup table of short strings and numbers that may be broadcast: at most some ten MB
LOOKUP_ROWS = 50_000
SALTS = 32


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: Column, limit: int = LOOKUP_ROWS,
                how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``lookup`` (one row per ``key``, nulls equal, cheap to count) added.

    The lookup is broadcast after it was counted. A larger one is joined on ``key`` and a salt, so that a key of a third of the
    rows is spread over ``SALTS`` tasks at least.
    """
    other = lookup.withColumnRenamed(key, "_lookup_key")
    same = F.col(key).eqNullSafe(F.col("_lookup_key"))
    if lookup.count() <= limit:
        return rows.join(F.broadcast(other), same, how).drop("_lookup_key")
    salted = other.withColumn("_lookup_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(salted, same & (F.col("_salt") == F.col("_lookup_salt")), how)
        .drop("_lookup_key", "_lookup_salt", "_salt")
    )


def uniform(key: Column | str, seed: int) -> Column:
    """Number in (0, 1) drawn from the key: 52 bits of an MD5, so any engine can recompute it; null draws like ``''``."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def held_out(doc_id: Column | str) -> Column:
    """True for the quarter of ids that is kept for testing; false for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
