"""Mix sources to target weights: Efraimidis-Spirakis keys, prefix sums inside a source, complete epochs first.

Everything is DataFrame functions. A source of any size is cut into about sqrt(rows) buckets of equal expected mass along
its keys, so that the running total of a source needs one window over bucket totals and one window inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.llm.common import LOOKUP_ROWS, SPACE, column, fresh, join_lookup, table, text_key, uniform, word_count
from evalloom.session import cut_lineage

WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # of all words, to be shared out
CAP = 2  # times its own words that a source may give
SEED = 20
# quality weights by the share of characters that are neither letters nor white space
QUALITY_STEPS = ((0.05, 1.0), (0.15, 0.75), (0.30, 0.5))
LOWEST_QUALITY = 0.25
QUALITY_CLASSES = (LOWEST_QUALITY, *sorted(w for _, w in QUALITY_STEPS))


def quality_weight(text: Column | str) -> Column:
    """One of ``QUALITY_CLASSES``: 1 for prose, less the more characters are symbols; null and empty texts get the lowest."""
    text = F.col(text) if isinstance(text, str) else text
    odd = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", "")) / F.length(text)
    weight = F.lit(LOWEST_QUALITY)
    for limit, value in reversed(QUALITY_STEPS):
        weight = F.when(odd < limit, F.lit(value)).otherwise(weight)
    return F.when(F.length(text) > 0, weight).otherwise(F.lit(LOWEST_QUALITY))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Target words of each source: ``source, source_size`` gain ``sid`` and ``target``.

    ``share`` of all words is dealt by weight, no source beyond ``cap`` times its size, the excess dealt again to the others.
    The fixed point is ``least(cap * size, level * weight)``. With sources ordered by ``cap * size / weight``, the level that
    spends everything when the earlier ones are capped rises up to the fixed point and falls after it, so it is the largest.
    One row per source goes through these windows, never one per document. Sources of no words get 0.
    """
    listed = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = listed.withColumn("_w", F.get(pattern, ((F.col("sid") - 1) % len(weights)).cast("int")))
    by_ratio = W.orderBy(cap * F.col("source_size") / F.col("_w"), "sid")
    capped = F.coalesce(
        F.sum(cap * F.col("source_size")).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    ).cast("double")
    open_weight = F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    levels = weighed.withColumn("_level", (share * total - capped) / open_weight)
    level = F.max("_level").over(everything)
    target = F.least((cap * F.col("source_size")).cast("double"), level * F.col("_w"))
    return levels.withColumn("target", target).select("sid", "source", "source_size", "target")


def sized_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    seed: int = SEED) -> DataFrame:
    """The narrow table that is sampled: ``doc_id, text_key, source, size, weight, key``, without texts.

    ``key`` is an exponential draw divided by the quality weight: ordered by it, documents come out as in weighted sampling
    without replacement. Equal draws (a repeated id) are ordered by id and text.
    """
    weight = quality_weight(text)
    return docs.select(
        column(doc_id).cast("long").alias("doc_id"),
        text_key(column(text)).alias("text_key"),
        column(source).cast("string").alias("source"),
        word_count(text).alias("size"),
        weight.alias("weight"),
        (-F.log(uniform(doc_id, seed)) / weight).alias("key"),
    )


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP,
                doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED,
                lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Words that a mixture takes from each document: ``doc_id, text_key, source, size, source_size, target, taken``.

    A source first gives ``floor(target / size)`` complete epochs, then documents in key order until its target is met; the
    document that crosses the target gives its first words. So a source's words equal its target rounded down.

    One row per input row. Null ids draw like an empty id, null sources are one source (the last), null and empty texts have
    size 0 and give 0; repeated rows are sampled one by one; an empty table gives no row. Only the three named columns are
    read, so other columns may have any name.
    """
    sized = cut_lineage(sized_documents(docs, doc_id, text, source, seed))
    classes = [F.count_if(F.col("weight") == w).alias(f"_n{i}") for i, w in enumerate(QUALITY_CLASSES)]
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"), *classes)
    stats = cut_lineage(stats)
    targets = source_targets(stats.select("source", "source_size"), weights, share, cap)
    targets = targets.withColumnRenamed("source", "_source").withColumnRenamed("source_size", "_size")
    joined = stats.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = joined.withColumn("_epochs", epochs.cast("long")).withColumn(
        "_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long")
    )

    # share of the source's rows expected below a key: uniform over the rows whatever the mix of weights
    below = F.lit(0.0)
    for i, w in enumerate(QUALITY_CLASSES):
        below = below + F.col(f"_n{i}") * -F.expm1(-w * F.col("key"))
    buckets = F.ceil(F.sqrt(F.col("_rows")))
    bucket = F.floor(below / F.col("_rows") * buckets).cast("long")
    placed = join_lookup(sized, cut_lineage(plan), "source", F.struct("doc_id", "text_key"), lookup_rows).select(
        "doc_id", "text_key", "source", "size", "key", "source_size", "target", "_epochs", "_rest", "sid",
        bucket.alias("_bucket"),
    )
    totals = placed.groupBy("sid", "_bucket").agg(F.sum("size").alias("_words"))
    before = (W.unboundedPreceding, -1)
    along = W.partitionBy("sid").orderBy("_bucket").rowsBetween(*before)
    bases = totals.select("sid", "_bucket", F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_base"))
    inside = W.partitionBy("sid", "_bucket").orderBy("key", "doc_id", "text_key").rowsBetween(*before)
    start = F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - start))
    return placed.join(bases, ["sid", "_bucket"]).select(
        "doc_id", "text_key", "source", "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture: rows of ``docs`` that give words, with ``mix_size`` and ``mix_taken`` added.

    Rows with the same id and text share one decision if they draw alike, so their words are summed over the repeats and
    each row carries the mean of its repeats rounded down. Columns of these two names are replaced; others are kept, whatever their names.
    """
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    kept = [c for c in docs.columns if c.lower() not in ("mix_size", "mix_taken")]
    mine, key, other, other_key = fresh([*docs.columns, "mix_size", "mix_taken"], "id", "key", "other_id", "other_key")
    chosen = (
        mix_sources(docs, **options)
        .groupBy(F.col("doc_id").alias(other), F.col("text_key").alias(other_key))
        .agg(
            F.max("size").alias("mix_size"),
            F.floor(F.sum("taken") / F.count("*")).cast("long").alias("mix_taken"),
        )
        .where("mix_taken > 0")
    )
    columns = [column(c) for c in kept]
    keyed = docs.select(*columns, column(doc_id).cast("long").alias(mine), text_key(column(text)).alias(key))
    same = F.col(mine).eqNullSafe(F.col(other)) & (F.col(key) == F.col(other_key))
    return keyed.join(chosen, same).select(*columns, "mix_size", "mix_taken")


def words_taken(text: Column | str, size: Column | str, taken: Column | str) -> Column:
    """The text as often as ``taken`` says: whole copies, then the first words of one more; an array of texts."""
    text, size, taken = (F.col(c) if isinstance(c, str) else c for c in (text, size, taken))
    whole = F.array_repeat(text, F.floor(taken / size).cast("int"))
    rest = (taken % size).cast("int")
    head = F.array_join(F.slice(F.filter(F.split(text, SPACE), lambda w: w != ""), F.lit(1), rest), " ")
    return F.when(size > 0, F.when(rest > 0, F.concat(whole, F.array(head))).otherwise(whole)).otherwise(F.array())


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN length(text) > 0 THEN
           CASE WHEN odd < 0.05 THEN 1.0 WHEN odd < 0.15 THEN 0.75 WHEN odd < 0.30 THEN 0.5 ELSE 0.25 END
         ELSE 0.25 END::DOUBLE AS weight
  FROM (SELECT *, length(regexp_replace(text, '[\pL\x20\x09-\x0D]+', '', 'g'))::DOUBLE / length(text) AS odd FROM documents)),
keyed AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
                 AS DOUBLE) + 0.5) / 4503599627370496.0) / weight AS key
  FROM sized),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
listed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes),
weighed AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM listed),
levels AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, sid
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / sum(w) OVER (ORDER BY 2 * source_size / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * w) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
runs AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
         CAST(floor(p.target - p.epochs * p.source_size) AS BIGINT) AS rest,
         CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken
FROM runs
"""


def op2_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
