"""Task hierarchies, group metrics and reports. Tables here have one row per task and metric."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.text import let
from evalloom.session import cut_lineage


def expand_hierarchy(edges: DataFrame) -> DataFrame:
    """Transitive closure of ``(parent, child, kind)``: ``ancestor, node, distance, is_leaf``.

    ``kind`` is ``group``, ``tag``, ``task`` or ``inline``; an inline child is named ``parent::child``. The frontier is
    joined with the edges level by level and kept, so a level costs one join whatever its depth. A cycle is an error.
    """
    named = edges.select(
        "parent", F.when(F.col("kind") == "inline", F.concat_ws("::", "parent", "child")).otherwise(F.col("child")).alias("child")
    ).distinct()
    parents = named.select(F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    frontier = named.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"))
    step, found = named.select(F.col("parent").alias("node"), "child"), None
    distance = 1
    while True:
        level = frontier.withColumn("distance", F.lit(distance))
        found = level if found is None else found.unionByName(level)
        frontier = cut_lineage(frontier.join(step, "node").select("ancestor", F.col("child").alias("node")).distinct())
        if frontier.isEmpty():
            break
        if not frontier.where("ancestor = node").isEmpty():
            raise ValueError("cyclic hierarchy")
        distance += 1
    shortest = found.groupBy("ancestor", "node").agg(F.min("distance").alias("distance"))
    return shortest.join(parents, "node", "left").select(
        "ancestor", "node", "distance", F.col("_inner").isNull().alias("is_leaf")
    )


def leaves(closure: DataFrame) -> DataFrame:
    return closure.where("is_leaf").select(F.col("ancestor").alias("group"), F.col("node").alias("task"))


def pooled_stderr(stderr: Column, n: Column) -> Column:
    """Standard error of the pooled sample from those of the parts."""
    spread = F.sum((n - 1) * F.pow(stderr, 2) * n)
    return F.sqrt(F.try_divide(F.try_divide(spread, F.sum(n) - F.count("*")), F.sum(n)))


def group_metrics(metrics: DataFrame, members: DataFrame, weight_by_size: bool = True,
                  filters: list[str] | None = None) -> DataFrame:
    """``group, metric, filter, value, stderr, n`` over all leaf tasks; every filter found unless some are listed."""
    rows = metrics if filters is None else metrics.where(F.col("filter").isin(*filters))
    joined = rows.join(members, "task")
    n = F.col("n")
    value = F.sum(F.col("value") * n) / F.sum("n") if weight_by_size else F.avg("value")
    return joined.groupBy("group", "metric", "filter").agg(
        value.alias("value"), pooled_stderr(F.col("stderr"), n).alias("stderr"), F.sum("n").alias("n")
    )


def group_report(metrics: DataFrame, members: DataFrame) -> DataFrame:
    """:func:`group_metrics` at two levels by one shuffle: per group, and over all groups (``group`` is null), per metric and filter.

    ``level`` is 0 for a group and 1 for the total. A task of several groups counts in each of them, and so often in the total.
    """
    joined = metrics.join(members, "task").select("group", "metric", "filter", "value", "stderr", "n")
    names = [F.col(c) for c in ("group", "metric", "filter")]
    n = F.col("n")
    report = joined.groupingSets([names, names[1:]], *names).agg(
        F.grouping("group").cast("int").alias("level"), (F.sum(F.col("value") * n) / F.sum("n")).alias("value"),
        pooled_stderr(F.col("stderr"), n).alias("stderr"), F.sum("n").alias("n"),
    )
    return report


def custom_group_metric(metrics: DataFrame, members: DataFrame, combine: Callable[[Column, Column], Column],
                        metric: str) -> DataFrame:
    """User aggregation of the children's values and sizes (arrays in task order), one row per group."""
    rows = metrics.where(F.col("metric") == metric).join(members, "task")
    lists = rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("task", "value", "n"))).alias("_c"))
    return lists.select("group", combine(F.col("_c.value"), F.col("_c.n")).alias("value"))


def metric_filters(metrics: DataFrame, members: DataFrame) -> DataFrame:
    """Metric and filter pairs that occur among a group's tasks."""
    return metrics.select("task", "metric", "filter").join(members, "task").select("group", "metric", "filter").distinct()


def claimed_twice(members: DataFrame) -> DataFrame:
    """Tasks that belong to more than one group."""
    return members.distinct().groupBy("task").agg(F.count("*").alias("n_groups")).where("n_groups > 1")


def difference(metrics: DataFrame, by: list[str], child: str, first, second, value: str = "value") -> DataFrame:
    """Value of one child minus value of another."""
    pick = lambda x: F.max(F.when(F.col(child) == x, F.col(value)))
    return metrics.groupBy(*by).agg((pick(first) - pick(second)).alias("difference"))


def resolve_overrides(overrides: DataFrame, closure: DataFrame) -> DataFrame:
    """Settings of every leaf: ``task, key, value`` from ``node, key, value``.

    A task's own entry wins; among groups the outermost one does, as the caller's settings take precedence.
    """
    own = overrides.select(F.col("node").alias("task"), "key", "value", F.lit(None).cast("int").alias("_rank"))
    inherited = closure.where("is_leaf").join(overrides.withColumnRenamed("node", "ancestor"), "ancestor").select(
        F.col("node").alias("task"), "key", "value", (-F.col("distance")).alias("_rank")
    )
    tasks = closure.where("is_leaf").select(F.col("node").alias("task")).distinct()
    best = own.join(tasks, "task", "left_semi").unionByName(inherited).groupBy("task", "key").agg(
        F.min_by("value", F.coalesce("_rank", F.lit(-(2**31)))).alias("value")
    )
    return best


def results_table(metrics: DataFrame, plain: tuple[str, ...] = ("ppl",)) -> DataFrame:
    """Printed rows: percent with two decimals (``plain`` metrics as they are), ``±`` and error, task named once."""
    scale = F.when(F.col("metric").isin(*plain), 1.0).otherwise(100.0)
    first = F.row_number().over(W.partitionBy("task").orderBy("metric", "filter")) == 1
    has = F.col("stderr").isNotNull()
    show = lambda c: F.format_string("%.2f", F.col(c) * scale)
    return metrics.select(
        F.when(first, F.col("task")).otherwise("").alias("shown_task"), "task", "metric", "filter",
        show("value").alias("shown"), F.when(has, "±").otherwise("").alias("sign"),
        F.when(has, show("stderr")).otherwise("").alias("error"),
    )


SERIES_UP_TO = 2.5  # beyond it the continued fraction converges faster than the series
TERMS = 80


def erfc(x: Column) -> Column:
    """Complementary error function for ``x >= 0`` to about fifteen digits.

    Small arguments by the series of positive terms ``x * (2 x * x) ** n / (1 * 3 * ... * (2 n + 1))``, large ones by the continued fraction
    ``1 / (x + (1 / 2) / (x + (2 / 2) / (x + ...)))``, each times a multiple of ``exp(-x * x)``.
    """
    def series(v: Column) -> Column:
        start = F.struct(v.alias("term"), v.alias("sum"))

        def step(s: Column, n: Column) -> Column:
            term = s["term"] * 2 * v * v / (2 * n + 1)
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["sum"])

    def fraction(v: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), v, lambda held, k: v + k / 2 / held)

    def both(v: Column) -> Column:
        bell = F.exp(-v * v) / math.sqrt(math.pi)
        return F.when(v <= SERIES_UP_TO, 1 - 2 * bell * series(v)).otherwise(bell / fraction(v))

    return let(x.cast("double"), both)


def z_score(a: Column, b: Column, se_a: Column, se_b: Column) -> Column:
    return F.try_divide(a - b, F.sqrt(se_a * se_a + se_b * se_b))


def two_tailed_p(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


def significance(paired: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds ``z, p_value`` and a mark to ``a.value, a.stderr, b.value, b.stderr``."""
    z = z_score(F.col("a.value"), F.col("b.value"), F.col("a.stderr"), F.col("b.stderr"))
    scored = paired.withColumn("z", z).withColumn("p_value", two_tailed_p(F.col("z")))
    return scored.withColumn("mark", F.when(F.col("p_value") > alpha, "✓").otherwise("×"))


def preferred_metric(metrics: DataFrame, order: list[str]) -> DataFrame:
    """One value per task: the first metric of the list that the task has, else 0."""
    picks = [F.max(F.when((F.col("metric") == m) & (F.col("filter") == "none"), F.col("value"))) for m in order]
    return metrics.groupBy("task").agg(F.coalesce(*picks, F.lit(0.0)).alias("value"))


def flat_keys(metrics: DataFrame) -> DataFrame:
    """``task/metric,filter`` keys, without ``,none``."""
    name = F.regexp_replace(F.concat_ws(",", "metric", "filter"), r",none\z", "")
    return metrics.select(F.concat_ws("/", "task", name).alias("key"), "value")


def task_inventory(docs: DataFrame, metrics: DataFrame, splits: list[str]) -> DataFrame:
    """Documents per split and the metric names of each task."""
    counts = docs.groupBy("task").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits])
    names = metrics.groupBy("task").agg(F.array_join(F.array_sort(F.collect_set("metric")), ", ").alias("metrics"))
    return counts.join(names, "task", "left")


def leaderboard(scores: DataFrame, tasks: list[str]) -> DataFrame:
    """Models by their mean over the tasks: one column per task, ``average`` and ``rank``.

    Only the one row per model goes through the ranking window.
    """
    wide = scores.groupBy("model").pivot("task", tasks).agg(F.first("value"))
    present = [F.col(f"`{x}`") for x in tasks]
    average = sum(present[1:], present[0]) / len(tasks)
    return wide.withColumn("average", average).withColumn("rank", F.rank().over(W.orderBy(F.col("average").desc_nulls_last())))


def directed_rank(scores: DataFrame, directions: DataFrame) -> DataFrame:
    """Rank of each model per task; ``higher_is_better`` comes from the task's metric."""
    signed = scores.join(directions, "metric").withColumn(
        "_s", F.when(F.col("higher_is_better"), F.col("value")).otherwise(-F.col("value"))
    )
    return signed.withColumn("rank", F.rank().over(W.partitionBy("task", "metric").orderBy(F.col("_s").desc()))).drop("_s")


def safe_name(c: Column) -> Column:
    """Characters that paths do not take become ``__``."""
    return F.regexp_replace(c, r"[\"<>:/|\\?*\[\]]+", "__")


def runtime_share(runs: DataFrame, branch: str, runtime: str, baseline: str) -> DataFrame:
    """Runtime of every branch in percent of the baseline's (one number, read first)."""
    base = runs.where(F.col(branch) == baseline).agg(F.max(runtime)).first()[0]
    return runs.select(branch, runtime, (100.0 * F.col(runtime) / F.lit(base)).alias("percent"))


def sample_dataset(samples: DataFrame, output_type: str, with_filter: bool) -> DataFrame:
    """Export table of the documents: ``id, doc_id, data, input_len, labels, output_type``.

    ``samples`` has ``doc_id, filter, target, ctx`` and ``continuations`` (array).
    """
    key = F.col("doc_id").cast("string")
    id_ = F.concat_ws(".", key, "filter") if with_filter else key
    choices = F.array_join(F.transform("continuations", lambda c: F.concat(F.lit("- "), c)), "\n")
    data = F.concat(F.col("ctx"), F.lit("\n\n"), choices) if output_type == "multiple_choice" else F.col("ctx")
    label = F.get("continuations", F.lit(0)) if output_type == "loglikelihood" else F.col("target")
    return samples.select(
        id_.alias("id"), "doc_id", data.alias("data"), F.length(data).alias("input_len"), label.alias("labels"),
        F.lit(output_type).alias("output_type"),
    )


def sample_system(samples: DataFrame, output_type: str, metrics: list[str]) -> DataFrame:
    """Export table of one system: output by type and one column per metric of the ``metrics`` map.

    ``filtered`` holds the filtered responses as text, ``is_greedy`` the flag of the first one.
    """
    outputs = {
        "loglikelihood": F.when(F.col("is_greedy"), "correct").otherwise("incorrect"),
        "multiple_choice": F.array_join("filtered", ", "),
    }
    output = outputs.get(output_type, F.get("filtered", F.lit(0)))
    extra = {
        "multiple_choice": [F.size("filtered").alias("num_answers")],
        "generate_until": [F.length(output).alias("output_length")],
    }.get(output_type, [])
    return samples.select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", output.alias("output"), *extra,
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics],
    )
