"""Corpus metrics. Every metric is built from sums that combine on the map side; no group is ever gathered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import strip, substitute, words
from evalloom.functions.textscore import bleu_stats, qa_normal, token_f1
from evalloom.operators.bootstrap import bootstrap_error

NAN = float("nan")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- means and likelihood metrics ------------------------------------------------------------------------------------


def nanmean(x: Column | str) -> Column:
    return F.avg(F.when(~F.isnan(col(x)), col(x)))


def sentinel_mean(x: Column | str, missing: float = -1.0) -> Column:
    """Mean of the values that are not the sentinel; the sentinel when there are none."""
    return F.coalesce(F.avg(F.when(col(x) != missing, col(x))), F.lit(missing))


def perplexity(ll: Column | str) -> Column:
    return F.exp(-F.avg(col(ll)))


def weighted_perplexity(ll: Column | str, weight: Column | str) -> Column:
    return F.exp(-F.sum(col(ll)) / F.sum(col(weight)))


def bits_per_byte(ll: Column | str, n_bytes: Column | str) -> Column:
    return -F.sum(col(ll)) / F.sum(col(n_bytes)) / F.log(F.lit(2.0))


def mean_stderr(x: Column | str) -> Column:
    return F.stddev_samp(col(x)) / F.sqrt(F.count(col(x)))


def brier(probabilities: Column, gold: Column) -> Column:
    """Mean squared distance to the one-hot gold."""
    parts = F.transform(probabilities, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), 2))
    return F.avg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def ratio_of_sums(scores: Column) -> Column:
    """Sum over all list entries divided by the number of entries."""
    return F.sum(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size(scores))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate that one of ``k`` samples passes when ``c`` of ``n`` do."""
    factors = F.transform(F.sequence(n - c + 1, n), lambda i: 1.0 - F.lit(float(k)) / i)
    misses = F.aggregate(factors, F.lit(1.0), lambda a, x: a * x)
    return F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1.0 - misses)


# --- classification --------------------------------------------------------------------------------------------------


def confusion(gold: Column, pred: Column, positive=1) -> dict[str, Column]:
    g, p = gold == positive, pred == positive
    return {"tp": F.count_if(g & p), "fp": F.count_if(~g & p), "fn": F.count_if(g & ~p), "tn": F.count_if(~g & ~p)}


def f1_cells(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def binary_f1(gold: Column, pred: Column, positive=1) -> Column:
    c = confusion(gold, pred, positive)
    return f1_cells(c["tp"], c["fp"], c["fn"])


def mcc(gold: Column, pred: Column, positive=1) -> Column:
    c = {k: v.cast("double") for k, v in confusion(gold, pred, positive).items()}
    root = F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    return F.coalesce(F.try_divide(c["tp"] * c["tn"] - c["fp"] * c["fn"], root), F.lit(0.0))


def class_cells(df: DataFrame, gold: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """Per class: ``tp, fp, fn``, one shuffle of at most one row per class and task."""
    group = group or []
    same = F.col(gold) == F.col(pred)
    one = lambda c: c.cast("long")
    sides = F.array(
        F.struct(F.col(gold).alias("c"), one(same).alias("tp"), F.lit(0).cast("long").alias("fp"), one(~same).alias("fn")),
        F.struct(F.col(pred).alias("c"), F.lit(0).cast("long").alias("tp"), one(~same).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    rows = df.select(*group, F.explode(sides).alias("_x")).select(*group, F.col("_x.c").alias("class"), "_x.tp", "_x.fp", "_x.fn")
    return rows.groupBy(*group, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def multiclass_f1(df: DataFrame, gold: str, pred: str, group: list[str] | None = None, labels: list | None = None) -> DataFrame:
    """``group, macro, micro, weighted`` F1; ``labels`` restricts (and completes) the classes."""
    group = group or []
    cells = class_cells(df, gold, pred, group)
    if labels is not None:
        cells = cells.where(F.col("class").isin(*labels))
    f1 = f1_cells(F.col("tp"), F.col("fp"), F.col("fn"))
    support = F.col("tp") + F.col("fn")
    scored = cells.select(*group, f1.alias("f1"), support.alias("support"), "tp", "fp", "fn")
    macro = F.avg("f1") if labels is None else F.sum("f1") / len(labels)
    return scored.groupBy(*group).agg(
        macro.alias("macro"),
        f1_cells(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted"),
    )


def polarity_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Four sentiment classes as two yes/no labels (positive: 0 and 3, negative: 1 and 3); mean of the four F1s."""
    def side(classes):
        return F.col(gold).isin(*classes), F.col(pred).isin(*classes)

    terms = []
    for classes in ((0, 3), (1, 3)):
        g, p = side(classes)
        terms += [binary_f1(g, p, True), binary_f1(g, p, False)]
    return df.agg((sum(terms[1:], terms[0]) / 4).alias("f1"))


def entity_label_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Mean F1 over the labels except the last in order (the outside label), from label arrays of equal length."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p"))).alias("x")).select("x.g", "x.p")
    cells = class_cells(pairs, "g", "p").withColumn("f1", f1_cells(F.col("tp"), F.col("fp"), F.col("fn")))
    sums = cells.agg(F.sum("f1").alias("s"), F.count("*").alias("n"), F.max_by("f1", "class").alias("last"))
    return sums.select(F.when(F.col("n") > 1, (F.col("s") - F.col("last")) / (F.col("n") - 1)).otherwise(F.col("last")).alias("f1"))


# --- two-stage groups ------------------------------------------------------------------------------------------------


def group_exact(df: DataFrame, group: list[str], right: Column) -> DataFrame:
    """Share of groups in which every row is right."""
    return df.groupBy(*group).agg(F.every(right).alias("_all")).agg(
        F.avg(F.col("_all").cast("int")).alias("em"), F.count("*").alias("n_groups")
    )


def group_reference_scores(df: DataFrame, group: str, pos: str, pred: str, reference: str, normal: bool = False) -> DataFrame:
    """``em`` over all predictions against any reference of the group, ``f1`` of each group's first prediction.

    With ``normal`` the texts are normalised already, as ``qa_normal`` does it, so that a text of many rows can be normalised once.
    Each group meets its first prediction once; partitions of a group that is much larger than others are split by Spark.
    """
    text = F.col if normal else lambda c: qa_normal(F.col(c))
    rows = df.select(group, pos, text(pred).alias("_p"), text(reference).alias("_t"))
    sides = F.array(
        F.struct(F.col("_p").alias("text"), F.lit(1).alias("n"), F.lit(0).alias("hit")),
        F.struct(F.col("_t").alias("text"), F.lit(0).alias("n"), F.lit(1).alias("hit")),
    )
    cells = rows.select(group, F.explode(sides).alias("_s")).groupBy(group, "_s.text").agg(
        F.sum("_s.n").alias("_n"), F.max("_s.hit").alias("_hit")
    )
    hit = (F.col("_hit") == 1) & F.col(group).isNotNull() & F.col("text").isNotNull()
    em = cells.agg((F.sum(F.when(hit, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("em"))
    first = rows.groupBy(group).agg(F.min_by("_p", F.struct(pos, "_p")).alias("_first"))
    scored = rows.select(group, "_t").join(first, group)
    f1 = scored.groupBy(group).agg(F.max(token_f1(words("_first"), words("_t"))).alias("_f")).agg(F.avg("_f").alias("f1"))
    both = em.select("em", F.lit(None).cast("double").alias("f1")).unionByName(f1.select(F.lit(None).cast("double").alias("em"), "f1"))
    return both.agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


# --- spans -----------------------------------------------------------------------------------------------------------

# Fixed value: signs that count as punctuation in span texts. The number sign is one of them, the backslash is not.
SPAN_PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?\[\]^_`{|}~•@]+"


def span_text(c: Column) -> Column:
    plain = substitute(
        c, (SPAN_PUNCTUATION, " "), (r"(?U)\b(a|an|the)\b", " "), (r"\s{3,}|\t", ""), (r"\s+", " ")
    )
    return F.lower(plain)


def parse_spans(c: Column) -> Column:
    """``array<struct<tag, entity>>`` of ``tag: entity`` parts separated by dollar signs, ``. `` or ``, ``."""
    parts = F.flatten(
        F.transform(
            F.filter(F.split(strip(c), r"\$\$|\$"), lambda x: x != ""),
            lambda x: F.transform(F.split(strip(x), r"\. |, "), strip),
        )
    )
    pairs = F.filter(F.transform(parts, lambda x: F.split(x, ": ")), lambda x: F.size(x) == 2)
    return F.transform(
        pairs, lambda x: F.struct(span_text(strip(x[0])).alias("tag"), span_text(strip(x[1])).alias("entity"))
    )


def span_f1(df: DataFrame, key: list[str], gold: str, pred: str) -> DataFrame:
    """Micro F1 of entity spans with multiset matching per document: ``tp, fp, fn, f1``."""
    tagged = F.concat(
        F.transform(parse_spans(F.col(gold)), lambda s: F.struct(s["tag"].alias("t"), s["entity"].alias("e"), F.lit(1).alias("g"), F.lit(0).alias("p"))),
        F.transform(parse_spans(F.col(pred)), lambda s: F.struct(s["tag"].alias("t"), s["entity"].alias("e"), F.lit(0).alias("g"), F.lit(1).alias("p"))),
    )
    counts = df.select(*key, F.explode(tagged).alias("_x")).groupBy(*key, "_x.t", "_x.e").agg(
        F.sum("_x.g").alias("g"), F.sum("_x.p").alias("p")
    )
    totals = counts.agg(
        F.coalesce(F.sum(F.least("g", "p")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))), F.lit(0)).alias("fn"),
    )
    tiny = 1e-13
    precision = F.col("tp") / (F.col("tp") + F.col("fp") + tiny)
    recall = F.col("tp") / (F.col("tp") + F.col("fn") + tiny)
    return totals.withColumn("f1", 2.0 * precision * recall / (precision + recall + tiny))


# --- translation metrics ---------------------------------------------------------------------------------------------


def bleu_terms(stats: str, order: int = 4) -> tuple[dict[str, Column], Column]:
    """Terms of :func:`bleu_stats` whose sums suffice for corpus BLEU, and BLEU in percent as an expression of these sums.

    It is 0 when an order has no match.
    """
    terms = {"test": F.col(f"{stats}.test"), "ref": F.col(f"{stats}.ref")}
    terms |= {f"{c}{n}": F.col(f"{stats}.{c}")[n] for c in ("guess", "correct") for n in range(order)}
    logs = [F.log(F.try_divide(F.col(f"correct{n}"), F.col(f"guess{n}"))) for n in range(order)]
    penalty = F.least(F.lit(0.0), 1 - F.try_divide(F.col("ref"), F.col("test")))
    every = F.least(*[F.col(f"correct{n}") for n in range(order)]) > 0
    return terms, F.when(every, 100 * F.exp(sum(logs[1:], logs[0]) / order + penalty)).otherwise(0.0)


def corpus_bleu(df: DataFrame, pred: str, references: Column, group: list[str] | None = None, order: int = 4) -> DataFrame:
    """BLEU in percent from summed n-gram counts."""
    terms, bleu = bleu_terms("_x", order)
    stats = df.select(*(group or []), bleu_stats(F.col(pred), references, order).alias("_x"))
    sums = stats.groupBy(*(group or [])).agg(*[F.sum(c).alias(n) for n, c in terms.items()])
    return sums.select(*(group or []), bleu.alias("bleu"))


CHAR_ORDERS = 6


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def char_ngram_stats(preds: pa.Array, golds: pa.Array) -> pa.Array:
    """Per order 1..6 the character n-grams of prediction, of reference and in common, without white space."""
    from collections import Counter

    def stats(pred, gold):
        p, g = "".join(pred.split()), "".join(gold.split())
        out = []
        for n in range(1, CHAR_ORDERS + 1):
            a = Counter(p[i : i + n] for i in range(len(p) - n + 1))
            b = Counter(g[i : i + n] for i in range(len(g) - n + 1))
            out += [a.total(), b.total(), (a & b).total()]
        return out

    return pa.array([stats(p, g) for p, g in zip(preds.to_pylist(), golds.to_pylist(), strict=True)], pa.list_(pa.int32()))


def corpus_chrf(df: DataFrame, pred: str, gold: str, group: list[str] | None = None, beta: float = 2.0) -> DataFrame:
    """chrF in percent: precision and recall averaged over the orders that occur, from summed counts."""
    stats = df.select(*(group or []), char_ngram_stats(F.col(pred), F.col(gold)).alias("_x"))
    sums = stats.groupBy(*(group or [])).agg(*[F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(3 * CHAR_ORDERS)])
    orders = F.array(
        *[F.struct(F.col(f"s{3 * n}").alias("h"), F.col(f"s{3 * n + 1}").alias("r"), F.col(f"s{3 * n + 2}").alias("m")) for n in range(CHAR_ORDERS)]
    )
    used = F.filter(orders, lambda o: (o["h"] > 0) & (o["r"] > 0))

    def mean(side):
        return F.try_divide(F.aggregate(used, F.lit(0.0), lambda a, o: a + o["m"] / o[side]), F.size(used))

    p, r = mean("h"), mean("r")
    score = F.try_divide((1 + beta**2) * p * r, beta**2 * p + r)
    return sums.select(*(group or []), (100 * F.coalesce(score, F.lit(0.0))).alias("chrf"))


def word_edits(pred: Column, gold: Column) -> Column:
    """Word-level edit distance."""
    return edit_distances(words(pred), words(gold))


@F.arrow_udf(T.IntegerType())
def edit_distances(preds: pa.Array, golds: pa.Array) -> pa.Array:
    """Edit distances of word lists. Words are coded by one dictionary per batch; a row of the table is one vector operation."""
    codes = pa.concat_arrays([preds.flatten(), golds.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (preds, golds)]
    ends = [np.cumsum(s) for s in sizes]
    shift = int(ends[0][-1]) if len(preds) else 0
    out = []
    for row in range(len(preds)):
        if not (preds[row].is_valid and golds[row].is_valid):
            out.append(None)
            continue
        p = codes[ends[0][row] - sizes[0][row] : ends[0][row]]
        g = codes[shift + ends[1][row] - sizes[1][row] : shift + ends[1][row]]
        steps = np.arange(len(g) + 1)
        last = steps.copy()
        for i, word in enumerate(p):
            best = np.minimum(last[1:] + 1, last[:-1] + (g != word))
            last = np.minimum.accumulate(np.concatenate([[i + 1], best]) - steps) + steps
        out.append(int(last[-1]))
    return pa.array(out, pa.int32())


def corpus_ter(pred: str, gold: str) -> Column:
    """Translation edit rate in percent, without shifts."""
    return 100.0 * F.sum(word_edits(F.col(pred), F.col(gold))) / F.sum(F.size(words(gold)))


# --- consistency -----------------------------------------------------------------------------------------------------


def consistency_rate(df: DataFrame, question: list[str], answer: Column, group: list[str] | None = None) -> DataFrame:
    """Share of equal answer pairs within a question, pooled over all pairs; pairs are counted, never built."""
    group = group or []
    keys = list(dict.fromkeys(group + question))
    per_answer = df.select(*keys, answer.alias("_a")).groupBy(*keys, "_a").agg(F.count("*").alias("_c"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    per_question = per_answer.groupBy(*keys).agg(F.sum(pairs("_c")).alias("_same"), F.sum("_c").alias("_n"))
    rate = F.coalesce(F.try_divide(F.sum("_same"), F.sum(pairs("_n"))), F.lit(0.0))
    return per_question.groupBy(*group).agg(rate.alias("consistency"))


def slot_answer(answer: Column, forced: Column, original: Column) -> Column:
    """Answers equal to the forced slot or to the original label count as the original label."""
    return F.when((answer == original) | (answer == forced), original).otherwise(answer)


def macro_accuracy(df: DataFrame, by: list[str], category: str, right: Column) -> DataFrame:
    """Mean over categories of the category accuracy, rounded to four decimals."""
    per_category = df.groupBy(*by, category).agg(F.avg(right.cast("int")).alias("_a"))
    return per_category.groupBy(*by).agg(F.bround(F.avg("_a"), 4).alias("macro_accuracy"))


def conditional_ratio(hit: Column, given: Column) -> Column:
    """Hits over the rows that qualify; NaN when none does."""
    return F.coalesce(F.try_divide(F.sum(hit.cast("double")), F.sum(given.cast("double"))), F.lit(NAN))


def ambiguous_bias(given: Column, pro: Column, anti: Column) -> Column:
    return F.coalesce(F.try_divide((F.sum(pro) - F.sum(anti)).cast("double"), F.sum(given)), F.lit(NAN))


def clear_bias(pro: Column, anti: Column, pro_right: Column, anti_right: Column) -> Column:
    """Accuracy on pro rows minus accuracy on anti rows; NaN when one side is empty."""
    first = F.try_divide(F.sum(pro_right).cast("double"), F.sum(pro))
    second = F.try_divide(F.sum(anti_right).cast("double"), F.sum(anti))
    return F.coalesce(first - second, F.lit(NAN))


def answered_f1(score: Column, answered: Column, annotated: Column) -> Column:
    """F1 of precision over answered and recall over annotated rows; an empty side divides by one."""
    s = F.sum(score)
    p = s / F.greatest(F.sum(answered), F.lit(1))
    r = s / F.greatest(F.sum(annotated), F.lit(1))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def bucket_percent(df: DataFrame, length: Column, score: Column, group: list[str] | None = None) -> DataFrame:
    """Percent score per length bucket ``0-4k``, ``4-8k``, ``8k+``, two decimals."""
    bucket = F.when(length < 4000, "0-4k").when(length < 8000, "4-8k").otherwise("8k+")
    return df.groupBy(*(group or []), bucket.alias("bucket")).agg(F.round(100 * F.avg(score), 2).alias("percent"))


def first_line(c: Column) -> Column:
    return F.split(substitute(c, (r"\A\n+", "")), "\n")[0]


# --- reading comprehension -------------------------------------------------------------------------------------------


def edges_below(value: Column, edges: list[float], width: int = 32) -> Column:
    """How many of the sorted edges lie below the value; a coarse and a fine step instead of one long scan."""
    blocks = [edges[i : i + width] for i in range(0, len(edges), width)] or [[]]
    literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")
    below = lambda xs: F.size(F.filter(xs, lambda e: e < value))
    coarse = below(literal([b[-1] for b in blocks if b]))
    fine = F.coalesce(F.get(F.array(*[literal(b) for b in blocks]), coarse), literal([]))
    return coarse * width + below(fine)


def best_threshold(df: DataFrame, score: Column, has_answer: Column, no_answer_probability: Column, pred_empty: Column,
                   chunks: int = 1024) -> DataFrame:
    """Best mean score when answers above a no-answer probability are withdrawn: one row ``best``.

    Rows of equal probability are combined on the map side. The running sum goes chunk by chunk of approximate quantiles:
    inside a chunk by window, over the chunks by their totals and best prefixes.
    """
    gain = F.when(has_answer, score).otherwise(F.when(pred_empty, 0.0).otherwise(-1.0))
    base = df.select(no_answer_probability.alias("_p"), gain.alias("_g"), has_answer.alias("_h"))
    cuts = base.agg(F.percentile_approx("_p", [i / chunks for i in range(1, chunks)], 10 * chunks)).first()[0] or []
    edges = sorted(set(cuts))
    steps = base.groupBy("_p").agg(F.sum("_g").alias("_g"), F.count("*").alias("_n"), F.count_if(~F.col("_h")).alias("_no"))
    chunked = steps.withColumn("_k", edges_below(F.col("_p"), edges))
    upto = W.partitionBy("_k").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    inside = chunked.withColumn("_run", F.sum("_g").over(upto)).groupBy("_k").agg(
        F.max("_run").alias("_peak"), F.sum("_g").alias("_total"), F.sum("_n").alias("_n"), F.sum("_no").alias("_no")
    )
    # one row per chunk from here on
    before = F.coalesce(F.sum("_total").over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    peaks = inside.withColumn("_peak", F.col("_peak") + before)
    return peaks.agg(
        (100.0 * (F.sum("_no") + F.greatest(F.max("_peak"), F.lit(0.0))) / F.sum("_n")).alias("best")
    )


def comprehension_suite(df: DataFrame, exact: Column, f1: Column, has_answer: Column) -> DataFrame:
    """Exact and F1 in percent over all rows and by answerability."""
    def pct(x):
        return 100.0 * F.avg(x)

    return df.agg(
        pct(exact).alias("exact"), pct(f1).alias("f1"),
        pct(F.when(has_answer, exact)).alias("has_answer_exact"), pct(F.when(has_answer, f1)).alias("has_answer_f1"),
        pct(F.when(~has_answer, exact)).alias("no_answer_exact"), pct(F.when(~has_answer, f1)).alias("no_answer_f1"),
    )


def mean_words(c: Column | str) -> Column:
    return F.avg(F.size(words(c)))


# --- dictionary metrics and custom aggregation -----------------------------------------------------------------------


@dataclass(frozen=True)
class Aggregation:
    """A metric as row value, built-in aggregates over it, and a final expression over their results."""

    parts: Callable[[Column], dict[str, Column]]
    finish: Callable[[dict[str, Column]], Column]

    def apply(self, value: Column) -> Column:
        return self.finish(self.parts(value))


AGGREGATIONS: dict[str, Aggregation] = {
    "mean": Aggregation(lambda x: {"m": F.avg(x)}, lambda p: p["m"]),
    "sum": Aggregation(lambda x: {"s": F.sum(x)}, lambda p: p["s"]),
    "nanmean": Aggregation(lambda x: {"m": nanmean(x)}, lambda p: p["m"]),
    "max": Aggregation(lambda x: {"m": F.max(x)}, lambda p: p["m"]),
    "perplexity": Aggregation(lambda x: {"m": F.avg(x)}, lambda p: F.exp(-p["m"])),
}


def register_aggregation(name: str, parts, finish) -> None:
    if name in AGGREGATIONS:
        raise ValueError(f"aggregation {name} registered twice")
    AGGREGATIONS[name] = Aggregation(parts, finish)


def dict_metrics(df: DataFrame, metrics: str, aggregation: str, group: list[str] | None = None) -> DataFrame:
    """Sub-metrics of a map-valued metric, each under the same named aggregation."""
    group = group or []
    rows = df.select(*group, F.explode(metrics).alias("metric", "_v"))
    return rows.groupBy(*group, "metric").agg(AGGREGATIONS[aggregation].apply(F.col("_v")).alias("value"))


# --- regression and bootstrap ----------------------------------------------------------------------------------------


def least_squares(df: DataFrame, target: str, terms: dict[str, Column], scaled: tuple[str, ...] = ()) -> DataFrame:
    """Ordinary least squares with intercept: ``term, coefficient``. Rows with a null in any term are left out.

    Terms named in ``scaled`` are standardised over the rows that stay. One aggregate collects the normal equations (a few numbers);
    they are solved on the driver.
    """
    names = ["intercept", *terms]
    xs = [F.lit(1.0), *[c.cast("double") for c in terms.values()]]
    prepared = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], F.col(target).cast("double").alias("y")).dropna()
    if scaled:
        places = [f"x{names.index(name)}" for name in scaled]
        moments = prepared.agg(*[f(p).alias(f"{i}{p}") for p in places for i, f in enumerate((F.avg, F.stddev_samp))]).first()
        for p in places:
            prepared = prepared.withColumn(p, F.try_divide(F.col(p) - F.lit(moments[f"0{p}"]), F.lit(moments[f"1{p}"])))
        prepared = prepared.dropna()
    k = len(xs)
    cells = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)]
    cells += [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(k)]
    got = iter(prepared.agg(*cells).first())
    left, right = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        for j in range(i, k):
            left[i, j] = left[j, i] = next(got) or 0.0
    for i in range(k):
        right[i] = next(got) or 0.0
    solved = np.linalg.lstsq(left, right, rcond=None)[0]
    rows = list(zip(names, map(float, solved), strict=True))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def standardised(df: DataFrame, column: str) -> Column:
    """``(x - mean) / sd`` with the sample deviation of the column."""
    mean, sd = df.agg(F.avg(column), F.stddev_samp(column)).first()
    return (F.col(column) - F.lit(mean)) / F.lit(sd)


def treatment(column: str, reference: str, levels: list[str]) -> dict[str, Column]:
    """0/1 terms of a category against its reference level."""
    return {f"{column}={v}": (F.col(column) == v).cast("double") for v in levels if v != reference}


def bootstrap_stderr(df: DataFrame, group: list[str], value: str, replicates: int = 1000, seed: int = 1234) -> DataFrame:
    """Bootstrap standard error of the mean per group; null values are left out."""
    rows = df.where(F.col(value).isNotNull())
    found = bootstrap_error(rows, group, {"x": F.col(value)}, F.try_divide("x", "weight"), replicates, seed)
    return found.withColumnRenamed("stderr", "bootstrap_stderr")
