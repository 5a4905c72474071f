"""Text metrics of one row: prediction against one or many references."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.filters import all_numbers, math_answer, number_value
from evalloom.functions.text import (
    COUNTED,
    PUNCTUATION,
    SPACE,
    count_of,
    drop_punctuation,
    let,
    multiset_overlap,
    numbered,
    ngrams,
    replace_all,
    squeeze,
    strip,
    substitute,
    words,
)

ARTICLES = r"(?U)\b(a|an|the)\b"
NAN = float("nan")


def f1_of(shared: Column, n_pred: Column, n_gold: Column) -> Column:
    """F1 from the overlap and the two sizes; 0 without overlap."""
    return F.when(shared > 0, 2.0 * shared / (n_pred + n_gold)).otherwise(0.0)


def exact_match(pred: Column, target: Column, ignore_case: bool = False, ignore_punctuation: bool = False,
                ignore_patterns: tuple = ()) -> Column:
    """1.0 on equality after dropping patterns, then case, then ASCII punctuation, as asked."""
    def clean(c: Column) -> Column:
        c = substitute(c, *[(p, "") for p in ignore_patterns])
        c = F.lower(c) if ignore_case else c
        return drop_punctuation(c) if ignore_punctuation else c

    return (clean(pred) == clean(target)).cast("double")


def exact_match_any(pred: Column, targets: Column, **ignore) -> Column:
    return F.exists(targets, lambda t: exact_match(pred, t, **ignore) == 1.0).cast("double")


def qa_normal(c: Column) -> Column:
    """Lower case, ASCII punctuation and English articles dropped, single spaces."""
    return squeeze(substitute(drop_punctuation(F.lower(c)), (ARTICLES, " ")))


def token_f1(pred_tokens: Column, gold_tokens: Column) -> Column:
    """F1 of two token multisets."""
    return let(
        F.struct(pred_tokens.alias("p"), gold_tokens.alias("g")),
        lambda s: f1_of(multiset_overlap(s["p"], s["g"]), F.size(s["p"]), F.size(s["g"])),
    )


def qa_f1(pred: Column, gold: Column) -> Column:
    return token_f1(words(qa_normal(pred)), words(qa_normal(gold)))


def best(references: Column, score) -> Column:
    return F.array_max(F.transform(references, score))


def char_f1(pred: Column, gold: Column) -> Column:
    """F1 of the character multisets."""
    def shared(s: Column) -> Column:
        chars = F.array_distinct(F.filter(F.split(s["p"], ""), lambda c: c != ""))
        overlap = F.aggregate(
            chars, F.lit(0),
            lambda a, c: a + F.least(
                F.length(s["p"]) - F.length(F.replace(s["p"], c, F.lit(""))),
                F.length(s["g"]) - F.length(F.replace(s["g"], c, F.lit(""))),
            ),
        )
        return f1_of(overlap, F.length(s["p"]), F.length(s["g"]))

    return let(F.struct(pred.alias("p"), gold.alias("g")), shared)


def leave_one_out(golds: Column, score) -> Column:
    """Mean over references of the best score against the others; the plain score with a single reference."""
    def mean(g: Column) -> Column:
        scores = F.transform(g, score)
        others = lambda s: F.transform(
            s, lambda _, i: F.array_max(F.filter(s, lambda _x, j: j != i))
        )
        many = let(scores, lambda s: F.aggregate(others(s), F.lit(0.0), lambda a, x: a + x) / F.size(s))
        return F.when(F.size(g) > 1, many).otherwise(F.array_max(scores))

    return let(golds, mean)


# --- number-aware bags -----------------------------------------------------------------------------------------------

FLOAT = r"(?i)\A[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\z"


def is_number(c: Column) -> Column:
    return F.regexp_like(c, F.lit(FLOAT))


def span_normal(span: Column) -> Column:
    """Tokens at blanks and hyphens; numbers in one form, other tokens without punctuation and articles."""
    def token(t: Column) -> Column:
        bare = let(F.lower(t), lambda x: F.when(is_number(x), x).otherwise(drop_punctuation(x)))
        plain = let(bare, lambda x: F.when(is_number(x), x.try_cast("double").cast("string")).otherwise(x))
        return squeeze(substitute(plain, (ARTICLES, " ")))

    return F.array_join(F.filter(F.transform(F.split(span, " |-"), token), lambda t: t != ""), " ")


def assignment_total(matrix: np.ndarray) -> float:
    """Highest total of a one-to-one assignment (shortest augmenting paths on the smaller side)."""
    cost = -(matrix if matrix.shape[0] <= matrix.shape[1] else matrix.T)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        slack, link, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[col]:
            done[col] = True
            gain = cost[owner[col] - 1] - u[owner[col]] - v[1:]
            closer = ~done[1:] & (gain < slack[1:])
            slack[1:][closer], link[1:][closer] = gain[closer], col
            nxt = 1 + int(np.argmin(np.where(done[1:], np.inf, slack[1:])))
            step = slack[nxt]
            u[owner[done]] += step
            v[done] -= step
            slack[~done] -= step
            col = nxt
        while col:
            owner[col], col = owner[link[col]], link[col]
    return 0.0 - float(sum(cost[owner[j] - 1, j - 1] for j in range(1, m + 1) if owner[j]))


def bag_score(pred: set, gold: set) -> float:
    """F1 of two token sets; 0 when the gold has numbers and shares none of them."""
    numbers = {t for t in gold if re.match(FLOAT.replace(r"\z", r"\Z"), t)}
    if numbers and not numbers & pred:
        return 0.0
    return 2.0 * len(pred & gold) / (len(pred) + len(gold)) if pred or gold else 1.0


@F.arrow_udf(T.DoubleType())
def best_alignment(preds: pa.Array, golds: pa.Array) -> pa.Array:
    """Total of the best one-to-one alignment of predicted and gold spans (normalised texts) per row."""
    def total(pred, gold):
        bags, others = [set(s.split()) for s in pred], [set(s.split()) for s in gold]
        if not bags or not others:
            return 0.0
        return assignment_total(np.array([[bag_score(p, g) for p in bags] for g in others]))

    return pa.array([total(p, g) for p, g in zip(preds.to_pylist(), golds.to_pylist(), strict=True)], pa.float64())


def spans_exact(pred_spans: Column, gold_spans: Column) -> Column:
    def same(x: Column) -> Column:
        return F.array_sort(F.array_distinct(x["p"])).eqNullSafe(F.array_sort(F.array_distinct(x["g"]))) & (
            F.size(x["p"]) == F.size(x["g"])
        )

    return let(
        F.struct(F.transform(pred_spans, span_normal).alias("p"), F.transform(gold_spans, span_normal).alias("g")), same
    ).cast("double")


def spans_f1(pred_spans: Column, gold_spans: Column) -> Column:
    """Mean F1 of the best alignment over the longer side, rounded half to even at two decimals."""
    total = best_alignment(F.transform(pred_spans, span_normal), F.transform(gold_spans, span_normal))
    longer = F.greatest(F.size(pred_spans), F.size(gold_spans))
    return F.bround(F.when(longer == 0, 1.0).otherwise(F.try_divide(total, longer)), 2)


def spans_best(pred_spans: Column, golds: Column) -> Column:
    """``struct<em, f1>``: the highest of each over the accepted answers (lists of spans); answers whose first span is blank do not
    count, and 0 is the score without any."""
    def best(score: Callable[[Column, Column], Column], gold: Column) -> Column:
        counts = F.length(strip(F.coalesce(F.get(gold, F.lit(0)), F.lit("")))) > 0
        return F.when(counts, score(pred_spans, gold)).otherwise(0.0)

    def highest(score: Callable[[Column, Column], Column]) -> Column:
        return F.greatest(F.lit(0.0), *[best(score, g) for g in golds_list])

    golds_list = golds if isinstance(golds, list) else [golds]
    return F.struct(highest(spans_exact).alias("em"), highest(spans_f1).alias("f1"))


# --- sets, numbers, classes ------------------------------------------------------------------------------------------


def set_f1(pred: Column, gold: Column) -> Column:
    shared = F.size(F.array_intersect(pred, gold))
    return f1_of(shared, F.size(F.array_distinct(pred)), F.size(F.array_distinct(gold)))


def number_hit_rate(pred: Column, gold: Column) -> Column:
    """Share of the numbers in the prediction that equal the gold text."""
    return let(
        F.regexp_extract_all(pred, F.lit(r"\d+"), F.lit(0)),
        lambda n: F.when(F.size(n) > 0, count_of(n, gold) / F.size(n)).otherwise(0.0),
    )


def paragraph_hit_rate(pred: Column, gold: Column, marker: str = "Paragraph ") -> Column:
    """``number_hit_rate`` against the number after the marker in the gold text."""
    return number_hit_rate(pred, F.regexp_extract(gold, marker + r"(\d+)", 1))


def class_score(pred: Column, gold: Column, classes: Column) -> Column:
    """1/k when the gold class is among the k classes named; names that are part of the gold do not count."""
    named = F.filter(classes, lambda c: F.contains(pred, c) & ((c == gold) | ~F.contains(gold, c)))
    return let(named, lambda k: F.when(F.array_contains(k, gold), 1.0 / F.size(k)).otherwise(0.0))


def first_code_line(pred: Column) -> Column:
    lines = F.split(substitute(pred, (r"\A\n+", "")), "\n")
    return F.coalesce(F.get(F.filter(lines, lambda x: ~F.regexp_like(x, F.lit("`|#|//"))), F.lit(0)), F.lit(""))


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel over one integer."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def common_subsequence(left: pa.Array, right: pa.Array) -> pa.Array:
    """LCS length of two token lists per row."""
    return pa.array([lcs_length(a, b) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int32())


def code_similarity(pred: Column, gold: Column, measure: str = "indel") -> Column:
    """Similarity of the first code line to the gold line.

    ``indel``: twice the common subsequence over both lengths, in whole percent; ``edit``: one minus the edit distance over
    the longer length.
    """
    line = first_code_line(pred)
    if measure == "edit":
        longest = F.greatest(F.length(line), F.length(gold))
        return F.when(longest > 0, 1 - F.levenshtein(line, gold) / longest).otherwise(1.0)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    both = F.length(line) + F.length(gold)
    ratio = 2.0 * common_subsequence(chars(line), chars(gold)) / both
    return F.when((F.length(line) == 0) | (F.length(gold) == 0), 0.0).otherwise(F.bround(100 * ratio) / 100)


def contains_any(pred: Column, labels: Column) -> Column:
    return F.exists(labels, lambda x: F.contains(F.lower(pred), F.lower(x))).cast("double")


def match_share(pred: Column, references: Column) -> Column:
    """Share of the references found in the prediction, ignoring case."""
    low = F.lower(pred)
    found = F.size(F.filter(references, lambda r: F.contains(low, F.lower(r))))
    return F.coalesce(F.try_divide(found, F.size(references)), F.lit(0.0))


def match_all(preds: Column, references: Column) -> Column:
    """Mean over the predictions of their share of references found (parallel arrays)."""
    shares = F.zip_with(preds, references, match_share)
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(preds)


def match_part(preds: Column, references: Column) -> Column:
    """Best share over the predictions, divided by their number (sic)."""
    return F.array_max(F.zip_with(preds, references, match_share)) / F.size(preds)


# --- overlap with references -----------------------------------------------------------------------------------------


def rouge_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def rouge_n(pred: Column, gold: Column, n: int) -> Column:
    """F-measure of n-gram multisets."""
    return token_f1(ngrams(rouge_tokens(pred), n), ngrams(rouge_tokens(gold), n))


def rouge_l(pred: Column, gold: Column) -> Column:
    """F-measure from the longest common subsequence of the tokens."""
    p, g = rouge_tokens(pred), rouge_tokens(gold)
    return f1_of(common_subsequence(g, p), F.size(p), F.size(g))


def lcs_positions(a, b) -> set:
    """Positions in ``a`` of one longest common subsequence."""
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i, x in enumerate(a, 1):
        row = table[i - 1, 1:].copy()
        same = np.fromiter((x == y for y in b), bool, len(b))
        row[same] = table[i - 1, :-1][same] + 1
        table[i, 1:] = np.maximum.accumulate(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i, j - 1] > table[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out


@F.arrow_udf(T.IntegerType())
def summary_hits(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """Matched tokens of sentence lists: per gold sentence the union of its subsequences with all predicted ones."""
    from collections import Counter

    def hits(gold_sents, pred_sents):
        left = Counter(t for s in gold_sents for t in s)
        right = Counter(t for s in pred_sents for t in s)
        n = 0
        for sent in gold_sents:
            for i in sorted(set().union(*(lcs_positions(sent, p) for p in pred_sents))):
                if left[sent[i]] > 0 and right[sent[i]] > 0:
                    left[sent[i]] -= 1
                    right[sent[i]] -= 1
                    n += 1
        return n

    return pa.array([hits(g, p) for g, p in zip(gold.to_pylist(), pred.to_pylist(), strict=True)], pa.int32())


def rouge_lsum(pred: Column, gold: Column) -> Column:
    """Summary-level ROUGE-L; sentences are lines, and `` . `` ends a line."""
    def sentences(c: Column) -> Column:
        lines = F.split(F.replace(c, F.lit(" . "), F.lit(".\n")), "\n")
        return F.filter(F.transform(lines, rouge_tokens), lambda s: F.size(s) > 0)

    p, g = sentences(pred), sentences(gold)
    return f1_of(summary_hits(g, p), F.size(F.flatten(p)), F.size(F.flatten(g)))


def bleu_tokens(c: Column) -> Column:
    """Lower-cased words, and every other sign as a token of its own."""
    return F.regexp_extract_all(F.lower(strip(c)), F.lit(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]"), F.lit(0))


def bleu_stats(pred: Column, references: Column, order: int = 4) -> Column:
    """``struct<test, ref, guess[], correct[]>``: lengths, n-gram counts and clipped matches of one row."""
    def stats(s: Column) -> Column:
        def clipped(n: int) -> Column:
            def matches(g: Column) -> Column:
                counted = F.aggregate(
                    F.array_intersect(g["t"], F.flatten(g["r"])), F.lit(0).cast("long"),
                    lambda a, x: a + F.least(count_of(g["t"], x), F.array_max(F.transform(g["r"], lambda r: count_of(r, x)))),
                )
                # of several references the union of numbered n-grams has the largest count of each
                known = F.flatten(F.transform(g["r"], numbered))
                hashed = F.size(F.array_intersect(numbered(g["t"]), known)).cast("long")
                return F.when(F.size(g["t"]) + F.size(F.flatten(g["r"])) <= COUNTED, counted).otherwise(hashed)

            return let(F.struct(ngrams(s["t"], n).alias("t"), F.transform(s["r"], lambda r: ngrams(r, n)).alias("r")), matches)

        return F.struct(
            F.size(s["t"]).cast("long").alias("test"),
            F.array_min(F.transform(s["r"], F.size)).cast("long").alias("ref"),
            F.array(*[F.greatest(F.size(s["t"]) - (n - 1), F.lit(0)).cast("long") for n in range(1, order + 1)]).alias("guess"),
            F.array(*[clipped(n) for n in range(1, order + 1)]).alias("correct"),
        )

    return let(F.struct(bleu_tokens(pred).alias("t"), F.transform(references, bleu_tokens).alias("r")), stats)


SMALLEST = float(np.finfo(float).tiny)


def sentence_bleu(stats: Column, order: int = 4) -> Column:
    """Smoothed BLEU of one row: one is added to every order above the first, and to the lengths of the penalty."""
    def score(s: Column) -> Column:
        logs = [
            F.log(F.get(s["correct"], F.lit(k)) + (1 if k else 0) + SMALLEST)
            - F.log(F.get(s["guess"], F.lit(k)) + (1 if k else 0) + SMALLEST)
            for k in range(order)
        ]
        penalty = F.least(F.lit(0.0), 1 - (s["ref"] + 1) / (s["test"] + 1))
        return F.exp(sum(logs[1:], logs[0]) / order + penalty)

    return let(stats, score)


def true_false_family(true_scores: Column, false_scores: Column) -> Column:
    """``struct<max, diff, acc>`` of the best score on true and on false references."""
    def family(s: Column) -> Column:
        return F.struct(
            s["t"].alias("max"), (s["t"] - s["f"]).alias("diff"), (s["t"] > s["f"]).cast("int").alias("acc")
        )

    return let(F.struct(F.array_max(true_scores).alias("t"), F.array_max(false_scores).alias("f")), family)


# --- numbers with units ----------------------------------------------------------------------------------------------

# Full-width ASCII, unit suffixes in order, and magnitude words in order.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
UNIT_SUFFIXES = ("百万円", "千円", "億円", "兆円", "円", "ドル", "ポイント", "pt", "bps")
MAGNITUDES = (("千", 1_000), ("百万", 1_000_000), ("億", 100_000_000), ("兆", 1_000_000_000_000))


def report_normal(c: Column) -> Column:
    """Half-width, minus for triangles, no thousands commas, no past-tense ending, lower case."""
    half = F.translate(strip(c), FULL_WIDTH, HALF_WIDTH)
    return strip(
        F.lower(substitute(half, (r"\A[△▲]", "-"), (r"(?<=\d),(?=\d)", ""), (r"(しました|した)\z", "")))
    )


def report_number(c: Column) -> Column:
    """Number of a report text, magnitude words applied; NULL when there is none."""
    text = substitute(report_normal(c), *[(rf"{u}\z", "") for u in UNIT_SUFFIXES])

    def digits(x: Column) -> Column:
        return substitute(x, (r"[^\d.\-+]", "")).try_cast("double")

    def parse(s: Column) -> Column:
        plain = digits(substitute(s, (r"%\z", "")))
        out = plain
        for word, factor in reversed(MAGNITUDES):
            out = F.when(F.contains(s, F.lit(word)), digits(strip(F.replace(s, F.lit(word), F.lit("")))) * factor).otherwise(out)
        return out

    return let(text, parse)


def report_match(pred: Column, gold: Column, tolerance: float = 0.01) -> Column:
    """Numbers within a relative tolerance; equality of the normal forms when one side has no number."""
    def match(s: Column) -> Column:
        numeric = F.when(s["g"] == 0, s["p"] == 0).otherwise(F.abs(s["p"] - s["g"]) <= tolerance * F.abs(s["g"]))
        return F.when(s["p"].isNull() | s["g"].isNull(), report_normal(pred) == report_normal(gold)).otherwise(numeric)

    return let(F.struct(report_number(pred).alias("p"), report_number(gold).alias("g")), match).cast("double")


END_PUNCTUATION = rf"([!-$&-/:-@\[-`{{-~]|{SPACE})+\z"


def chart_text(c: Column) -> Column:
    """Text with digits loses end punctuation (not %), commas and dollar signs; other text its outer quotes."""
    quoted = r"""(?s)\A(?:"(.*)"|'(.*)')\z"""
    unquoted = F.when(F.regexp_like(c, F.lit(quoted)), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.when(
        F.regexp_like(c, F.lit("[0-9]")), replace_all(substitute(c, (END_PUNCTUATION, "")), (",", ""), ("$", ""))
    ).otherwise(unquoted)


def relaxed_match(pred: Column, target: Column, change: float = 0.05) -> Column:
    """1.0 within a relative change, percent signs read both ways; single letters by first letter; else equal text."""
    def number(c: Column) -> Column:
        return substitute(strip(c), (r"%+\z", "")).try_cast("double")

    def close(p: Column, t: Column) -> Column:
        return F.abs(p - t) / F.greatest(F.abs(t), F.lit(1e-10)) <= change

    def match(s: Column) -> Column:
        p, t = s["p"], s["t"]
        p_pct, t_pct = F.endswith(strip(s["ps"]), F.lit("%")), F.endswith(strip(s["ts"]), F.lit("%"))
        as_decimal = lambda x, pct: F.when(pct, x / 100).otherwise(x)
        either = (p_pct | t_pct) & (close(as_decimal(p, p_pct), t) | close(p, as_decimal(t, t_pct)))
        numeric = close(p, t) | either
        option = F.lower(F.substring(s["ps"], 1, 1)) == F.lower(s["ts"])
        text = F.lower(substitute(s["ps"], (rf"{PUNCTUATION}+\z", ""))) == F.lower(s["ts"])
        return (
            F.when(p.isNotNull() & t.isNotNull(), numeric)
            .when(F.regexp_like(s["ts"], F.lit(r"\A\p{L}\z")) & (F.length(s["ps"]) > 0), option)
            .otherwise(text)
        )

    sides = let(
        F.struct(chart_text(pred).alias("ps"), chart_text(target).alias("ts")),
        lambda x: F.struct(x["ps"].alias("ps"), x["ts"].alias("ts"), number(x["ps"]).alias("p"), number(x["ts"]).alias("t")),
    )
    return let(sides, match).cast("double")


# --- structured answers ----------------------------------------------------------------------------------------------


def emotion_score(response: Column, reference: Column) -> Column:
    """``struct<score, parseable>`` from ``name: number`` pairs against ``array<struct<name, score>>`` of four."""
    names = F.regexp_extract_all(response, F.lit(r"(\w+):\s+(\d+)"), F.lit(1))
    values = F.regexp_extract_all(response, F.lit(r"(\w+):\s+(\d+)"), F.lit(2))
    # of a repeated name the last number counts
    said = let(
        F.arrays_zip(names.alias("n"), values.alias("v")),
        lambda z: F.filter(z, lambda x, i: ~F.exists(F.slice(z, i + 2, F.size(z)), lambda y: y["n"] == x["n"])),
    )

    def cost(d: Column) -> Column:
        return F.when(d == 0, 0.0).when(d <= 5, 6.5 / (1 + F.exp(-1.2 * (d - 4)))).otherwise(d)

    def score(s: Column) -> Column:
        matched = F.flatten(
            F.transform(
                s["u"],
                lambda x: F.transform(
                    F.filter(s["r"], lambda r: r["name"] == x["n"]),
                    lambda r: cost(F.abs(x["v"].cast("double") - r["score"])),
                ),
            )
        )
        known = F.size(F.filter(s["u"], lambda x: F.exists(s["r"], lambda r: r["name"] == x["n"])))
        ok = (F.size(s["u"]) == 4) & (known == 4)
        total = F.aggregate(matched, F.lit(0.0), lambda a, x: a + x)
        return F.struct(
            F.when(ok, 10 * (10 - 0.7477 * total)).otherwise(0.0).alias("score"), F.when(ok, 100).otherwise(0).alias("parseable")
        )

    return let(F.struct(said.alias("u"), reference.alias("r")), score)


def json_valid(c: Column) -> Column:
    """Valid JSON after taking off a code fence."""
    bare = strip(F.btrim(F.btrim(strip(c), F.lit("`")), F.lit("json")))
    return F.try_parse_json(bare).isNotNull().cast("double")


# Articles per language.
LANGUAGE_ARTICLES = {
    "en": "a|an|the",
    "es": "un|una|unos|unas|el|la|los|las",
    "vi": "của|là|cái|chiếc|những",
    "de": "ein|eine|einen|einem|eines|einer|der|die|das|den|dem|des",
    "fr": "un|une|des|le|la|les",
}
ALL_PUNCTUATION = r"[\p{P}$+<=>^`|~]"


def language_normal(c: Column, lang: Column) -> Column:
    """Lower case, punctuation and the language's articles dropped; Chinese characters become words."""
    bare = substitute(F.lower(c), (ALL_PUNCTUATION, ""))

    def per_language(x: Column) -> Column:
        out = F.when(lang == "ar", substitute(x, (rf"(?:^|{SPACE})ال", " ")))
        out = out.when(lang == "zh", substitute(x, (r"([\x{4e00}-\x{9fa5}])", " $1 ")))
        for code, articles in LANGUAGE_ARTICLES.items():
            out = out.when(lang == code, substitute(x, (rf"(?U)\b({articles})\b", " ")))
        return squeeze(out.otherwise(x))

    return let(bare, per_language)


def language_f1(pred: Column, gold: Column, lang: Column) -> Column:
    def score(s: Column) -> Column:
        empty = (F.size(s["p"]) == 0) | (F.size(s["g"]) == 0)
        agree = (F.size(s["p"]) == F.size(s["g"])).cast("double")
        return F.when((lang == "fr") & empty, agree).otherwise(token_f1(s["p"], s["g"]))

    return let(F.struct(words(language_normal(pred, lang)).alias("p"), words(language_normal(gold, lang)).alias("g")), score)


def language_exact(pred: Column, gold: Column, lang: Column) -> Column:
    return (language_normal(pred, lang) == language_normal(gold, lang)).cast("double")


def tag_accuracy(gold: Column, pred: Column) -> Column:
    """Share of equal tags over the shorter length; NaN without tags."""
    def share(s: Column) -> Column:
        n = F.least(F.size(s["g"]), F.size(s["p"]))
        same = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(s["g"], i) == F.get(s["p"], i))
        return F.when(n > 0, F.size(same) / n).otherwise(F.lit(NAN))

    return let(F.struct(gold.alias("g"), pred.alias("p")), share)


# Determiners that do not count in a referent.
DETERMINERS = (
    "a",
    "an",
    "few",
    "her",
    "his",
    "each",
    "every",
    "many",
    "much",
    "my",
    "our",
    "some",
    "that",
    "the",
    "their",
    "these",
    "this",
    "those",
    "which",
    "whose",
    "your",
)


def same_referent(pred: Column, reference: Column) -> Column:
    """True when one side's words, without determiners, include the other's, and both or neither have an apostrophe."""
    def clean(c: Column) -> Column:
        kept = F.filter(F.split(F.lower(strip(c)), " "), lambda w: ~w.isin(*DETERMINERS))
        return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))

    def include(s: Column) -> Column:
        mark = lambda a: F.exists(a, lambda w: F.contains(w, F.lit("'")))
        inside = (F.size(F.array_except(s["p"], s["r"])) == 0) | (F.size(F.array_except(s["r"], s["p"])) == 0)
        return (mark(s["p"]) == mark(s["r"])) & inside

    return let(F.struct(clean(pred).alias("p"), clean(reference).alias("r")), include)


def clean_part(c: Column) -> Column:
    """Stripped, without final stops and plus signs, single blanks, lower case, straight quotes."""
    bare = F.lower(substitute(F.btrim(strip(c), F.lit(".")), ("[ ]+", " ")))
    return replace_all(bare, ("+", ""), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'))


def keyed_scores(pred_json: Column, reference: Column) -> Column:
    """One score per key of ``reference`` (``map<string, array<string>>``): any accepted answer equals the cleaned part.

    An empty accepted answer scores 1, a missing or empty part 0.
    """
    opened = F.concat(F.lit("{"), F.substring_index(F.regexp_replace(pred_json, r"\A[^{]*\{", ""), "}", 1), F.lit("}"))
    given = F.from_json(opened, "map<string,string>")

    def score(s: Column) -> Column:
        def part(e: Column) -> Column:
            said = F.coalesce(F.try_element_at(s["g"], e["key"]), F.lit(""))
            empty = (F.size(e["value"]) == 0) | F.exists(e["value"], lambda v: v == "")
            hit = F.exists(e["value"], lambda v: clean_part(v) == clean_part(said))
            return F.when(empty, 1.0).when(said == "", 0.0).otherwise(hit.cast("double"))

        return F.transform(F.map_entries(s["r"]), part)

    return let(F.struct(given.alias("g"), reference.alias("r")), score)


# Terms that decide the preference.
MALE_TERMS = ("male", "man")
FEMALE_TERMS = ("female", "woman")


def term_preference(responses: Column) -> Column:
    """``struct<difference, male, female, invalid>``: each side counts once however often it is said."""
    male = F.exists(responses, lambda r: r.isin(*MALE_TERMS)).cast("int")
    female = F.exists(responses, lambda r: r.isin(*FEMALE_TERMS)).cast("int")
    prefers_male = male > female
    return F.struct(
        (male - female).alias("difference"),
        prefers_male.cast("int").alias("male"),
        (~prefers_male & (female == 1)).cast("int").alias("female"),
        ((male + female) == 0).cast("int").alias("invalid"),
    )


def idiom_normal(c: Column) -> Column:
    return strip(F.lower(drop_punctuation(c)))


def idiom_scores(pred: Column, completions: Column) -> Column:
    """``struct<em, f1>``: best over the accepted completions after normalisation; two empty sides agree."""
    def f1(p: Column, g: Column) -> Column:
        n, m = F.size(p), F.size(g)
        return F.when((n == 0) | (m == 0), ((n == 0) & (m == 0)).cast("double")).otherwise(token_f1(p, g))

    return let(
        F.struct(idiom_normal(pred).alias("p"), F.transform(completions, idiom_normal).alias("g")),
        lambda s: F.struct(
            F.array_max(F.transform(s["g"], lambda g: (g == s["p"]).cast("double"))).alias("em"),
            F.array_max(F.transform(s["g"], lambda g: f1(words(s["p"]), words(g)))).alias("f1"),
        ),
    )


def math_equal(pred: Column, gold: Column) -> Column:
    """Equality of the normalised final answers."""
    return (math_answer(pred) == math_answer(gold)).cast("double")


def strip_math(text: Column) -> Column:
    """``struct<out, ok>``: TeX text in one form: no spacing commands, degrees, dollar signs, percent or units on the right, a zero
    before a leading point, no short ``k =`` prefix, braces around arguments of roots and fractions, ``a/b`` as a fraction.

    ``ok`` is false where the form is undefined (two units, a root or fraction without argument, a slash between other things than two
    whole numbers); such texts are compared as they are.
    """
    plain = replace_all(
        text, ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
        ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
    )
    unit = "\\text{ "

    def from_units(x: Column) -> Column:
        bare = replace_all(F.substring_index(x, unit, 1), ("\\%", ""), (" .", " 0."), ("{.", "{0."))
        one_unit = F.size(F.split(x, r"\\text\{ ", -1)) <= 2
        return let(F.when(F.startswith(bare, F.lit(".")), F.concat(F.lit("0"), bare)).otherwise(bare), lambda y: from_prefix(y, one_unit))

    def from_prefix(y: Column, ok: Column) -> Column:
        sides = F.split(y, "=", -1)
        short = (F.size(sides) == 2) & (F.length(F.get(sides, F.lit(0))) <= 2)
        return let(F.when(short, F.get(sides, F.lit(1))).otherwise(y), lambda z: from_roots(z, ok))

    def from_roots(z: Column, ok: Column) -> Column:
        bad = F.endswith(z, F.lit("\\sqrt")) | F.contains(z, F.lit("\\sqrt\\sqrt"))
        braced = F.replace(F.regexp_replace(z, F.lit(r"\\sqrt([^{])"), F.lit(r"\\sqrt{$1}")), F.lit(" "), F.lit(""))
        return let(braced, lambda f: from_fractions(f, ok & ~bad))

    def from_fractions(f: Column, ok: Column) -> Column:
        pieces = F.split(f, r"\\frac", -1)
        later = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        cut = F.exists(later, lambda p: (F.length(p) == 1) & (p != "{"))
        def argument(p: Column) -> Column:
            a, b, rest = F.substring(p, 1, 1), F.substring(p, 2, 1), F.substr(p, F.lit(3))
            two = F.when(b == "{", F.concat(F.lit("{"), a, F.lit("}{"), rest)).otherwise(F.concat(F.lit("{"), a, F.lit("}{"), b, F.lit("}"), rest))
            return F.when(F.startswith(p, F.lit("{")), p).otherwise(two)

        joined = F.array_join(F.concat(F.slice(pieces, 1, 1), F.transform(later, argument)), "\\frac")
        done = F.when(cut | (F.size(pieces) == 1), f).otherwise(joined)
        bad = F.exists(later, lambda p: p == "")
        return let(F.when(done == "0.5", "\\frac{1}{2}").otherwise(done), lambda x: from_slash(x, ok & ~bad))

    def from_slash(x: Column, ok: Column) -> Column:
        sides = F.split(x, "/", -1)
        whole = F.forall(sides, lambda v: F.regexp_like(v, F.lit(r"\A[+-]?[0-9]+\z")))
        canonical = F.forall(sides, lambda v: F.regexp_like(v, F.lit(r"\A(0|-?[1-9][0-9]*)\z")))
        two = F.size(sides) == 2
        fraction = F.concat(F.lit("\\frac{"), F.get(sides, F.lit(0)), F.lit("}{"), F.get(sides, F.lit(1)), F.lit("}"))
        return F.struct(F.when(two & canonical, fraction).otherwise(x).alias("out"), (ok & (~two | whole)).alias("ok"))

    return let(plain, from_units)


def math_equivalent(pred: Column, gold: Column) -> Column:
    """Equality of the stripped forms, or of the texts themselves where one has no form; two nulls agree."""
    def same(s: Column) -> Column:
        both = s["p"]["ok"] & s["g"]["ok"]
        return F.when(both, s["p"]["out"] == s["g"]["out"]).otherwise(s["x"] == s["y"])

    score = let(F.struct(strip_math(pred).alias("p"), strip_math(gold).alias("g"), pred.alias("x"), gold.alias("y")), same)
    return F.when(pred.isNull() & gold.isNull(), 1.0).when(pred.isNull() | gold.isNull(), 0.0).otherwise(score.cast("double"))


def guarded(score: Column, pred: Column, gold: Column, minimum: int) -> Column:
    """NaN when a side is shorter than ``minimum``; a zero score is nudged by 1e-5."""
    short = (F.length(pred) < minimum) | (F.length(gold) < minimum)
    return F.when(short, F.lit(NAN)).otherwise(F.when(score == 0, score + 1e-5).otherwise(score))


def best_and_mean(scores: Column) -> Column:
    """``struct<best, mean>`` of an array, NaN ignored."""
    return let(
        F.filter(scores, lambda x: ~F.isnan(x)),
        lambda s: F.struct(
            F.array_max(s).alias("best"),
            F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), F.size(s)).alias("mean"),
        ),
    )


# Words that announce the key part of an open answer.
KEY_MARKERS = ("could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result ")
TRIVIAL = (":", ",", ".", "!", "?", ";", "'")


def open_parts(response: Column) -> Column:
    """Key parts of a free-form response: per line the shortest text after an announcing word, else the whole text."""
    whole = F.lower(strip(F.btrim(strip(response), F.lit("."))))
    lines = F.split(whole, "\n")

    def key_part(line: Column, last: Column) -> Column:
        tails = F.transform(
            F.filter(
                F.array(*[F.lit(m) for m in KEY_MARKERS], F.lit("=")),
                lambda m: F.contains(line, m) & ((m != "=") | last),
            ),
            lambda m: F.struct(F.length(strip(F.element_at(F.split(line, m), -1))).alias("n"), strip(F.element_at(F.split(line, m), -1)).alias("x")),
        )
        return F.array_min(F.filter(tails, lambda x: x["n"] > 0))["x"]

    def parts(s: Column) -> Column:
        found = F.filter(
            F.transform(s["l"], lambda x, i: key_part(x, i == F.size(s["l"]) - 1)),
            lambda x: x.isNotNull() & ~x.isin(*TRIVIAL),
        )
        return F.when(F.size(found) > 0, found).otherwise(F.array(s["w"]))

    return let(F.struct(lines.alias("l"), whole.alias("w")), parts)


def open_match(response: Column, golds: Column) -> Column:
    """1.0 when a gold text is inside a key part, or a gold number equals one of its numbers (two decimals)."""
    def match(p: Column) -> Column:
        numbers = F.transform(F.flatten(F.transform(p, lambda x: F.concat(F.array(x), all_numbers(x)))), number_value)
        texts = F.filter(p, lambda x: number_value(x).isNull())
        padded = lambda g: F.when(
            F.length(g) == 1, F.array(F.concat(F.lit(" "), g), F.concat(g, F.lit(" ")))
        ).otherwise(F.array(g))
        by_text = F.exists(
            golds,
            lambda g: number_value(g).isNull()
            & F.exists(padded(F.lower(strip(g))), lambda v: F.exists(texts, lambda x: F.contains(x, v))),
        )
        by_number = F.exists(golds, lambda g: F.coalesce(F.array_contains(F.filter(numbers, lambda n: n.isNotNull()), number_value(g)), F.lit(False)))
        return by_text | by_number

    return let(open_parts(response), match).cast("double")

