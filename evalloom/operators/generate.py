"""Deterministic example generators: every draw is a stable hash of the row key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import let, stable_hash


def draw(below: Column | int, *key: Column | str) -> Column:
    """Integer in ``[0, below)`` from the key."""
    return F.pmod(stable_hash(*key), F.lit(below) if isinstance(below, int) else below)


def digits_reversed(number: Column, width: int | None = None) -> Column:
    """Decimal text written backwards, zero-padded to at least ``width`` before reversing; a wider number keeps its digits."""
    text = number.cast("string")
    return F.reverse(F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")) if width else text)


def addition_text(a: Column, b: Column, width: int | None = None) -> Column:
    """``[a] + [b] = [c]`` with reversed digits; fixed ``width`` pads the addends and gives the sum one digit more.

    For lines of one length the addends have to be below ``10 ** width``.
    """
    wider = width + 1 if width else None
    return F.concat(
        F.lit("["), digits_reversed(a, width), F.lit("] + ["), digits_reversed(b, width), F.lit("] = ["),
        digits_reversed(a + b, wider), F.lit("]"),
    )


def variable_width_number(max_width: int, *key: Column | str) -> Column:
    """Width uniform in ``1..max_width``, then uniform among the numbers of that width (no leading zero)."""
    width = draw(max_width, F.lit("width"), *key) + 1
    low = F.when(width == 1, 0).otherwise(F.pow(F.lit(10), width - 1).cast("long"))
    high = F.pow(F.lit(10), width).cast("long")
    return low + F.pmod(stable_hash(F.lit("value"), *key), high - low)


def marked_sequence(numbers: Column, marks: Column) -> Column:
    """Tokens of ``numbers`` with an ``R`` before each (1-based, sorted) index in ``marks``.

    An index one past the end puts the ``R`` last.
    """
    def build(s: Column) -> Column:
        body = F.flatten(
            F.transform(
                s["n"],
                lambda x, i: F.concat(
                    F.array_repeat(F.lit("R"), F.size(F.filter(s["m"], lambda m: m == i + 1))),
                    F.array(x.cast("string")),
                ),
            )
        )
        tail = F.array_repeat(F.lit("R"), F.size(F.filter(s["m"], lambda m: m > F.size(s["n"]))))
        return F.concat(body, tail)

    return let(F.struct(numbers.alias("n"), marks.alias("m")), build)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def numbers_between(tokens: Column) -> Column:
    """Numbers strictly between the two ``R`` tokens."""
    def cut(t: Column) -> Column:
        first = F.array_position(t, F.lit("R")).cast("int")
        last = F.size(t) + 1 - F.array_position(F.reverse(t), F.lit("R")).cast("int")
        return F.transform(F.slice(t, first + 1, last - first - 1), lambda x: x.cast("long"))

    return let(tokens, cut)


def numbers_after(tokens: Column) -> Column:
    """Numbers strictly after the first ``R`` token."""
    return let(
        tokens,
        lambda t: F.transform(
            F.slice(t, F.array_position(t, F.lit("R")).cast("int") + 1, F.size(t)), lambda x: x.cast("long")
        ),
    )


def interval_text(tokens: Column) -> Column:
    return F.concat(F.array_join(tokens, " "), F.lit(" ?interval = "), total(numbers_between(tokens)).cast("string"))


def last_text(tokens: Column) -> Column:
    return F.concat(F.array_join(tokens, " "), F.lit(" ?last = "), total(numbers_after(tokens)).cast("string"))


def hash_order(items: Column, *key: Column | str) -> Column:
    """The array shuffled by a hash of key and position."""
    tagged = F.transform(
        items, lambda x, i: F.struct(stable_hash(*key, i.cast("string")).alias("h"), i.alias("i"), x.alias("x"))
    )
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


# Fixed value: the needle sentence.
NEEDLE = "One of the special magic numbers for {key} is: {value}."


def needle(key: Column, value: Column) -> Column:
    before, rest = NEEDLE.split("{key}")
    middle, after = rest.split("{value}")
    return F.concat(F.lit(before), key, F.lit(middle), value.cast("string"), F.lit(after))


def insert_at(items: Column, inserts: Column) -> Column:
    """Insert ``struct<at, x>`` entries before the 0-based positions ``at`` of ``items`` (``at = size`` appends)."""
    def build(s: Column) -> Column:
        at = lambda i: F.transform(F.filter(s["ins"], lambda e: e["at"] == i), lambda e: e["x"])
        body = F.flatten(F.transform(s["items"], lambda x, i: F.concat(at(i), F.array(x))))
        return F.concat(body, at(F.size(s["items"])))

    return let(F.struct(items.alias("items"), inserts.alias("ins")), build)


def haystack_rows(docs: DataFrame, key: str, sentences: Column, n_keys: int, n_values: int, n_query: int,
                  seed: int = 42) -> DataFrame:
    """Needle-in-a-haystack rows: ``key, input, query, outputs``.

    ``n_keys * n_values`` needles go to sampled depths of the sentences; the answers are the values of ``n_query`` keys.
    """
    keys = F.transform(F.sequence(F.lit(1), F.lit(n_keys)), lambda k: F.concat(F.lit("key-"), draw(
        10**9, F.lit(seed), F.lit("k"), F.col(key).cast("string"), k.cast("string")).cast("string")))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(n_keys * n_values - 1)),
        lambda i: F.struct(
            F.floor(i / n_values).cast("int").alias("k"),
            (draw(9_000_000, F.lit(seed), F.lit("v"), F.col(key).cast("string"), i.cast("string")) + 1_000_000).alias("v"),
            draw(101, F.lit(seed), F.lit("d"), F.col(key).cast("string"), i.cast("string")).alias("depth"),
        ),
    )
    base = docs.select(key, sentences.alias("s"), keys.alias("keys"), cells.alias("cells"))
    placed = F.transform(
        "cells",
        lambda c: F.struct(
            F.floor(F.size("s") * c["depth"] / 100).cast("int").alias("at"),
            needle(F.get("keys", c["k"]), c["v"]).alias("x"),
        ),
    )
    asked = F.slice("keys", 1, n_query)
    return base.select(
        key,
        insert_at(F.col("s"), placed).alias("body"),
        asked.alias("asked"),
        F.transform(F.filter("cells", lambda c: c["k"] < n_query), lambda c: c["v"].cast("string")).alias("outputs"),
    ).select(
        key,
        F.array_join("body", " ").alias("input"),
        F.when(F.size("asked") > 1, F.concat_ws(", and ", F.array_join(F.slice("asked", 1, n_query - 1), ", "),
                                                F.element_at("asked", -1)))
        .otherwise(F.element_at("asked", 1)).alias("query"),
        "outputs",
    )


# Fixed value: the noise line between the assignments.
NOISE = "The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again.\n"


def variable_name(letters: int, *key: Column | str) -> Column:
    """Upper-case name of ``letters`` letters."""
    def spell(number: Column) -> Column:
        return F.concat(*[F.chr(F.pmod(F.floor(number / 26**p), F.lit(26)) + 65) for p in range(letters)])

    return let(draw(26**letters, *key), spell)


def chain_rows(rows: DataFrame, key: str, noises: int, hops: int, seed: int = 42) -> DataFrame:
    """Variable tracking: one chain ``VAR a = n``, ``VAR b = VAR a`` ... scattered over noise lines.

    ``key, input, query, outputs``: the query is the value, the answer all variables of the chain in order.
    """
    k = F.col(key).cast("string")
    names = F.transform(
        F.sequence(F.lit(0), F.lit(hops)),
        lambda i: F.concat(variable_name(5, F.lit(seed), F.lit("n"), k, i.cast("string")), F.chr(i + 65)),
    )
    base = rows.select(key, names.alias("names"), (draw(89_999, F.lit(seed), F.lit("q"), k) + 10_000).alias("value"))
    lines = F.transform(
        "names",
        lambda x, i: F.concat(
            F.lit("VAR "), x, F.lit(" = "),
            F.when(i == 0, F.col("value").cast("string")).otherwise(
                F.concat(F.lit("VAR "), F.get("names", F.greatest(i - 1, F.lit(0))), F.lit(" "))),
        ),
    )
    spots = F.array_sort(
        F.transform(
            F.slice(
                hash_order(F.sequence(F.lit(0), F.lit(noises - 1)), F.lit(seed), F.lit("p"), k), 1, hops + 1
            ),
            lambda x: x,
        )
    )
    return base.select(
        key, "value", "names", lines.alias("lines"), spots.alias("spots")
    ).select(
        key,
        F.array_join(
            insert_at(
                F.array_repeat(F.lit(NOISE), noises),
                F.zip_with("spots", "lines", lambda p, x: F.struct(p.alias("at"), x.alias("x"))),
            ),
            " ",
        ).alias("input"),
        F.col("value").cast("string").alias("query"),
        F.col("names").alias("outputs"),
    )


def numbered(items: Column) -> Column:
    """``1. a 2. b ...``"""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), " ")


def common_word_rows(lists: DataFrame, key: str, vocabulary: Column, n_common: int, common_repeats: int = 30,
                     uncommon_repeats: int = 3, seed: int = 42) -> DataFrame:
    """Numbered shuffled word list in which the first ``n_common`` vocabulary words are the frequent ones."""
    base = lists.select(key, vocabulary.alias("v")).withColumn(
        "common", F.slice("v", 1, n_common)
    )
    filled = F.flatten(
        F.transform(
            "v", lambda w, i: F.array_repeat(w, F.when(i < n_common, common_repeats).otherwise(uncommon_repeats))
        )
    )
    return base.select(
        key, numbered(hash_order(filled, F.lit(seed), key)).alias("input"), F.col("common").alias("outputs")
    )


# Fixed value: Riemann zeta at 2, the normaliser of the default exponent.
ZETA_2 = 1.6449340668482264


def zipf_count(n_words: Column | int, rank: Column, alpha: float = 2.0, zeta: float = ZETA_2) -> Column:
    """Copies of the word of ``rank`` (from 1) in a text of about ``n_words`` words."""
    n_words = F.lit(n_words) if isinstance(n_words, int) else n_words
    return F.floor(n_words * F.pow(rank.cast("double"), F.lit(-alpha)) / F.lit(zeta)).cast("int")


def coded_text_rows(lists: DataFrame, key: str, vocabulary: Column, n_words: int, seed: int = 42) -> DataFrame:
    """Zipf-distributed text over a coded vocabulary; the top word is masked, the answer is ranks 2 to 4."""
    base = lists.select(key, F.transform(vocabulary, lambda w, i: F.when(i == 0, "...").otherwise(w)).alias("v"))
    copies = F.flatten(F.transform("v", lambda w, i: F.array_repeat(w, zipf_count(n_words, i + 1))))
    return base.select(
        key,
        F.array_join(hash_order(copies, F.lit(seed), key), " ").alias("input"),
        F.slice("v", 2, 3).alias("outputs"),
    )


def distractor_rows(questions: DataFrame, passages: DataFrame, question: str, gold: str, passage: str, text: str,
                    n_docs: int, seed: int = 42) -> DataFrame:
    """Multi-document haystack: the gold passage and ``n_docs - 1`` distractors in hashed order.

    ``passage`` numbers the passages densely from 0. Distractors are probed by arithmetic on the passage number, skipping
    the gold one, so questions and passages meet in one equi-join instead of a cross join.
    """
    n = passages.count()
    span = n - 1
    if span < n_docs - 1:
        raise ValueError(f"{n_docs} passages requested, {n} available")
    step = coprime_step(span)
    offset = F.pmod(stable_hash(F.lit(seed), question), F.lit(max(span, 1)))
    others = F.transform(
        F.sequence(F.lit(0), F.lit(max(n_docs - 2, 0))),
        lambda j: F.pmod(F.col(gold) + 1 + F.pmod(offset + j * step, F.lit(max(span, 1))), F.lit(n)),
    )
    chosen = F.concat(F.array(F.col(gold)), others) if n_docs > 1 else F.array(F.col(gold))
    probes = questions.select(question, F.col(gold), F.explode(chosen).alias(passage))
    found = probes.join(passages.select(passage, text), passage)
    order = stable_hash(F.lit(seed), F.lit("order"), question, passage)
    listed = found.groupBy(question, gold).agg(
        F.array_sort(F.collect_list(F.struct(order.alias("h"), F.col(passage).alias("p"), F.col(text).alias("x")))).alias("d")
    )
    docs = F.transform(
        "d", lambda e, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), e["x"])
    )
    return listed.select(question, gold, F.col("d.p").alias("passages"), F.array_join(docs, "\n\n").alias("context"))


# Two primes for stepping through a pool; at least one of them does not divide a given pool size.
STEP_PRIMES = (2654435761, 2246822519)


def coprime_step(size: int) -> int:
    return STEP_PRIMES[0] if size % STEP_PRIMES[0] else STEP_PRIMES[1]


def filler_steps(fixed: Column, unit: Column, budget: Column, step: int) -> Column:
    """Most filler units, in multiples of ``step``, with ``fixed + units * unit <= budget``."""
    return (F.floor(F.greatest(budget - fixed, F.lit(0)) / (unit * step)) * step).cast("long")


def fitting_prefix(lengths: Column, fixed: Column, budget: Column, step: int) -> Column:
    """Like ``filler_steps`` for filler units of different lengths (an array): the running length decides."""
    def longest(s: Column) -> Column:
        walked = F.aggregate(
            s["l"],
            F.struct(F.lit(0).cast("long").alias("i"), s["f"].cast("long").alias("sum"), F.lit(0).cast("long").alias("best")),
            lambda a, x: F.struct(
                (a["i"] + 1).alias("i"),
                (a["sum"] + x).alias("sum"),
                F.when((a["sum"] + x <= s["b"]) & ((a["i"] + 1) % step == 0), a["i"] + 1).otherwise(a["best"]).alias("best"),
            ),
        )
        return walked["best"]

    return let(F.struct(lengths.alias("l"), fixed.alias("f"), budget.alias("b")), longest)
