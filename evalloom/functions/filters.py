"""Response filters: Column functions over ``array<string>`` responses, and named pipelines of them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.docs import ROMAN, letter
from evalloom.functions.text import (
    SPACE,
    let,
    replace_all,
    strip,
    substitute,
    words,
)

INVALID = "[invalid]"
# Fixed value.
ANSWER_PATTERN = r"#### (\-?[0-9\.\,]+)"


def each(responses: Column, fn) -> Column:
    return F.transform(responses, fn)


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def nth(items: Column, select: int) -> Column:
    """Python-style index: 0 is the first, -1 the last; NULL when out of range."""
    return F.try_element_at(items, F.lit(select + 1 if select >= 0 else select))


def found(text: Column, pattern: str, select: int = 0) -> Column:
    """The selected match, stripped: its first non-empty group, or the whole match when there are no groups.

    NULL without a match, empty when every group is empty.
    """
    groups = group_count(pattern)
    if groups <= 1:
        return strip(nth(F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)), select))
    picked = F.array(*[nth(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), select) for g in range(1, groups + 1)])
    # without a match every group is NULL; otherwise the first group with text, or empty
    return let(
        picked,
        lambda p: F.when(
            p[0].isNotNull(), strip(F.coalesce(F.get(F.filter(p, lambda x: x != ""), F.lit(0)), F.lit("")))
        ),
    )


def regex(responses: Column, pattern: str = ANSWER_PATTERN, select: int = 0, fallback: str = INVALID) -> Column:
    """Per response: the selected match or the fallback (also when all groups are empty)."""
    def pick(r: Column) -> Column:
        text = F.coalesce(r, F.lit(""))
        hit = found(text, pattern, select)
        if group_count(pattern) > 1:
            hit = F.nullif(hit, F.lit(""))
        return F.coalesce(hit, F.lit(fallback))

    return each(responses, pick)


# Fixed value.
POS_PATTERN = r"\('([^']*)', '([^']*)'\)"


def regex_pos(responses: Column) -> Column:
    """Tags of ``('token', 'tag')`` pairs per response, or ``["invalid"]``."""
    def tags(r: Column) -> Column:
        t = F.regexp_extract_all(r, F.lit(POS_PATTERN), F.lit(2))
        return F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("invalid")))

    return each(responses, tags)


def remove_whitespace(responses: Column) -> Column:
    return each(responses, strip)


def lowercase(responses: Column) -> Column:
    return each(responses, F.lower)


def uppercase(responses: Column) -> Column:
    return each(responses, F.upper)


def take_first(responses: Column) -> Column:
    return F.get(responses, F.lit(0))


def take_first_k(responses: Column, k: int) -> Column:
    """First ``k`` responses; fewer is an error."""
    enough = F.assert_true(F.size(responses) >= k, f"fewer than {k} responses")
    return F.when(enough.isNull(), F.slice(responses, 1, k))


def majority_vote(responses: Column) -> Column:
    """One-element array with the most frequent response; ties go to the one seen first."""
    def vote(a: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(a),
            lambda x: F.struct((F.size(a) - F.size(F.array_remove(a, x))).alias("n"), (-F.array_position(a, x)).alias("p"), x.alias("x")),
        )
        return F.array(F.array_max(ranked)["x"])

    return let(responses, vote)


def map_values(responses: Column, mapping: dict, default=None) -> Column:
    """Look every response up; a missing key gives the default, a stored NULL stays NULL."""
    if not mapping:
        return each(responses, lambda r: F.lit(default).cast("string"))
    table = F.create_map(*[F.lit(x).cast("string") for kv in mapping.items() for x in kv])
    return each(
        responses,
        lambda r: F.when(F.map_contains_key(table, r), F.try_element_at(table, r)).otherwise(F.lit(default).cast("string")),
    )


# Label synonyms, applied in this order.
SPAN_LABELS = (
    ("person", "PER"),
    ("location", "LOC"),
    ("organization", "ORG"),
    ("counties", "LOC"),
    ("places", "LOC"),
    ("people", "PER"),
    ("persons", "PER"),
    ("company", "ORG"),
    ("country", "LOC"),
    ("continent", "LOC"),
    ("time", "DATE"),
    ("date", "DATE"),
    ("per", "PER"),
    ("loc", "LOC"),
    ("org", "ORG"),
)


def format_span(responses: Column) -> Column:
    """Entity answers as ``per: a $ loc: b``: synonyms unified, lists split at commas, ``none`` dropped."""
    def one(r: Column) -> Column:
        text = replace_all(F.lower(r), *SPAN_LABELS, ("$$", "$"))
        text = strip(replace_all(substitute(text, (r"\$+\z", "")), ("\n", "$")))
        pattern = r"\b(PER|LOC|ORG|DATE):\s*([^$]+)"
        pairs = F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("l"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"),
        )
        entities = F.flatten(
            F.transform(
                pairs,
                lambda p: F.transform(
                    F.filter(F.transform(F.split(p["v"], ","), strip), lambda e: F.lower(e) != "none"),
                    lambda e: F.concat(F.lower(p["l"]), F.lit(": "), e),
                ),
            )
        )
        return F.array_join(entities, " $ ")

    return each(responses, one)


def ignoring(c: Column, ignore_case: bool = False, ignore_punctuation: bool = False, ignore_patterns: tuple = ()) -> Column:
    """Patterns dropped, then lower case, then Unicode punctuation dropped, as asked."""
    c = substitute(c, *[(p, "") for p in ignore_patterns])
    if ignore_case:
        c = F.lower(c)
    return substitute(c, (r"\p{P}", "")) if ignore_punctuation else c


def choice_in_text(text: Column, choices: Column) -> Column:
    """``(A)``-style label of the choice found leftmost in the text; the earlier choice on a tie."""
    def scan(s: Column) -> Column:
        hits = F.filter(
            F.transform(
                s["c"],
                lambda c, i: F.struct(F.position(c, s["t"]).alias("at"), i.alias("i")),
            ),
            lambda h: h["at"] > 0,
        )
        return F.array_min(hits)["i"]

    at_first = let(F.struct(text.alias("t"), choices.alias("c")), scan)
    return F.when(at_first.isNotNull(), F.concat(F.lit("("), letter(at_first), F.lit(")")))


def multi_choice_regex(responses: Column, choices: Column, pattern: str = ANSWER_PATTERN, select: int = 0,
                       fallback: str = INVALID, ignore_case: bool = False, ignore_punctuation: bool = False,
                       ignore_patterns: tuple = ()) -> Column:
    """Primary pattern, else the text of a choice, else a bare letter after a colon, else the fallback."""
    def clean(c: Column) -> Column:
        return ignoring(c, ignore_case, ignore_punctuation, ignore_patterns)

    def pick(r: Column, c: Column) -> Column:
        text = F.coalesce(r, F.lit(""))
        primary = F.nullif(found(text, pattern, select), F.lit(""))
        by_text = choice_in_text(clean(text), F.transform(c, lambda x: clean(strip(x))))
        allowed = F.filter(
            F.regexp_extract_all(text, F.lit(rf":{SPACE}*([A-Z])"), F.lit(1)), lambda x: F.ascii(x) < 65 + F.size(c)
        )
        by_letter = nth(allowed, select)
        by_letter = F.when(by_letter.isNotNull(), F.concat(F.lit("("), by_letter, F.lit(")")))
        return F.coalesce(primary, by_text, by_letter, F.lit(fallback))

    return each(responses, lambda r: pick(r, choices))


def choices_of_prompt(prompt: Column) -> Column:
    """Choice texts after ``(A)``, ``(B)`` ... in a prompt."""
    return F.transform(F.regexp_extract_all(prompt, F.lit(r"\([A-Z]\)([^\n^(]*)"), F.lit(1)), strip)


def map_regex(responses: Column, patterns: dict[str, str], select: int = 0, fallback: str = INVALID, **ignore) -> Column:
    """Match the union of the patterns, then give the value of the first pattern found in that match."""
    union = "|".join(patterns)

    def pick(r: Column) -> Column:
        whole = F.nullif(found(ignoring(F.coalesce(r, F.lit("")), **ignore), union, select), F.lit(""))

        def valued(w: Column) -> Column:
            out = F.lit(None).cast("string")
            for p, v in reversed(patterns.items()):
                hit = F.nullif(found(ignoring(w, **ignore), p, select), F.lit(""))
                out = F.when(hit.isNotNull(), F.lit(v)).otherwise(out)
            return F.coalesce(out, F.lit(fallback))

        return F.when(whole.isNull(), F.lit(fallback)).otherwise(let(whole, valued))

    return each(responses, pick)


# English number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}
NUMBER_WORDS = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)} | SCALES


def words_to_number(text: Column) -> Column:
    """Value of the first run of English number words ("two hundred and five" is 205); NULL without one."""
    names = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
    phrase = F.regexp_extract(F.lower(text), rf"\b(?:{names})(?:(?:[ -]|,? and )(?:{names}))*\b", 0)
    table = F.create_map(*[F.lit(x) for kv in ((k, float(v)) for k, v in NUMBER_WORDS.items()) for x in kv])
    values = F.transform(F.regexp_extract_all(phrase, F.lit("[a-z]+"), F.lit(0)), lambda w: F.try_element_at(table, w))
    known = F.filter(values, lambda v: v.isNotNull())

    def add(a: Column, v: Column) -> Column:
        part = F.when(v == 100, F.greatest(a["part"], F.lit(1.0)) * 100).when(v >= 1000, 0.0).otherwise(a["part"] + v)
        whole = F.when(v >= 1000, a["sum"] + F.greatest(a["part"], F.lit(1.0)) * v).otherwise(a["sum"])
        return F.struct(whole.alias("sum"), part.alias("part"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("part"))
    number = F.aggregate(known, start, add, lambda a: a["sum"] + a["part"])
    return F.when(F.size(known) > 0, number.cast("long"))


def number_parse(responses: Column, pattern: str, select: int = 0, fallback: str = INVALID) -> Column:
    """The numeric pattern, else an English number in words, else the fallback."""
    return each(
        responses,
        lambda r: F.coalesce(
            F.nullif(found(r, pattern, select), F.lit("")), words_to_number(r).cast("string"), F.lit(fallback)
        ),
    )


def word_sort(responses: Column, prompt: Column) -> Column:
    """Words of the prompt's ``List:`` in the order of their last occurrence in the response.

    The listed words themselves are searched for between word boundaries, so they may hold hyphens, apostrophes and accents.
    """
    listed = F.filter(words(F.split_part(prompt, F.lit("List:"), F.lit(2))), lambda w: w != "")
    quoted = F.transform(listed, lambda w: F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E\b")))
    pattern = F.concat(F.lit("(?U)"), F.array_join(quoted, "|"))

    def order(r: Column) -> Column:
        said = F.when(F.size(listed) > 0, F.regexp_extract_all(r, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.reverse(F.array_distinct(F.reverse(said))), " ")

    return each(responses, order)


# Fixed value.
FENCED = r"(?s)```(?:[0-9A-Za-z_]+)?\n?(.*?)\n?```"


def code_block(text: Column) -> Column:
    """First fenced block, counting an opening fence put before the text; empty without one."""
    primed = nth(F.regexp_extract_all(F.concat(F.lit("```"), text), F.lit(FENCED), F.lit(1)), 0)
    plain = nth(F.regexp_extract_all(F.replace(text, F.lit("```python"), F.lit("```")), F.lit(FENCED), F.lit(1)), 0)
    return F.coalesce(primed, plain, F.lit(""))


# Fixed value.
FINAL_LIST = r"Final Answer:\s*\[(.*)\]"


def final_list(text: Column, strict: bool = True) -> Column:
    """Items of ``Final Answer: [a, b]``: on the last line (strict) or the last line that has one."""
    lines = F.split(substitute(text, (r"\n+\z", "")), "\n")
    hits = F.filter(
        F.slice(lines, -1, 1) if strict else lines, lambda x: F.regexp_like(x, F.lit(FINAL_LIST))
    )
    body = F.regexp_extract(F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit("")), FINAL_LIST, 1)
    items = F.filter(F.split(body, ","), lambda x: strip(x) != "")
    return F.transform(items, lambda x: F.btrim(strip(x), F.lit("'\"")))


def final_list_error(text: Column, strict: bool = True) -> Column:
    """True when no final list can be parsed, so that an empty list and a missing one differ."""
    lines = F.split(substitute(text, (r"\n+\z", "")), "\n")
    return ~F.exists(F.slice(lines, -1, 1) if strict else lines, lambda x: F.regexp_like(x, F.lit(FINAL_LIST)))


# Fixed value.
MARKED_ANSWER = r"(?:Answer|answer|A|回答)\s*[:：]\s*(.+)"


def answer_line(text: Column) -> Column:
    """Text after the first answer marker, else the last non-empty line."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\n|\r"), strip), lambda x: x != "")
    marked = F.when(F.regexp_like(text, F.lit(MARKED_ANSWER)), strip(F.regexp_extract(text, MARKED_ANSWER, 1)))
    return F.coalesce(marked, F.try_element_at(lines, F.lit(-1)), F.lit(""))


def last_marked_answer(text: Column) -> Column:
    """First non-empty line after the last ``answer:``, without emphasis and brackets; empty without a marker."""
    plain = substitute(text, (r"([aA]nswer)\**:\**", "$1:"))

    def cut(p: Column) -> Column:
        after = F.right(p, F.length(F.substring_index(F.lower(p), "answer:", -1)))
        lines = F.filter(F.transform(F.split(after, "\n"), strip), lambda x: x != "")
        first = F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"[*_\[\]\(\)]", "")
        return F.when(F.contains(F.lower(p), F.lit("answer:")), first).otherwise("")

    return let(plain, cut)


def best_answer(text: Column) -> Column:
    """Word after the last "the best answer is ", letters and digits only, upper case; the text itself without one."""
    low = F.lower(text)
    tail = F.substring_index(low, "the best answer is ", -1)
    word = F.get(F.split(F.get(F.split(tail, "\n"), F.lit(0)), " "), F.lit(0))
    picked = F.upper(F.regexp_replace(word, "[^a-zA-Z0-9]", ""))
    return F.when(F.contains(low, F.lit("the best answer is")), picked).otherwise(text)


def answer_label(answer: Column, style: str = "letter") -> Column:
    """Numeral or roman answer to its letter; anything else upper-cased."""
    upper = F.upper(answer)
    if style == "letter":
        return upper
    names = ROMAN if style == "roman" else tuple(str(i) for i in range(1, 11))
    table = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, chr(65 + i))])
    return F.coalesce(F.try_element_at(table, upper), upper)


# Ordered substitutions and removals of the published final-answer normalisation.
MATH_SUBSTITUTIONS = (
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
)
MATH_REMOVED = (
    "square",
    "ways",
    "integers",
    "dollars",
    "mph",
    "inches",
    "ft",
    "hours",
    "km",
    "units",
    "\\ldots",
    "sue",
    "points",
    "feet",
    "minutes",
    "digits",
    "cents",
    "degrees",
    "cm",
    "gm",
    "pounds",
    "meters",
    "meals",
    "edges",
    "students",
    "childrentickets",
    "multiples",
    "\\text{s}",
    "\\text{.}",
    "\\text{\ns}",
    "\\text{}^2",
    "\\text{}^3",
    "\\text{\n}",
    "\\text{}",
    "\\mathrm{th}",
    "^\\circ",
    "^{\\circ}",
    "\\;",
    ",\\!",
    "{,}",
    '"',
    "\\dots",
)
# Patterns applied in this order.
MATH_PATTERNS = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
)


def math_answer(text: Column) -> Column:
    """Part after the last ``=`` with units, TeX wrappers and shorthand normalised; thousands commas dropped."""
    out = replace_all(F.substring_index(text, "=", -1), *MATH_SUBSTITUTIONS, *[(x, "") for x in MATH_REMOVED])
    out = replace_all(substitute(out, *MATH_PATTERNS), ("$", ""))
    return let(
        out,
        lambda a: F.when(F.regexp_like(F.replace(a, F.lit(","), F.lit("")), F.lit(r"\A[0-9]+\z")), F.replace(a, F.lit(","), F.lit("")))
        .otherwise(a),
    )


# Fixed value.
FINAL_PHRASE = r"Final Answer: The final answer is(.*?). I hope it is correct."


def unnormalised_answer(text: Column) -> Column:
    closed = F.concat(text, F.lit("I hope it is correct."))
    return F.when(F.regexp_like(closed, F.lit(FINAL_PHRASE)), strip(F.regexp_extract(closed, FINAL_PHRASE, 1))).otherwise(
        "[invalidanswer]"
    )


def balanced_head(text: Column) -> Column:
    """Text up to the brace that closes the first open one; null if none does. One pass over the braces with a running depth."""
    zero = F.lit(0)
    start = F.struct(zero.alias("depth"), zero.alias("at"), zero.alias("end"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(F.endswith(piece, F.lit("{")), 1).otherwise(-1)
        at = s["at"] + F.length(piece)
        closed = F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), closed.alias("end"))

    pieces = F.regexp_extract_all(text, F.lit(r"[^{}]*[{}]"), F.lit(0))
    end = F.aggregate(pieces, start, step, lambda s: s["end"])
    return let(F.struct(text.alias("t"), end.alias("e")), lambda s: F.when(s["e"] > 0, F.substring(s["t"], F.lit(1), s["e"])))


def last_boxed(text: Column) -> Column:
    """Last ``\\boxed{...}`` (or ``\\fbox``) with balanced braces; ``\\boxed x`` up to a dollar sign."""
    def after_last(t: Column, mark: str) -> Column:
        return F.concat(F.lit(mark), F.substring_index(t, mark, -1))

    def pick(t: Column) -> Column:
        spaced = F.substring_index(after_last(t, "\\boxed "), "$", 1)
        braced = F.when(F.contains(t, F.lit("\\boxed")), after_last(t, "\\boxed")).when(
            F.contains(t, F.lit("\\fbox")), after_last(t, "\\fbox")
        )
        return F.when(F.contains(t, F.lit("\\boxed ")), spaced).otherwise(balanced_head(braced))

    return let(text, pick)


def unboxed(boxed: Column) -> Column:
    """Content of a boxed expression."""
    return F.when(F.contains(boxed, F.lit("\\boxed ")), F.replace(boxed, F.lit("\\boxed "), F.lit(""))).otherwise(
        F.regexp_extract(boxed, r"(?s)\A\\boxed\{(.*)\}\z", 1)
    )


def between_dollars(text: Column) -> Column:
    """Text between the first and the last dollar sign; the whole text with fewer than two."""
    return F.when(
        F.regexp_like(text, F.lit(r"(?s)\$.*\$")), F.regexp_extract(text, r"(?s)\A[^$]*\$(.*)\$[^$]*\z", 1)
    ).otherwise(text)


def printable(text: Column) -> Column:
    """Control characters become line breaks; stripped before and after."""
    return strip(substitute(strip(text), (r"[\x{00}-\x{1f}]", "\n")))


def choice_letter(text: Column, options: Column, n: int) -> Column:
    """Letter of a multiple-choice response: ``(A)``, else `` A ``, else the text of an option.

    With several hits the last occurrence wins; NULL without any.
    """
    def last_at(t: Column, needle: Column) -> Column:
        back = F.position(F.reverse(needle), F.reverse(t))
        return F.when(back > 0, F.length(t) - back - F.length(needle) + 2).otherwise(0)

    def latest(t: Column, needles: Column) -> Column:
        spots = F.filter(
            F.transform(needles, lambda x, i: F.struct(last_at(t, x).alias("at"), (-i).alias("i"))), lambda s: s["at"] > 0
        )
        return -F.array_max(spots)["i"]

    trimmed = text
    for ch in ",.!?;:'":
        trimmed = F.btrim(trimmed, F.lit(ch))
    labels = [chr(65 + i) for i in range(n)]

    def pick(s: Column) -> Column:
        t = s["t"]
        bracketed = latest(t, F.array(*[F.lit(f"({x})") for x in labels]))
        spaced = latest(t, F.array(*[F.lit(f" {x} ") for x in labels]))
        content = F.when(F.size(words(t)) > 5, latest(F.lower(t), F.transform(s["o"], F.lower)))
        return letter(F.coalesce(bracketed, spaced, content).cast("int"))

    padded = F.concat(F.lit(" "), trimmed, F.lit(" "))
    return let(F.struct(padded.alias("t"), options.alias("o")), pick)


def last_integer(text: Column) -> Column:
    """Last number of the text as an integer; NULL when it is not one."""
    token = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1)), F.lit(-1))
    value = F.replace(F.btrim(token, F.lit(".")), F.lit(","), F.lit("")).try_cast("double")
    return F.when(value == F.floor(value), value.cast("long"))


# Fixed value.
NUMBER_FORMS = (
    r"-?\b\d{1,3}(?:,\d{3})+\b",
    r"-?\d+(?:\.\d+)?[eE][+-]?\d+",
    r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])",
)


def all_numbers(text: Column) -> Column:
    """Numbers with thousands commas, then scientific, then plain ones."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in NUMBER_FORMS])


def number_value(text: Column) -> Column:
    """Number without commas, rounded to two decimals; NULL for other text."""
    return F.round(F.replace(strip(text), F.lit(","), F.lit("")).try_cast("double"), 2)


Filter = Callable[..., Column]
FILTERS: dict[str, Filter] = {
    "regex": regex,
    "regex_pos": regex_pos,
    "remove_whitespace": remove_whitespace,
    "multi_choice_regex": multi_choice_regex,
    "take_first": take_first,
    "take_first_k": take_first_k,
    "majority_vote": majority_vote,
    "lowercase": lowercase,
    "uppercase": uppercase,
    "map": map_values,
    "format_span": format_span,
    "map_regex": map_regex,
    "number_parse": number_parse,
    "word_sort": word_sort,
}


def register_filter(name: str):
    """Make a Column function over responses available to pipelines under ``name``."""
    def add(fn: Filter) -> Filter:
        if name in FILTERS:
            raise ValueError(f"filter {name} registered twice")
        FILTERS[name] = fn
        return fn

    return add


def run_pipeline(responses: Column, steps: list) -> Column:
    """Apply steps in order; a step is a name, ``(name, arguments)`` or a Column function."""
    out = responses
    for step in steps:
        if callable(step):
            out = step(out)
            continue
        name, arguments = step if isinstance(step, tuple) else (step, {})
        out = FILTERS[name](out, **arguments)
    return out


def run_pipelines(df: DataFrame, responses: str, pipelines: dict[str, list]) -> DataFrame:
    """Every named pipeline over the same responses: one row per pipeline, ``filter`` and ``filtered``, in one pass."""
    branches = [
        F.struct(F.lit(name).alias("filter"), run_pipeline(F.col(responses), steps).alias("filtered"))
        for name, steps in pipelines.items()
    ]
    return df.withColumn("_p", F.explode(F.array(*branches))).select(*df.columns, "_p.filter", "_p.filtered")


def custom(responses: Column, fn: Callable[[Column], Column]) -> Column:
    """User function over the responses (a Column function or a vectorised UDF)."""
    return fn(responses)


FILTERS["custom"] = custom
