"""Document reshaping: clean-up rule chains, prompt parts, answer lists, tables and options."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.text import (
    SPACE,
    col,
    ends_with_space,
    let,
    replace_all,
    starts_with_space,
    stable_hash,
    strip,
    substitute,
)

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Roman numerals of the option formats.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def activity_text(c: Column | str) -> Column:
    """Strip, turn the title marker into a sentence end, drop bracketed parts, merge double blanks once."""
    return replace_all(substitute(replace_all(strip(c), (" [title]", ". ")), (r"\[[^\n]*?\]", "")), ("  ", " "))


# Ordered detokenisation rules; (literal, replacement).
DIALOGUE_RULES = (
    (" '", "'"),
    (" \n", "\n"),
    ("\n ", "\n"),
    (" n't", "n't"),
    ("`` ", '"'),
    ("''", '"'),
    (" :", ":"),
    (" ;", ";"),
    (" !", "!"),
    (" ?", "?"),
    (" ,", ","),
    (" .", "."),
)
# The three WIKI lists, in order.
WIKI_BEFORE = (
    (" @-@ ", "-"),
    (" @,@ ", ","),
    (" @.@ ", "."),
    (" : ", ": "),
    (" ; ", "; "),
    (" . ", ". "),
    (" ! ", "! "),
    (" ? ", "? "),
    (" , ", ", "),
)
WIKI_PAIRS = (
    (rf"\({SPACE}*([^\)]*?){SPACE}*\)", "($1)"),
    (rf"\[{SPACE}*([^\]]*?){SPACE}*\]", "[$1]"),
    (rf"\{{{SPACE}*([^}}]*?){SPACE}*\}}", "{$1}"),
    (rf'"{SPACE}*([^"]*?){SPACE}*"', '"$1"'),
    (rf"'{SPACE}*([^']*?){SPACE}*'", "'$1'"),
)
WIKI_AFTER = (
    ("= = = =", "===="),
    ("= = =", "==="),
    ("= =", "=="),
    (" ° ", "°"),
    (" \n", "\n"),
    ("\n ", "\n"),
    (" N ", " 1 "),
    (" 's", "'s"),
)
# Fixed values.
GENERAL_RULES = (
    (rf"{SPACE}+([.,;:!?)])", "$1"),
    (rf"({SPACE}+|^)\({SPACE}+([^)]+){SPACE}+\)", "$1($2)"),
    (rf"({SPACE}+|^)\[{SPACE}+([^)]+){SPACE}+\]", "$1[$2]"),
    (rf'({SPACE}+|^)"{SPACE}+([^"]+){SPACE}+"', '$1"$2"'),
    (rf"({SPACE}+|^)'{SPACE}+([^']+){SPACE}+'", "$1'$2'"),
)


# The sign without which a rule of brackets or quotes changes nothing, by the order of the rules.
PAIR_SIGNS = ("(", "[", "{", '"', "'")
GENERAL_SIGNS = (None, "(", "[", '"', "'")


def substitute_signed(c: Column | str, rules: tuple[tuple[str, str], ...], signs: tuple[str | None, ...]) -> Column:
    """``substitute``, but a rule runs only on texts that hold its sign: finding a sign is much cheaper than trying a pattern everywhere."""
    out = col(c)
    for rule, sign in zip(rules, signs, strict=True):
        if sign is None:
            out = substitute(out, rule)
        else:
            out = let(out, lambda text: F.when(F.contains(text, F.lit(sign)), substitute(text, rule)).otherwise(text))
    return out


def detokenize_dialogue(c: Column | str) -> Column:
    return replace_all(c, *DIALOGUE_RULES)


def detokenize_wiki(c: Column | str) -> Column:
    out = substitute_signed(replace_all(c, ("s '", "s'")), (("/' [0-9]/", "/'[0-9]/"),), ("/' ",))
    return replace_all(substitute_signed(replace_all(out, *WIKI_BEFORE), WIKI_PAIRS, PAIR_SIGNS), *WIKI_AFTER)


def detokenize_general(c: Column | str) -> Column:
    return substitute_signed(c, GENERAL_RULES, GENERAL_SIGNS)


ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
LEGACY = {name: value for name, value in html5.items() if not name.endswith(";")}  # known without a semicolon
LONGEST_LEGACY = max(map(len, LEGACY))
# What numeric references to C1 controls, NUL and carriage return stand for.
CONTROLS = dict(zip(range(0x80, 0xA0), bytes(range(0x80, 0xA0)).decode("cp1252", "replace"))) | {
    0x81: "\x81", 0x8D: "\x8d", 0x8F: "\x8f", 0x90: "\x90", 0x9D: "\x9d", 0x00: "\ufffd", 0x0D: "\r",
}


def string_map(values: dict) -> Column:
    return F.create_map(*[x for pair in values.items() for x in map(F.lit, pair)])


def code_point(number: Column) -> Column:
    """The character of a code point; nothing for code points that no text may hold."""
    held = F.try_element_at(string_map(CONTROLS), number.try_cast("int"))
    nowhere = number.between(0x1, 0x8) | number.between(0xE, 0x1F) | number.between(0x7F, 0x9F) | number.between(0xFDD0, 0xFDEF) | (
        (number % 0x10000 >= 0xFFFE) | (number == 0xB)
    )
    shown = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    outside = number.between(0xD800, 0xDFFF) | (number > 0x10FFFF) | number.isNull()
    return F.when(held.isNotNull(), held).when(outside, F.lit("\ufffd")).when(nowhere, F.lit("")).otherwise(shown)


def entity_text(entity: Column) -> Column:
    """What an entity stands for; unknown names stay, and names known without a semicolon count as a prefix."""
    by_letter: dict[str, dict[str, str]] = {}  # so that a look-up searches the names of one letter
    for name, value in html5.items():
        by_letter.setdefault(name[0], {})[name] = value
    letters = F.create_map(*[x for first, names in by_letter.items() for x in (F.lit(first), string_map(names))])
    body = F.substring(entity, 2, 40)
    number = F.coalesce(
        F.conv(F.nullif(F.regexp_extract(entity, "&#[xX]([0-9a-fA-F]{1,15})(?:;|$)", 1), F.lit("")), 16, 10),
        F.nullif(F.regexp_extract(entity, "&#([0-9]{1,18})(?:;|$)", 1), F.lit("")),
    ).cast("long")
    named = F.try_element_at(F.try_element_at(letters, F.substring(body, 1, 1)), body)
    prefix = F.coalesce(*[
        F.concat(F.try_element_at(string_map({k: v for k, v in LEGACY.items() if len(k) == n}), F.substring(body, 1, n)),
                 F.substring(body, n + 1, 40))
        for n in range(LONGEST_LEGACY, 1, -1)
    ])
    return F.when(F.startswith(body, F.lit("#")), code_point(number)).otherwise(F.coalesce(named, prefix, entity))


def html_unescaped(c: Column | str) -> Column:
    """Every named and numeric HTML entity replaced: the text is split at entities, and each is put in place of itself."""
    text = col(c)
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), entity_text)
    rest = F.split(text, ENTITY, -1)
    joined = F.array_join(F.flatten(F.zip_with(rest, found, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def repair_encoding(c: Column | str) -> Column:
    """Undo UTF-8 text that was read as Latin-1; text outside Latin-1 stays as it is."""
    c = col(c)
    is_latin = F.regexp_like(c, F.lit(r"\A[\x{00}-\x{ff}]*\z"))
    return F.coalesce(F.when(is_latin, F.try_validate_utf8(F.decode(F.encode(c, "ISO-8859-1"), "UTF-8"))), c)


def join_delimited(prefix: Column, suffix: Column, delimiter: str = " ") -> Column:
    """Prefix and suffix, with the delimiter only when neither has white space at the seam."""
    no_prefix = prefix.isNull() | (prefix == "")
    no_suffix = suffix.isNull() | (suffix == "")
    bare = ends_with_space(prefix) | starts_with_space(suffix)
    return (
        F.when(no_prefix, F.coalesce(suffix, F.lit("")))
        .when(no_suffix, prefix)
        .when(bare, F.concat(prefix, suffix))
        .otherwise(F.concat(prefix, F.lit(delimiter), suffix))
    )


def messages_text(messages: Column) -> Column:
    """Contents with their delimiters, one after the other; ``array<struct<role, content, delimiter>>``."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["content"], m["delimiter"])), "")


def _turn(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def single_turn(messages: Column) -> Column:
    """Keep a leading system message and a trailing assistant message, merge the rest into one user message."""
    def collapse(m: Column) -> Column:
        n = F.size(m)
        has_system = (n > 0) & (F.get(m, F.lit(0))["role"] == "system")
        start = F.when(has_system, 2).otherwise(1)
        has_answer = (n >= start) & (F.get(m, n - 1)["role"] == "assistant")
        count = n - start + 1 - F.when(has_answer, 1).otherwise(0)
        middle = F.slice(m, start, F.greatest(count, F.lit(0)))
        merged = F.array_join(
            F.transform(
                middle,
                lambda x, i: F.concat(x["content"], F.when(i == F.size(middle) - 1, "").otherwise(x["delimiter"])),
            ),
            "",
        )
        none = F.array().cast("array<struct<role:string,content:string>>")
        first, last = F.get(m, F.lit(0)), F.get(m, n - 1)
        return F.concat(
            F.when(has_system, F.array(_turn(first["role"], first["content"]))).otherwise(none),
            F.when(count > 0, F.array(_turn("user", merged))).otherwise(none),
            F.when(has_answer, F.array(_turn(last["role"], last["content"]))).otherwise(none),
        )

    return let(messages, collapse)


def question_history(story: Column, questions: Column, answers: Column) -> Column:
    """``story``, then ``Q:``/``A:`` pairs; the last question ends in an open ``A:``."""
    return let(
        F.struct(story.alias("s"), questions.alias("q"), answers.alias("a")),
        lambda x: F.concat(
            x["s"], F.lit("\n\n"),
            F.array_join(
                F.transform(
                    x["q"],
                    lambda q, i: F.concat(
                        F.lit("Q: "), q, F.lit("\n\n"),
                        F.when(i < F.size(x["q"]) - 1, F.concat(F.lit("A: "), F.get(x["a"], i), F.lit("\n\n"))).otherwise("A:"),
                    ),
                ),
                "",
            ),
        ),
    )


def markdown_table(headers: Column, rows: Column) -> Column:
    """Header line, rule line and one line per row."""
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    rule = F.transform(headers, lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(line(headers), line(rule)), F.transform(rows, line)), "\n")


def distinct_sorted(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def distinct_ignoring_case(items: Column) -> Column:
    """First of each group of answers equal up to case, in order."""
    def first_only(a: Column) -> Column:
        lowered = F.transform(a, F.lower)
        return let(
            lowered, lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
        )

    return let(items, first_only)


def typed_answer(number: Column, spans: Column, day: Column, month: Column, year: Column) -> Column:
    """Number if present, else the spans, else the date parts; always an array."""
    return (
        F.when(number != "", F.array(number))
        .when(F.size(spans) > 0, spans)
        .otherwise(F.array(strip(F.concat_ws(" ", day, month, year))))
    )


def letter(i: Column) -> Column:
    return F.chr(i + 65)


OPTION_STYLES = {
    "letter": lambda i: letter(i),
    "lower": lambda i: F.chr(i + 97),
    "numeral": lambda i: (i + 1).cast("string"),
    "roman": lambda i: F.get(F.array(*[F.lit(r) for r in ROMAN]), i),
}


def options_block(options: Column, style: str = "letter", before: str = "", middle: str = ". ", after: str = "\n") -> Column:
    """One formatted line per option: label in the chosen style, then the option."""
    label = OPTION_STYLES[style]
    return F.array_join(
        F.transform(options, lambda o, i: F.concat(F.lit(before), label(i), F.lit(middle), o, F.lit(after))), ""
    )


def swap(options: Column, i: Column, j: Column) -> Column:
    """The array with two 0-based positions exchanged."""
    return let(
        options,
        lambda a: F.transform(a, lambda x, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(x)),
    )


def rotate(options: Column, shift: Column) -> Column:
    """The array rotated left by ``shift`` places."""
    return let(options, lambda a: F.transform(a, lambda _, i: F.get(a, F.pmod(i + shift, F.size(a)))))


def moved_choices(options: Column, gold: Column, *key: Column | str) -> Column:
    """``struct<choices, gold>``: a hashed rotation that never leaves the gold option in its slot."""
    def move(s: Column) -> Column:
        n = F.size(s["o"])
        shift = F.when(n > 1, F.pmod(stable_hash(*key), F.greatest(n - 1, F.lit(1))) + 1).otherwise(0).cast("int")
        return F.struct(
            rotate(s["o"], shift).alias("choices"), F.pmod(s["g"] - shift, n).cast("int").alias("gold")
        )

    return let(F.struct(options.alias("o"), gold.alias("g")), move)


def shots_prompt(questions: Column, answers: Column) -> Column:
    """``Question: .. Answer: ..`` blocks of parallel arrays in one prompt."""
    return F.array_join(
        F.zip_with(
            questions, answers, lambda q, a: F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), a, F.lit("\n\n"))
        ),
        "",
    )


def two_way_order(first: Column, second: Column, *key: Column | str) -> Column:
    """``struct<scenarios, label>``: hash parity decides the order; label 1 when the original first stays first."""
    keep = F.pmod(stable_hash(*key), F.lit(2)) == 0
    return F.struct(
        F.when(keep, F.array(first, second)).otherwise(F.array(second, first)).alias("scenarios"),
        F.when(keep, 1).otherwise(0).alias("label"),
    )


def cloze(sentence: Column, options: Column, blank: str = "_") -> Column:
    """``struct<choices, target>``: text up to the blank plus each option, and the text after the blank."""
    at = F.instr(sentence, blank)
    head = F.substr(sentence, F.lit(1), at - 1)
    return F.struct(
        F.transform(options, lambda o: F.concat(head, o)).alias("choices"),
        strip(F.substr(sentence, at + 1)).alias("target"),
    )


def last_word_split(text: Column) -> Column:
    """``struct<context, target>``: everything before the last blank, and a blank with the last word."""
    parts = F.split(text, " ")
    return let(
        parts,
        lambda p: F.struct(
            F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), " ").alias("context"),
            F.concat(F.lit(" "), F.element_at(p, -1)).alias("target"),
        ),
    )


def terminated_answers(answers: Column) -> Column:
    """Non-empty stripped answers, each ending in a period."""
    kept = F.filter(F.transform(answers, strip), lambda a: a != "")
    return F.transform(kept, lambda a: F.when(F.endswith(a, F.lit(".")), a).otherwise(F.concat(a, F.lit("."))))


def with_sentinel(answers: Column, sentinel: str = "I have no comment.") -> Column:
    return let(
        answers,
        lambda a: F.when(F.array_contains(a, sentinel), a).otherwise(F.concat(a, F.array(F.lit(sentinel)))),
    )


def hashed_choices(choices: Column, correct: Column, *key: Column | str) -> Column:
    """``struct<choices, answer>``: choices in hashed order and the letter ``(A)`` of the correct text."""
    def place(s: Column) -> Column:
        tagged = F.array_sort(
            F.transform(
                s["c"], lambda x, i: F.struct(stable_hash(*key, i.cast("string")).alias("h"), i.alias("i"), x.alias("x"))
            )
        )
        return let(
            F.transform(tagged, lambda e: e["x"]),
            lambda o: F.struct(
                o.alias("choices"),
                F.concat(F.lit("("), letter(F.array_position(o, s["a"]).cast("int") - 1), F.lit(")")).alias("answer"),
            ),
        )

    return let(F.struct(choices.alias("c"), correct.alias("a")), place)


def answer_kind(unanswerable: Column, yes_no: Column, free_form: Column, spans: Column) -> Column:
    """``struct<answer, kind>`` by precedence: unanswerable, yes, free form, extractive, no."""
    def pick(answer, kind):
        return F.struct(answer.alias("answer"), F.lit(kind).alias("kind"))

    return (
        F.when(unanswerable, pick(F.lit("unanswerable"), "unanswerable"))
        .when(yes_no, pick(F.lit("yes"), "bool"))
        .when(free_form != "", pick(free_form, "free form answer"))
        .when(F.size(spans) > 0, pick(F.array_join(spans, ", "), "extractive_spans"))
        .when(~yes_no, pick(F.lit("no"), "bool"))
    )


def bio_entities(lines: Column) -> Column:
    """Entity texts ``TAG: words`` from ``word: TAG`` lines: B- opens, I- of the same tag extends, others close."""
    def parse(line: Column) -> Column:
        pair = F.split(strip(line), ": ")
        word = strip(F.btrim(F.lower(F.get(pair, F.lit(0))), F.lit(",.")))
        tag = F.upper(F.coalesce(F.get(pair, F.lit(1)), F.lit("")))
        return F.struct(word.alias("w"), tag.alias("t"))

    state = "struct<done:array<string>,tag:string,text:string>"
    blank = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("tag"), F.lit("").alias("text")).cast(state)

    def closed(a: Column) -> Column:
        return F.when(a["text"] != "", F.concat(a["done"], F.array(F.concat(a["tag"], F.lit(": "), a["text"])))).otherwise(a["done"])

    def step(a: Column, x: Column) -> Column:
        kind = F.get(F.split(x["t"], "-"), F.lit(1))
        opens = F.startswith(x["t"], F.lit("B-"))
        extends = F.startswith(x["t"], F.lit("I-")) & (kind == a["tag"])
        return (
            F.when(opens, F.struct(closed(a).alias("done"), kind.alias("tag"), x["w"].alias("text")))
            .when(extends, F.struct(a["done"].alias("done"), a["tag"].alias("tag"), F.concat(a["text"], x["w"]).alias("text")))
            .otherwise(
                F.when(
                    a["text"] != "",
                    F.struct(closed(a).alias("done"), F.lit("").alias("tag"), F.lit("").alias("text")),
                ).otherwise(a)
            )
        ).cast(state)

    rows = F.transform(F.filter(lines, lambda x: x != ""), parse)
    return F.aggregate(rows, blank, step, closed)


