"""Checks of verifiable instructions, strict and loose.

An instruction is ``struct<id, words array<string>, n int, m int, relation string, text string>``; unused fields are NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import let, occurrences, strip, strip_chars, substitute

INSTRUCTION = "struct<id:string,words:array<string>,n:int,m:int,relation:string,text:string>"
WORD_SIGNS = r"[\p{L}\p{N}_]+"


def instruction(id_: str, words: list[str] | None = None, n: int | None = None, m: int | None = None,
                relation: str | None = None, text: str | None = None) -> Column:
    listed = F.array(*[F.lit(w) for w in words]) if words else F.lit(None)
    return F.struct(
        F.lit(id_).alias("id"), listed.cast("array<string>").alias("words"), F.lit(n).cast("int").alias("n"),
        F.lit(m).cast("int").alias("m"), F.lit(relation).cast("string").alias("relation"), F.lit(text).cast("string").alias("text"),
    ).cast(INSTRUCTION)


def related(count: Column, i: Column) -> Column:
    """``less than`` n, or at least n."""
    return F.when(i["relation"] == "less than", count < i["n"]).otherwise(count >= i["n"])


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def n_matches(c: Column, pattern: str) -> Column:
    return F.size(matches(c, pattern))


def has_word(c: Column, word: Column) -> Column:
    """The word between non-word signs, ignoring case."""
    said = F.transform(matches(F.lower(c), WORD_SIGNS), lambda x: x)
    phrase = F.concat(F.lit(" "), F.array_join(said, " "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.array_join(matches(F.lower(word), WORD_SIGNS), " "), F.lit(" "))
    return F.contains(phrase, wanted)


def only_edges_empty(parts: Column) -> Column:
    """No empty part except the first and the last."""
    return ~F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: strip(p) == "")


def filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: strip(p) != "")


def paragraphs(c: Column, i: Column) -> Column:
    return let(F.split(c, r"\s?\*\*\*\s?"), lambda p: only_edges_empty(p) & (F.size(filled(p)) == i["n"]))


def nth_first_word(c: Column, i: Column) -> Column:
    """``n`` paragraphs, and paragraph ``m`` starts with the word."""
    def check(p: Column) -> Column:
        first = F.get(F.split(strip(F.get(p, i["m"] - 1)), r"\s+"), F.lit(0))
        bare = F.regexp_extract(F.ltrim(first, F.lit("'\"")), r"\A[^.,?!'\"]*", 0)
        return (F.size(filled(p)) == i["n"]) & (i["m"] <= F.size(p)) & (F.lower(bare) == F.lower(i["text"]))

    return let(F.split(c, "\n\n"), check)


def sentences(c: Column) -> Column:
    return F.size(filled(F.split(c, r"[.!?]+(?:\s+|\z)")))


def postscript(c: Column, i: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(i["text"] == "P.P.S", F.regexp_like(low, F.lit(r"p\.\s?p\.\s?s")))
        .when(i["text"] == "P.S.", F.regexp_like(low, F.lit(r"p\.\s?s\.")))
        .otherwise(F.contains(low, F.lower(i["text"])))
    )


def highlights(c: Column) -> Column:
    single = F.filter(matches(c, r"\*[^\n\*]*\*"), lambda x: strip(strip_chars(x, "*")) != "")
    double = F.filter(
        matches(c, r"\*\*[^\n\*]*\*\*"), lambda x: strip(F.substr(x, F.lit(3), F.length(x) - 4)) != ""
    )
    return F.size(single) + F.size(double)


def sections(c: Column, i: Column) -> Column:
    """Headings: the marker word followed by a number."""
    pieces = F.split(c, F.concat(F.lit(r"\s?"), i["text"], F.lit(r"\s?\d+\s?")))
    return F.size(pieces) - 1 >= i["n"]


def valid_json(c: Column) -> Column:
    bare = substitute(strip(c), (r"\A```(?:json|Json|JSON)?", ""), (r"```\z", ""))
    return F.try_parse_json(strip(bare)).isNotNull()


def titled(c: Column) -> Column:
    return F.exists(matches(c, r"<<[^\n]+>>"), lambda x: strip(strip_chars(x, "<>")) != "")


def two_responses(c: Column) -> Column:
    def check(p: Column) -> Column:
        kept = filled(p)
        differ = strip(F.get(kept, F.lit(0))) != strip(F.get(kept, F.lit(1)))
        return only_edges_empty(p) & (F.size(kept) == 2) & F.coalesce(differ, F.lit(False))

    return let(F.split(c, r"\*\*\*\*\*\*"), check)


def upper_only(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def lower_only(c: Column) -> Column:
    return (F.lower(c) == c) & (F.upper(c) != c)


CONSTRAINED = ("My answer is yes.", "My answer is no.", "My answer is maybe.")

Check = Callable[[Column, Column, Column], Column]
# response, instruction, prompt -> follows
CHECKS: dict[str, Check] = {
    "keywords:existence": lambda r, i, p: F.forall(i["words"], lambda w: F.contains(F.lower(r), F.lower(w))),
    "keywords:frequency": lambda r, i, p: related(occurrences(F.lower(r), F.lower(i["text"])), i),
    "keywords:forbidden_words": lambda r, i, p: ~F.exists(i["words"], lambda w: has_word(r, w)),
    "keywords:letter_frequency": lambda r, i, p: related(occurrences(F.lower(r), F.lower(i["text"])), i),
    "length_constraints:number_sentences": lambda r, i, p: related(sentences(r), i),
    "length_constraints:number_paragraphs": lambda r, i, p: paragraphs(r, i),
    "length_constraints:number_words": lambda r, i, p: related(n_matches(r, WORD_SIGNS), i),
    "length_constraints:nth_paragraph_first_word": lambda r, i, p: nth_first_word(r, i),
    "detectable_content:number_placeholders": lambda r, i, p: n_matches(r, r"\[[^\n]*?\]") >= i["n"],
    "detectable_content:postscript": lambda r, i, p: postscript(r, i),
    "detectable_format:number_bullet_lists": lambda r, i, p: (
        n_matches(r, r"(?m)^\s*\*[^\*].*$") + n_matches(r, r"(?m)^\s*-.*$") == i["n"]
    ),
    "detectable_format:constrained_response": lambda r, i, p: F.exists(
        F.array(*[F.lit(x) for x in CONSTRAINED]), lambda x: F.contains(strip(r), x)
    ),
    "detectable_format:number_highlighted_sections": lambda r, i, p: highlights(r) >= i["n"],
    "detectable_format:multiple_sections": lambda r, i, p: sections(r, i),
    "detectable_format:json_format": lambda r, i, p: valid_json(r),
    "detectable_format:title": lambda r, i, p: titled(r),
    "combination:two_responses": lambda r, i, p: two_responses(r),
    "combination:repeat_prompt": lambda r, i, p: F.startswith(F.lower(strip(r)), F.lower(strip(F.coalesce(i["text"], p)))),
    "startend:end_checker": lambda r, i, p: F.endswith(F.lower(strip_chars(strip(r), '"')), F.lower(strip(i["text"]))),
    "change_case:capital_word_frequency": lambda r, i, p: related(F.size(F.filter(matches(r, WORD_SIGNS), upper_only)), i),
    "change_case:english_capital": lambda r, i, p: upper_only(r),
    "change_case:english_lowercase": lambda r, i, p: lower_only(r),
    "punctuation:no_comma": lambda r, i, p: ~F.contains(r, F.lit(",")),
    "startend:quotation": lambda r, i, p: let(
        strip(r), lambda s: (F.length(s) > 1) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))
    ),
}


def follows(response: Column, i: Column, prompt: Column, ids: list[str] | None = None) -> Column:
    """Whether a non-blank response follows the instruction; an unknown id is NULL."""
    out = F.lit(None).cast("boolean")
    for name in ids or list(CHECKS):
        out = F.when(i["id"] == name, CHECKS[name](response, i, prompt)).otherwise(out)
    return F.when(strip(response) == "", F.lit(False)).otherwise(out)


def loose_variants(response: Column) -> Column:
    """The response, without its first, last or both lines, each also without asterisks: up to eight different texts, without blank ones."""
    def build(lines: Column) -> Column:
        n = F.size(lines)
        join = lambda a: strip(F.array_join(a, "\n"))
        texts = [
            F.array_join(lines, "\n"),
            join(F.slice(lines, F.lit(2), n)),
            join(F.slice(lines, F.lit(1), n - 1)),
            join(F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0)))),
        ]
        # equal texts are checked once, and blank ones follow nothing
        return F.filter(F.array_distinct(F.array(*texts, *[F.replace(x, F.lit("*"), F.lit("")) for x in texts])), lambda x: strip(x) != "")

    return let(F.split(response, "\n"), build)


def check_instructions(df: DataFrame, keys: list[str], response: str, instructions: str, prompt: str,
                       ids: list[str] | None = None) -> DataFrame:
    """One row per (document, instruction): ``keys, idx, id, strict, loose``.

    The loose variants are one array per document; only the checks in ``ids`` are planned.
    """
    texts = df.select(
        *keys, F.col(response).alias("_r"), F.col(prompt).alias("_p"), loose_variants(F.col(response)).alias("_v"),
        F.posexplode(instructions).alias("idx", "_i"),
    )
    strict = follows(F.col("_r"), F.col("_i"), F.col("_p"), ids)
    loose = F.exists("_v", lambda v: F.coalesce(follows(v, F.col("_i"), F.col("_p"), ids), F.lit(False)))
    return texts.select(*keys, "idx", F.col("_i.id").alias("id"), strict.alias("strict"), loose.alias("loose"))


def prompt_level(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: all instructions followed, strict and loose."""
    return checked.groupBy(*keys).agg(F.every("strict").alias("strict"), F.every("loose").alias("loose"))
