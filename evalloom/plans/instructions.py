"""Instruction checks: assistant turns are the responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import instructions as it
from evalloom.plans import sqltext as q
from evalloom.plans.catalog import query

WORD = it.WORD_SIGNS


def rule(id_, words=None, **fields):
    """Arguments of one instruction; the Column is made when a session exists."""
    return {"id_": id_, "words": words, **fields}


# instruction and the SQL that decides it for a text x
RULES = [
    (rule("keywords:existence", ["the", "an"]), "contains(lower(x), 'the') and contains(lower(x), 'an')"),
    (rule("keywords:frequency", n=3, relation="at least", text="on"),
     "(length(x) - length(replace(lower(x), 'on', ''))) / 2 >= 3"),
    (rule("keywords:forbidden_words", ["the", "le"]),
     f"not list_has_any(regexp_extract_all(lower(x), '{WORD}'), ['the', 'le'])"),
    (rule("keywords:letter_frequency", n=40, relation="less than", text="e"),
     "length(x) - length(replace(lower(x), 'e', '')) < 40"),
    (rule("length_constraints:number_words", n=100, relation="at least"), f"len(regexp_extract_all(x, '{WORD}')) >= 100"),
    (rule("length_constraints:number_sentences", n=12, relation="less than"),
     f"len(list_filter(string_split_regex(x, '[.!?]+(?:\\s+|\\z)'), lambda s: {q.strip('s')} <> '')) < 12"),
    (rule("detectable_content:number_placeholders", n=1), "len(regexp_extract_all(x, '\\[[^\\n]*?\\]')) >= 1"),
    (rule("detectable_content:postscript", text="P.S."), "regexp_matches(lower(x), 'p\\.\\s?s\\.')"),
    (rule("detectable_format:title"), "regexp_matches(x, '<<[^\\n]+>>')"),
    (rule("startend:end_checker", text="n."), f"suffix(lower(trim({q.strip('x')}, '\"')), 'n.')"),
    (rule("change_case:english_lowercase"), "lower(x) = x and upper(x) <> x"),
    (rule("change_case:english_capital"), "upper(x) = x and lower(x) <> x"),
    (rule("change_case:capital_word_frequency", n=1, relation="less than"),
     f"len(list_filter(regexp_extract_all(x, '{WORD}'), lambda w: upper(w) = w and lower(w) <> w)) < 1"),
    (rule("punctuation:no_comma"), "not contains(x, ',')"),
    (rule("startend:quotation"), f"length({q.strip('x')}) > 1 and starts_with({q.strip('x')}, '\"') and suffix({q.strip('x')}, '\"')"),
    (rule("combination:repeat_prompt"), f"starts_with(lower({q.strip('x')}), lower({q.strip('p')}))"),
]
SAID = """(select conv_id, turn, text r, 'Say' p from conversations where role = 'assistant')"""
TESTS = ", ".join(f"coalesce({sql}, false)" for _, sql in RULES)


def variants_sql() -> str:
    join = lambda s: q.strip(f"array_to_string({s}, chr(10))")
    base = ["r", join("l[2:]"), join("l[1:len(l) - 1]"), join("l[2:len(l) - 1]")]
    return "[" + ", ".join(base + [f"replace({b}, '*', '')" for b in base]) + "]"


# one row per text variant and rule
CHECKED = f"""texts as (select conv_id, turn, p, unnest(v) x, unnest(range(8)) k from (
  select *, {variants_sql()} v from (select *, string_split(r, chr(10)) l from {SAID}))),
tests as (select conv_id, turn, k, unnest([{TESTS}]) ok, unnest(range({len(RULES)})) idx from texts where {q.strip('x')} <> ''),
checked as (select conv_id, turn, idx, coalesce(bool_or(ok) filter (where k = 0), false) strict, bool_or(ok) loose
  from tests group by all)"""


def checked(t):
    ids = [r["id_"] for r, _ in RULES]
    said = t.conversations.where("role = 'assistant'").select(
        "conv_id", "turn", "text", F.lit("Say").alias("prompt"), F.array(*[it.instruction(**r) for r, _ in RULES]).alias("rules")
    )
    return it.check_instructions(said, ["conv_id", "turn"], "text", "rules", "prompt", ids)


@query("instruction_checks", "SC-38", f"with {CHECKED} select conv_id, turn, idx::bigint idx, strict::int::bigint strict, loose::int::bigint loose from checked")
def instruction_checks(t):
    c = checked(t)
    return c.select("conv_id", "turn", *[F.col(x).cast("long").alias(x) for x in ("idx", "strict", "loose")])


@query("prompt_level_checks", "SC-38", f"""with {CHECKED} select conv_id, turn, bool_and(strict)::int::bigint strict,
  bool_and(loose)::int::bigint loose from checked group by conv_id, turn""")
def prompt_level_checks(t):
    out = it.prompt_level(checked(t), ["conv_id", "turn"])
    return out.select("conv_id", "turn", *[F.col(x).cast("long").alias(x) for x in ("strict", "loose")])


@query("instruction_level_accuracy", "AGG-20", f"""with {CHECKED} select round(avg(strict::int), 6) strict, round(avg(loose::int), 6) loose from checked""")
def instruction_level_accuracy(t):
    return checked(t).agg(
        F.round(F.avg(F.col("strict").cast("int")), 6).alias("strict"), F.round(F.avg(F.col("loose").cast("int")), 6).alias("loose")
    )


REST = [
    rule("length_constraints:number_paragraphs", n=1), rule("length_constraints:nth_paragraph_first_word", n=1, m=1, text="the"),
    rule("detectable_format:number_bullet_lists", n=0), rule("detectable_format:constrained_response"),
    rule("detectable_format:number_highlighted_sections", n=1), rule("detectable_format:multiple_sections", n=1, text="Section"),
    rule("detectable_format:json_format"), rule("combination:two_responses"),
]


@query("format_checks", "SC-38")
def format_checks(t):
    said = t.conversations.where("role = 'assistant'").select("conv_id", "turn", "text", F.array(*[it.instruction(**r) for r in REST]).alias("rules"))
    out = it.check_instructions(said, ["conv_id", "turn"], "text", "rules", "text", [r["id_"] for r in REST])
    return out.groupBy("id").agg(F.count_if("strict").alias("strict"), F.count_if("loose").alias("loose"), F.count("*").alias("n"))
