"""Response filters over responses written from the order table, and over corpus lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from evalloom.functions import filters as fl

from evalloom.plans import sqltext as q
from evalloom.plans.catalog import query

RESPS = """[' The answer is ' || o_custkey::varchar || '. ' || chr(10), 'so #### ' || (o_orderkey % 7)::varchar || ',' || o_custkey::varchar,
  'no idea ' || o_orderpriority, 'The answer is ' || (o_orderkey % 3)::varchar]"""
SRC = f"(select o_orderkey, o_custkey, o_orderstatus, {RESPS} r from orders)"


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def responses(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.array(
            text(" The answer is ", cust, ". \n"), text("so #### ", key % 7, ",", cust), text("no idea ", F.col("o_orderpriority")),
            text("The answer is ", key % 3),
        ).alias("r"),
    )


def joined(c, name="filtered"):
    return F.array_join(c, "|").alias(name)


def listed(expr: str, name: str = "filtered") -> str:
    return f"array_to_string({expr}, '|') {name}"


ANSWER = r"The answer is (\-?[0-9\.\,]*[0-9]+)"


def pick(x: str, pattern: str = ANSWER, fallback: str = "[invalid]", index: str = "1") -> str:
    return f"coalesce({q.strip(f'regexp_extract_all({x}, {chr(39)}{pattern}{chr(39)}, 1)[{index}]')}, '{fallback}')"


@query("regex_filter", "FIL-1", f"""select o_orderkey, {listed(f"[{pick('x')} for x in r]")} from {SRC}""")
def regex_filter(t):
    return responses(t).select("o_orderkey", joined(fl.regex(F.col("r"), ANSWER)))


@query("regex_last_match", "FIL-1", rf"""select doc_id, coalesce(regexp_extract_all(text, '([0-9]+)', 1)[-1], 'none') as last,
  coalesce(regexp_extract_all(text, '([0-9]+)', 1)[1], 'none') as first from documents""")
def regex_last_match(t):
    one = F.array("text")
    return t.documents.select(
        "doc_id", fl.regex(one, "([0-9]+)", -1, "none")[0].alias("last"), fl.regex(one, "([0-9]+)", 0, "none")[0].alias("first")
    )


@query("regex_groups", "FIL-1", r"""select doc_id, coalesce(nullif(coalesce(nullif(regexp_extract_all(text, '([0-9]+)|([A-Z][a-z]+)', 1)[1], ''),
  regexp_extract_all(text, '([0-9]+)|([A-Z][a-z]+)', 2)[1]), ''), '[invalid]') hit from documents""")
def regex_groups(t):
    return t.documents.select("doc_id", fl.regex(F.array("text"), "([0-9]+)|([A-Z][a-z]+)")[0].alias("hit"))


@query("pos_tags", "FIL-2", """select o_orderkey, 'NOUN|' || o_orderstatus tags from orders""")
def pos_tags(t):
    said = text("[('order', 'NOUN'), ('x', '", F.col("o_orderstatus"), "')]")
    return t.orders.select("o_orderkey", joined(fl.regex_pos(F.array(said))[0], "tags"))


@query("whitespace_filter", "FIL-3", f"select o_orderkey, {listed(f'[{q.strip(chr(120))} for x in r]')} from {SRC}")
def whitespace_filter(t):
    return responses(t).select("o_orderkey", joined(fl.remove_whitespace(F.col("r"))))


@query("multi_choice_filter", "FIL-4", f"""select p_partkey, case p_partkey % 5 when 0 then '(B)' when 1 then
  case when position(lower(p_type) in lower('it is ' || p_name)) between 1 and 7 then '(A)' else '(C)' end
  when 2 then '(A)' when 3 then '(B)' else '[invalid]' end answer from part""")
def multi_choice_filter(t):
    k = F.col("p_partkey") % 5
    said = (
        F.when(k == 0, "so #### (B)").when(k == 1, F.concat(F.lit("it is, "), F.upper("p_name"), F.lit("!")))
        .when(k == 2, F.concat(F.lit("of "), "p_type", F.lit(" kind"))).when(k == 3, "final:  B").otherwise("?? : Z")
    )
    out = fl.multi_choice_regex(
        F.array(said), F.array("p_type", "p_brand", "p_name"), r"#### (\([A-Z]\))", ignore_case=True, ignore_punctuation=True
    )
    return t.part.select("p_partkey", out[0].alias("answer"))


@query("choice_in_corpus", "FIL-4", """with h as (select doc_id, unnest(['the', 'der', 'les', 'que']) c, unnest(range(4)) i, lower(text) x from documents),
p as (select doc_id, i, position(c in x) at_pos from h)
select doc_id, coalesce('(' || chr(65 + min_by(i, at_pos * 10 + i) filter (where at_pos > 0)::int) || ')', '[invalid]') answer
from p group by doc_id""")
def choice_in_corpus(t):
    choices = F.array(*[F.lit(x) for x in ("the", "der", "les", "que")])
    out = fl.multi_choice_regex(F.array("text"), choices, r"#### \(never\)", ignore_case=True)
    return t.documents.select("doc_id", out[0].alias("answer"))


@query("prompt_choice_filter", "FIL-4b", """select p_partkey, case when p_partkey % 2 = 0 then '(A)' else '(B)' end answer from part""")
def prompt_choice_filter(t):
    prompt = F.concat(F.lit("Which?\n(A) one "), "p_brand", F.lit(" \n(B) two "), "p_name", F.lit("\n"))
    even = F.col("p_partkey") % 2 == 0
    said = F.concat(F.lit("I take "), F.when(even, F.concat(F.lit("one "), "p_brand")).otherwise(F.concat(F.lit("two "), "p_name")))
    out = fl.multi_choice_regex(F.array(said), fl.choices_of_prompt(prompt), r"\(([A-Z])\)")
    return t.part.select("p_partkey", out[0].alias("answer"))


@query("first_response", "FIL-5", f"select o_orderkey, r[1] answer from {SRC}")
def first_response(t):
    return responses(t).select("o_orderkey", fl.take_first(F.col("r")).alias("answer"))


@query("first_k_responses", "FIL-6", f"select o_orderkey, {listed('r[1:2]')} from {SRC}")
def first_k_responses(t):
    return responses(t).select("o_orderkey", joined(fl.take_first_k(F.col("r"), 2)))


@query("majority_vote", "FIL-7", """with w as (select doc_id, unnest(l) x, generate_subscripts(l, 1) i from (
  select doc_id, string_split(text, chr(10)) l from documents)),
c as (select doc_id, x, count(*) n, min(i) i from w group by doc_id, x)
select doc_id, x vote from (select *, row_number() over (partition by doc_id order by n desc, i) r from c) where r = 1""")
def majority_vote(t):
    return t.documents.select("doc_id", fl.majority_vote(F.split("text", "\n"))[0].alias("vote"))


@query("case_filters", "FIL-8/9", f"select o_orderkey, {listed('[lower(x) for x in r]', 'lowered')}, {listed('[upper(x) for x in r]', 'uppered')} from {SRC}")
def case_filters(t):
    return responses(t).select("o_orderkey", joined(fl.lowercase(F.col("r")), "lowered"), joined(fl.uppercase(F.col("r")), "uppered"))


@query("map_filter", "FIL-10", """select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'full' else 'other' end mapped,
  case o_orderstatus when 'O' then null else 'zero' end kept_null from orders""")
def map_filter(t):
    one = F.array("o_orderstatus")
    return t.orders.select(
        "o_orderkey", fl.map_values(one, {"O": "open", "F": "full"}, "other")[0].alias("mapped"),
        fl.map_values(one, {"O": None}, "zero")[0].alias("kept_null"),
    )


@query("span_filter", "FIL-11", """select o_orderkey, 'per: c' || o_custkey::varchar || ' $ per: bob' || case when o_orderkey % 2 = 0 then ' $ loc: '
  || lower(o_orderstatus) || 'x' else '' end spans from orders""")
def span_filter(t):
    where = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit("x"))).otherwise("none")
    said = text("Person: C", F.col("o_custkey"), ", Bob $$ Location: ", where, " $$ ORG: None")
    return t.orders.select("o_orderkey", fl.format_span(F.array(said))[0].alias("spans"))


def third_word(r):
    @F.arrow_udf("array<string>")
    def pick_third(resps: pa.Array) -> pa.Array:
        return pa.array([[(x.split() + [""] * 3)[2] for x in row] for row in resps.to_pylist()], pa.list_(pa.string()))

    return pick_third(r)


@query("custom_filter", "FIL-12 UDF-2", f"select o_orderkey, {listed(f'[coalesce({q.words(chr(120))}[3], {chr(39) * 2}) for x in r]')} from {SRC}")
def custom_filter(t):
    return responses(t).select("o_orderkey", joined(fl.run_pipeline(F.col("r"), [("custom", {"fn": third_word})])))


@query("map_regex_filter", "FIL-13", r"""select o_orderkey, case when split_part(o_orderpriority, '-', 1) in ('1', '2') then 'high'
  when split_part(o_orderpriority, '-', 1) = '3' then 'middle' else '[invalid]' end mapped from orders""")
def map_regex_filter(t):
    said = F.concat(F.lit("prio "), "o_orderpriority")
    return t.orders.select("o_orderkey", fl.map_regex(F.array(said), {"[12]-": "high", "3-[A-Z]+": "middle"})[0].alias("mapped"))




@query("number_filter", "FIL-14", """select o_orderkey, case when o_orderkey % 3 = 0 then o_custkey::varchar when o_orderkey % 3 = 1
  then ((o_orderkey % 9 + 1) * 100 + (o_custkey % 8 + 2) * 10 + o_orderkey % 9 + 1)::varchar else '[invalid]' end num from orders""")
def number_filter(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ones, tens = F.array(*[F.lit(x) for x in fl.UNITS[1:10]]), F.array(*[F.lit(x) for x in fl.TENS])
    one = F.get(ones, (k % 9).cast("int"))
    worded = F.concat(F.lit("I think "), one, F.lit(" hundred and "), F.get(tens, (c % 8).cast("int")), F.lit("-"), one, F.lit(" items"))
    said = F.when(k % 3 == 0, text("it is ", c, " now")).when(k % 3 == 1, worded).otherwise("none at all")
    return t.orders.select("o_orderkey", fl.number_parse(F.array(said), "([0-9]+)")[0].alias("num"))


@query("word_sort_filter", "FIL-15", """with w as (select doc_id, unnest(l) x, generate_subscripts(l, 1) i from (
  select doc_id, regexp_extract_all(case when doc_id % 2 = 0 then 'café ' || text || ' co-op it''s café' else text end,
    'co-op|it''s|[\\pL\\pN\\p{Mn}_]+') l from documents)),
k as (select doc_id, x, max(i) i from w where x in ('the', 'of', 'and', 'der', 'que', 'co-op', 'café', 'it''s') group by doc_id, x)
select doc_id, coalesce(string_agg(x, ' ' order by i), '') sorted from documents left join k using (doc_id) group by doc_id""")
def word_sort_filter(t):
    prompt = F.lit("Sort. List: the of and der que co-op café it's")
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("café "), "text", F.lit(" co-op it's café"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", fl.word_sort(F.array(said), prompt)[0].alias("sorted"))


@query("code_blocks", "FIL-16", """select doc_id, case when doc_id % 2 = 0 then md5(text) else md5('') end digest from documents""")
def code_blocks(t):
    fenced = F.concat(F.lit("Sure.\n```python\n"), F.col("text"), F.lit("\n``` ok"))
    odd = F.concat(F.lit("nothing `here` "), F.col("text"))
    said = F.when(F.col("doc_id") % 2 == 0, F.substring_index(fenced, "Sure.\n```", -1)).otherwise(odd)
    return t.documents.select("doc_id", F.md5(fl.code_block(said)).alias("digest"))


@query("final_lists", "FIL-17", """select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 5 <> 0 then o_custkey::varchar || '|b' else '' end strict,
  case when o_orderkey % 5 = 0 then '' else o_custkey::varchar || '|b' end flexible,
  o_orderkey % 2 <> 0 as strict_error, false as flexible_error from orders""")
def final_lists(t):
    line = F.when(F.col("o_orderkey") % 5 == 0, F.lit("Final Answer: [ ]")).otherwise(text("Final Answer: ['", F.col("o_custkey"), "', b ]"))
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x\n"), line, F.lit("\n"))).otherwise(F.concat(line, F.lit("\nthe end")))
    return t.orders.select(
        "o_orderkey", joined(fl.final_list(said), "strict"), joined(fl.final_list(said, False), "flexible"),
        fl.final_list_error(said).alias("strict_error"), fl.final_list_error(said, False).alias("flexible_error"),
    )


@query("answer_lines", "FIL-18", f"""select doc_id, md5(case when regexp_matches(text, '(?:Answer|answer|A|回答)\\s*[:：]\\s*(.+)')
  then {q.strip("regexp_extract(text, '(?:Answer|answer|A|回答)\\s*[:：]\\s*(.+)', 1)")}
  else coalesce(list_filter([{q.strip('x')} for x in string_split(text, chr(10))], lambda x: x <> '')[-1], '') end) digest,
  'of ' || lang marked from documents""")
def answer_lines(t):
    said = F.concat(F.lit("Answer**: first\nso **Answer:** \n\n *of ["), "lang", F.lit("]*\nbye"))
    return t.documents.select(
        "doc_id", F.md5(fl.answer_line(F.col("text"))).alias("digest"), fl.last_marked_answer(said).alias("marked")
    )


@query("best_answers", "FIL-19", """select o_orderkey, upper(o_orderstatus) letter, chr(65 + (o_orderkey % 10)::int) numeral,
  o_orderpriority as plain from orders""")
def best_answers(t):
    said = F.concat(F.lit("Hm. The best answer is **"), F.lower("o_orderstatus"), F.lit("**. done\nmore"))
    numeral = text("the best answer is ", F.col("o_orderkey") % 10 + 1)
    return t.orders.select(
        "o_orderkey", fl.answer_label(fl.best_answer(said)).alias("letter"),
        fl.answer_label(fl.best_answer(numeral), "numeral").alias("numeral"),
        fl.best_answer(F.col("o_orderpriority")).alias("plain"),
    )


@query("math_answers", "FIL-20", r"""select o_orderkey, '\frac{' || (o_orderkey % 9 + 1)::varchar || '}{7}' frac, o_custkey::varchar || '000' thousands,
  '\sqrt{' || (o_orderkey % 9)::varchar || '}' root from orders""")
def math_answers(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    closed = text("Final Answer: The final answer is $x = \\frac", k % 9 + 1, "7$. I hope it is correct.")
    return t.orders.select(
        "o_orderkey", fl.math_answer(fl.unnormalised_answer(closed)).alias("frac"),
        fl.math_answer(text("\\text{}", c, ",000 dollars")).alias("thousands"),
        fl.math_answer(text("the \\boxed{\\sqrt", k % 9, "} units")).alias("root0"),
    ).select("o_orderkey", "frac", "thousands", F.regexp_replace("root0", "^the", "").alias("root"))


@query("boxed_answers", "FIL-21", r"""select o_orderkey, '\boxed{\frac{' || o_custkey::varchar || '}{2}}' boxed, '\frac{' || o_custkey::varchar || '}{2}' inside,
  'x$=$' || o_custkey::varchar dollars from orders""")
def boxed_answers(t):
    c = F.col("o_custkey")
    said = text("\\boxed{1} so \\boxed{\\frac{", c, "}{2}} {done}")
    boxed = t.orders.select("o_orderkey", "o_custkey", fl.last_boxed(said).alias("boxed"))
    return boxed.select(
        "o_orderkey", "boxed", fl.unboxed(F.col("boxed")).alias("inside"),
        fl.between_dollars(text("is $x$=$", c, "$ ok")).alias("dollars"),
    )


@query("printable_text", "FIL-22", f"""select doc_id, md5({q.strip("regexp_replace(" + q.strip("replace(text, ' ', chr(9))") + ", '[\\x{00}-\\x{1f}]', chr(10), 'g')")}) digest
from documents""")
def printable_text(t):
    return t.documents.select("doc_id", F.md5(fl.printable(F.replace("text", F.lit(" "), F.lit("\t")))).alias("digest"))


@query("choice_letters", "FIL-23", """select p_partkey, case p_partkey % 4 when 0 then 'A' when 1 then 'C' when 2 then 'B' end letter from part""")
def choice_letters(t):
    k = F.col("p_partkey") % 4
    said = (
        F.when(k == 0, "not (C) but (A).").when(k == 1, "so B or C .")
        .when(k == 2, F.concat(F.lit("I am quite sure that it is "), F.upper("p_brand"), F.lit("!"))).otherwise("I do not know this at all")
    )
    options = F.array(F.lit("qqq"), "p_brand", F.lit("zzz"))
    return t.part.select("p_partkey", fl.choice_letter(said, options, 3).alias("letter"))


@query("last_integers", "FIL-24", r"""select doc_id, case when v = floor(v) then v::bigint end answer from (select doc_id,
  try_cast(replace(trim(regexp_extract_all(text, '(\-?[0-9\.\,]+)', 1)[-1], '.'), ',', '') as double) v from documents)""")
def last_integers(t):
    return t.documents.select("doc_id", fl.last_integer(F.col("text")).alias("answer"))


@query("number_forms", "FIL-25", r"""select doc_id, len(regexp_extract_all(text, '-?\b\d{1,3}(?:,\d{3})+\b'))::bigint with_commas,
  len(regexp_extract_all(text, '-?\d+(?:\.\d+)?[eE][+-]?\d+'))::bigint scientific,
  len(regexp_extract_all(translate(text, ',.', '  '), '\d+(?:[^0-9A-Za-z_]|$)'))::bigint plain from documents""")
def number_forms(t):
    # whole numbers only in the plain form, since the SQL has no look-ahead; number_values has the others
    whole = F.translate("text", ",.", "  ")
    texts = (F.col("text"), F.col("text"), whole)
    counts = [F.size(F.regexp_extract_all(x, F.lit(p), F.lit(0))).cast("long") for x, p in zip(texts, fl.NUMBER_FORMS)]
    return t.documents.select("doc_id", counts[0].alias("with_commas"), counts[1].alias("scientific"), counts[2].alias("plain"))


@query("number_values", "FIL-25", """select o_orderkey, case when o_custkey < 1000 then o_custkey::varchar || ',123|' else '' end || '1e5|' || (o_orderkey % 7)::varchar || '.5|123|5' numbers,
  round((o_custkey * 1000 + 123)::double, 2) as value from orders""")
def number_values(t):
    said = text("between ", F.col("o_orderkey") % 7, ".5 and ", F.col("o_custkey"), ",123 or 1e5")
    return t.orders.select(
        "o_orderkey", joined(fl.all_numbers(said), "numbers"), fl.number_value(text(F.col("o_custkey") * 1000 + 123)).alias("value")
    )


PIPE = {
    "score-first": [("regex", {"pattern": ANSWER}), "take_first"],
    "maj": [("regex", {"pattern": ANSWER}), "majority_vote", "take_first"],
    "maj@2": [("take_first_k", {"k": 2}), ("regex", {"pattern": ANSWER}), "majority_vote", "take_first"],
}


@query("filter_ensembles", "FIL-0", f"""with f as (select o_orderkey, [{pick('x')} for x in r] a from {SRC}),
e as (select o_orderkey, unnest(a) x, generate_subscripts(a, 1) i from f),
c as (select o_orderkey, x, count(*) n, min(i) i, count(*) filter (where i <= 2) n2 from e group by 1, 2),
v as (select o_orderkey, x, row_number() over (partition by o_orderkey order by n desc, i) r from c),
w as (select o_orderkey, x, row_number() over (partition by o_orderkey order by n2 desc, i) r from c)
select o_orderkey, 'score-first' as filter, a[1] filtered from f union all select o_orderkey, 'maj', x from v where r = 1
union all select o_orderkey, 'maj@2', x from w where r = 1""")
def filter_ensembles(t):
    return fl.run_pipelines(responses(t).select("o_orderkey", "r"), "r", PIPE).select("o_orderkey", "filter", "filtered")


