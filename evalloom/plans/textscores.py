"""Text scores: an assistant turn is the response, the user turn before it the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import textscore as ts
from evalloom.functions.numbers import rounded
from evalloom.functions.text import words
from evalloom.plans import sqltext as q
from evalloom.plans.catalog import query

PAIRS = """(select a.conv_id, a.turn, a.text p, u.text r from conversations a join conversations u
  on a.conv_id = u.conv_id and a.turn = u.turn + 1 where a.role = 'assistant' and u.role = 'user')"""
KEY = ["conv_id", "turn"]


def pairs(t):
    said = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("p"))
    asked = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("r"))
    return said.join(asked, KEY)


def r6(c, name):
    return rounded(c, 6).alias(name)


PARTS = "split_part(p, '.', 1)"


@query("exact_match", "SC-20", f"""select conv_id, turn, (a = b)::int::double as exact, (lower(a) = lower(b))::int::double folded,
  ({q.drop_punctuation('lower(a)')} = {q.drop_punctuation('lower(b)')})::int::double bare,
  (regexp_replace(a, '[aeiou]', '', 'g') = regexp_replace(b, '[aeiou]', '', 'g'))::int::double pattern
from (select conv_id, turn, replace(p, 'e', 'E') a, case when conv_id % 3 = 0 then p when conv_id % 3 = 1 then p || ',' else r end b from {PAIRS})""")
def exact_match(t):
    d = pairs(t).select(
        *KEY, F.replace("p", F.lit("e"), F.lit("E")).alias("a"),
        F.when(F.col("conv_id") % 3 == 0, F.col("p")).when(F.col("conv_id") % 3 == 1, F.concat("p", F.lit(","))).otherwise(F.col("r")).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return d.select(
        *KEY, ts.exact_match(a, b).alias("exact"), ts.exact_match(a, b, ignore_case=True).alias("folded"),
        ts.exact_match_any(a, F.array(b), ignore_case=True, ignore_punctuation=True).alias("bare"),
        ts.exact_match(a, b, ignore_patterns=("[aeiou]",)).alias("pattern"),
    )


@query("qa_normalised", "SC-21", f"select doc_id, md5({q.qa_normal('text')}) digest from documents")
def qa_normalised(t):
    return t.documents.select("doc_id", F.md5(ts.qa_normal(F.col("text"))).alias("digest"))


def f1_sql(a: str, b: str) -> str:
    return f"case when {q.overlap(a, b)} > 0 then 2.0::double * {q.overlap(a, b)} / (len({a}) + len({b})) else 0 end"


TOKENS = f"(select conv_id, turn, {q.words(q.qa_normal('p'))} a, {q.words(q.qa_normal('r'))} b, p, r from {PAIRS})"


@query("token_f1", "SC-22", f"""select conv_id, turn, round({f1_sql('a', 'b')}, 6) f1, round(greatest({f1_sql('a', 'b')}, {f1_sql('a', 'c')}), 6) best_f1
from (select *, {q.words(q.qa_normal("split_part(p, '.', 2)"))} c from {TOKENS})""")
def token_f1(t):
    golds = F.array(F.col("r"), F.split_part("p", F.lit("."), F.lit(2)))
    return pairs(t).select(*KEY, r6(ts.qa_f1(F.col("p"), F.col("r")), "f1"), r6(ts.best(golds, lambda g: ts.qa_f1(F.col("p"), g)), "best_f1"))


@query("char_f1", "SC-23", f"select conv_id, turn, round({f1_sql('a', 'b')}, 6) f1 from (select conv_id, turn, string_split(p, '') a, string_split(r, '') b from {PAIRS})")
def char_f1(t):
    return pairs(t).select(*KEY, r6(ts.char_f1(F.col("p"), F.col("r")), "f1"))


@query("leave_one_out", "SC-24", f"""select conv_id, turn, round((greatest(y, z) + greatest(x, z) + greatest(x, y)) / 3, 6) f1 from (
  select conv_id, turn, {f1_sql('a', 'b')} x, {f1_sql('a', 'c')} y, {f1_sql('a', 'd')} z from (
    select *, {q.words(q.qa_normal("split_part(p, '.', 2)"))} c, {q.words(q.qa_normal("split_part(r, '.', 1)"))} d from {TOKENS}))""")
def leave_one_out(t):
    golds = F.array(F.col("r"), F.split_part("p", F.lit("."), F.lit(2)), F.split_part("r", F.lit("."), F.lit(1)))
    return pairs(t).select(*KEY, r6(ts.leave_one_out(golds, lambda g: ts.qa_f1(F.col("p"), g)), "f1"))


def span_sql(x: str) -> str:
    token = q.squeeze(q.articles_gone(q.drop_punctuation("lower(y)")))
    return f"list_distinct({q.words(f'''array_to_string(list_filter([{token} for y in string_split_regex({x}, ' |-')], lambda z: z <> ''), ' ')''')})"


@query("span_alignment", "SC-25", f"""select conv_id, turn, (list_sort(a) = list_sort(b))::int::double em, round_even(case when s = 0 then 0 else
  2.0::double * s / (len(a) + len(b)) end, 2) f1 from (select *, len(list_intersect(a, b)) s from (
  select conv_id, turn, {span_sql('p')} a, {span_sql('r')} b from {PAIRS}))""")
def span_alignment(t):
    one, gold = F.array(F.col("p")), F.array(F.col("r"))
    return pairs(t).select(*KEY, ts.spans_exact(one, gold).alias("em"), ts.spans_f1(one, gold).alias("f1"))


@query("multi_span_alignment", "SC-25")
def multi_span_alignment(t):
    split = lambda c: F.filter(F.split(c, r"\."), lambda x: F.trim(x) != "")
    return pairs(t).select(*KEY, r6(ts.spans_f1(split(F.col("p")), split(F.col("r"))), "f1"))


@query("set_f1", "SC-26", f"""select conv_id, turn, round(case when s > 0 then 2.0::double * s / (len(a) + len(b)) else 0 end, 6) f1 from (
  select *, len(list_intersect(a, b)) s from (select conv_id, turn, list_distinct({q.words('p')}) a, list_distinct({q.words('r')}) b from {PAIRS}))""")
def set_f1(t):
    return pairs(t).select(*KEY, r6(ts.set_f1(words(F.col("p")), words(F.col("r"))), "f1"))


@query("number_hits", "SC-27", """select doc_id, round(case when len(n) > 0 then len(list_filter(n, lambda x: x = '1')) / len(n) else 0 end, 6) hit,
  round(case when len(n) > 0 then len(list_filter(n, lambda x: x = (doc_id % 10)::varchar)) / len(n) else 0 end, 6) paragraph
from (select doc_id, regexp_extract_all(text, '\\d+') n from documents)""".replace("\\\\", "\\"))
def number_hits(t):
    gold = F.concat(F.lit("Paragraph "), (F.col("doc_id") % 10).cast("string"), F.lit(" of 3"))
    return t.documents.select(
        "doc_id", r6(ts.number_hit_rate(F.col("text"), F.lit("1")), "hit"), r6(ts.paragraph_hit_rate(F.col("text"), gold), "paragraph")
    )


@query("class_scores", "SC-28", """with n as (select doc_id, case when doc_id % 2 = 0 then 'the' else 'tion' end g,
  list_filter(['the', 'he', 'tion', 'qqq'], lambda c: contains(text, c)) k from documents)
select doc_id, round(case when list_contains(f, g) then 1.0::double / len(f) else 0 end, 6) score from (
  select doc_id, g, list_filter(k, lambda c: c = g or not contains(g, c)) f from n)""")
def class_scores(t):
    classes = F.array(*[F.lit(c) for c in ("the", "he", "tion", "qqq")])
    gold = F.when(F.col("doc_id") % 2 == 0, "the").otherwise("tion")
    return t.documents.select("doc_id", r6(ts.class_score(F.col("text"), gold, classes), "score"))


@query("code_edit_similarity", "SC-29", """select p_partkey, round(1 - levenshtein(p_name, p_type || ' bolt')::double
  / greatest(length(p_name), length(p_type || ' bolt')), 6) score from part""")
def code_edit_similarity(t):
    code = F.concat(F.lit("\n# comment\n"), "p_name", F.lit("\nmore"))
    return t.part.select("p_partkey", r6(ts.code_similarity(code, F.concat("p_type", F.lit(" bolt")), "edit"), "score"))


@query("code_similarity", "SC-29")
def code_similarity(t):
    return pairs(t).select(*KEY, r6(ts.code_similarity(F.col("p"), F.col("r")), "score"))


@query("contained_strings", "SC-30", f"""select conv_id, turn, (contains(lower(p), 'the') or contains(lower(p), lower(w)))::int::double as any_hit,
  round((contains(lower(p), 'the')::int + contains(lower(p), lower(w))::int) / 2, 6) share,
  round(greatest(contains(lower(p), 'the')::int, contains(lower(r), lower(w))::int)::double / 2, 6) part
from (select *, coalesce({q.words('r')}[2], 'zz') w from {PAIRS})""")
def contained_strings(t):
    w = F.coalesce(F.get(words(F.col("r")), F.lit(1)), F.lit("zz"))
    d = pairs(t).select(*KEY, "p", "r", w.alias("w"))
    refs = F.array(F.lit("THE"), F.col("w"))
    lists = F.array(F.array(F.lit("THE")), F.array(F.col("w")))
    return d.select(
        *KEY, ts.contains_any(F.col("p"), refs).alias("any_hit"), r6(ts.match_all(F.array(F.col("p")), F.array(refs)), "share"),
        r6(ts.match_part(F.array(F.col("p"), F.col("r")), lists), "part"),
    )


ROUGE = f"(select conv_id, turn, regexp_extract_all(lower(p), '[a-z0-9]+') a, regexp_extract_all(lower(r), '[a-z0-9]+') b from {PAIRS})"
BIGRAMS = "[{0}[i] || ' ' || {0}[i + 1] for i in range(1, len({0}))]"


@query("rouge_n", "SC-31", f"""select conv_id, turn, round({f1_sql('a', 'b')}, 6) rouge1, round({f1_sql('c', 'd')}, 6) rouge2 from (
  select *, {BIGRAMS.format('a')} c, {BIGRAMS.format('b')} d from {ROUGE})""")
def rouge_n(t):
    return pairs(t).select(*KEY, r6(ts.rouge_n(F.col("p"), F.col("r"), 1), "rouge1"), r6(ts.rouge_n(F.col("p"), F.col("r"), 2), "rouge2"))


@query("rouge_l", "SC-32")
def rouge_l(t):
    return pairs(t).select(*KEY, r6(ts.rouge_l(F.col("p"), F.col("r")), "rouge_l"), r6(ts.rouge_lsum(F.col("p"), F.col("r")), "rouge_lsum"))


BLEU_TOKENS = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{q.SPACE_CLASS[1:-1]}]"


def gram_list(x: str, n: int) -> str:
    return "[" + " || ' ' || ".join(f"{x}[i + {k}]" for k in range(n)) + f" for i in range(1, len({x}) - {n} + 2)]"


BLEU_ROWS = f"""(select conv_id, turn, a, b, {', '.join(f"{q.overlap(gram_list('a', n), gram_list('b', n))}::bigint c{n}" for n in range(1, 5))}
  from (select conv_id, turn, regexp_extract_all(lower({q.strip('p')}), '{BLEU_TOKENS}') a,
    regexp_extract_all(lower({q.strip('r')}), '{BLEU_TOKENS}') b from {PAIRS}))"""


@query("sentence_bleu", "SC-33", f"""select conv_id, turn, round(exp((
  {' + '.join(f"ln(c{n} + {int(n > 1)} + 2.2250738585072014e-308) - ln(greatest(len(a) - {n - 1}, 0) + {int(n > 1)} + 2.2250738585072014e-308)" for n in range(1, 5))}) / 4
  + least(0, 1 - (len(b) + 1)::double / (len(a) + 1))), 6) bleu from {BLEU_ROWS}""")
def sentence_bleu(t):
    return pairs(t).select(*KEY, r6(ts.sentence_bleu(ts.bleu_stats(F.col("p"), F.array(F.col("r")))), "bleu"))


@query("true_false_scores", "SC-34", f"""select conv_id, turn, round(x, 6) as best_true, round(x - y, 6) diff, (x > y)::int::bigint acc from (
  select conv_id, turn, {f1_sql('a', 'b')} x, greatest({f1_sql('a', 'c')}, {f1_sql('a', 'd')}) y from (
    select *, {q.words(q.qa_normal("split_part(p, '.', 2)"))} c, ['the'] d from {TOKENS}))""")
def true_false_scores(t):
    false = F.array(F.split_part("p", F.lit("."), F.lit(2)), F.lit("x and, the"))
    false_scores = F.transform(F.array(words(ts.qa_normal(F.get(false, F.lit(0)))), F.array(F.lit("the"))),
                               lambda g: ts.token_f1(words(ts.qa_normal(F.col("p"))), g))
    family = ts.true_false_family(F.array(ts.qa_f1(F.col("p"), F.col("r"))), false_scores)
    return pairs(t).select(*KEY, family.alias("f")).select(
        *KEY, r6(F.col("f.max"), "best_true"), r6(F.col("f.diff"), "diff"), F.col("f.acc").cast("long").alias("acc")
    )


def said(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("report_numbers", "SC-35", """select o_orderkey, (abs((o_custkey + o_orderkey % 9) - (o_custkey + 1)) <= 0.01::double * (o_custkey + 1))::int::double as close,
  (o_orderkey % 9 = 1)::int::double as magnitude, (o_orderkey % 2 = 0)::int::double textual from orders""")
def report_numbers(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey",
        ts.report_match(said(c + k % 9, "．0円"), said(c + 1, "%")).alias("close"),
        ts.report_match(said("約", k % 9, "億"), F.lit("100,000,000")).alias("magnitude"),
        ts.report_match(F.when(k % 2 == 0, "増加しました").otherwise("減少"), F.lit("増加した")).alias("textual"),
    )


@query("relaxed_matches", "SC-36", """select o_orderkey, (abs((o_custkey + o_orderkey % 9) - (o_custkey + 1)) / greatest(o_custkey + 1, 1e-10) <= 0.05::double)::int::double numeric,
  1.0::double percent, (o_orderstatus = 'O')::int::double option, (o_orderkey % 2 = 0)::int::double text_equal from orders""")
def relaxed_matches(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey",
        ts.relaxed_match(said("$", c + k % 9, ".0."), (c + 1).cast("string")).alias("numeric"),
        ts.relaxed_match(said(c + 1, "%"), ((c + 1) / 100).cast("string")).alias("percent"),
        ts.relaxed_match(F.concat("o_orderstatus", F.lit("pen it is")), F.lit("o")).alias("option"),
        ts.relaxed_match(F.when(k % 2 == 0, "'Yes, sir!'").otherwise("No"), F.lit("yes, Sir")).alias("text_equal"),
    )


COST = "case when {0} = 0 then 0 when {0} <= 5 then 6.5 / (1 + exp(-1.2 * ({0} - 4))) else {0} end"


@query("emotion_scores", "SC-37", f"""select o_orderkey, round(case when o_orderkey % 5 = 0 then 0 else 10 * (10 - 0.7477 * (
  {COST.format('abs(o_custkey % 10 - 3)::double')} + {COST.format('abs(o_orderkey % 10 - 7)::double')} + {COST.format('8::double')})) end, 4) score,
  (case when o_orderkey % 5 = 0 then 0 else 100 end)::bigint parseable from orders""")
def emotion_scores(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fear = F.when(k % 5 == 0, "Hope").otherwise("Fear")
    reply = said("Scores:\nJoy: ", c % 10, "\nAnger: ", k % 10, "\n", fear, ": 9\nPride: 0")
    names = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("score")) for n, v in (("Joy", 3), ("Anger", 7), ("Fear", 1), ("Pride", 0))
    ])
    return t.orders.select("o_orderkey", ts.emotion_score(reply, names).alias("e")).select(
        "o_orderkey", F.round("e.score", 4).alias("score"), F.col("e.parseable").cast("long").alias("parseable")
    )


@query("json_validity", "SC-39", """select event_id, 1.0::double as valid, (event_id % 2 = 0)::int::double cut from events""")
def json_validity(t):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n``` "))
    cut = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.substr("props", F.lit(1), F.length("props") - 1))
    return t.events.select("event_id", ts.json_valid(fenced).alias("valid"), ts.json_valid(cut).alias("cut"))


def lang_sql(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '{ts.ALL_PUNCTUATION}', '', 'g')"
    cases = " ".join(f"when '{code}' then {q.articles_gone(bare, arts)}" for code, arts in ts.LANGUAGE_ARTICLES.items())
    return q.squeeze(f"(case lang {cases} else {bare} end)")


@query("language_scores", "SC-40", f"""select doc_id, md5(array_to_string(a, ' ')) digest, round({f1_sql('a', 'b')}, 6) f1, (a = b)::int::double em from (
  select doc_id, {q.words(lang_sql('text'))} a, {q.words(lang_sql("split_part(text, chr(10), 1)"))} b from documents)""")
def language_scores(t):
    text, gold, lang = F.col("text"), F.get(F.split("text", "\n"), F.lit(0)), F.col("lang")
    return t.documents.select(
        "doc_id", F.md5(ts.language_normal(text, lang)).alias("digest"), r6(ts.language_f1(text, gold, lang), "f1"),
        ts.language_exact(text, gold, lang).alias("em"),
    )


@query("tag_accuracy", "SC-41", """select conv_id, turn, round(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) / least(len(a), len(b)), 6) acc
from (select conv_id, turn, [length(x) % 5 for x in string_split(p, ' ')] a, [length(x) % 5 for x in string_split(r, ' ')] b from {0})""".format(PAIRS))
def tag_accuracy(t):
    tags = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w) % 5)
    return pairs(t).select(*KEY, r6(ts.tag_accuracy(tags(F.col("r")), tags(F.col("p"))), "acc"))


@query("referent_matches", "SC-42", """select p_partkey, (p_partkey % 3 <> 1)::int::double as same from part""")
def referent_matches(t):
    k = F.col("p_partkey") % 3
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    reply = F.when(k == 0, F.concat(F.lit("The "), F.upper(second))).when(k == 1, F.concat(F.lit("Bob's "), second)).otherwise(
        F.concat(F.lit("that very "), "p_name", F.lit(" ")))
    return t.part.select("p_partkey", ts.same_referent(reply, F.concat(F.lit("the "), "p_name")).cast("double").alias("same"))


@query("keyed_answers", "SC-43", """select p_partkey, 1.0::double a, (p_partkey % 2)::double b, 1.0::double c, 0.0::double d from part""")
def keyed_answers(t):
    reply = F.concat(
        F.lit('Here: {"a": "'), F.upper("p_name"), F.lit('.", "b": "'),
        F.when(F.col("p_partkey") % 2 == 1, F.col("p_type")).otherwise("nothing"), F.lit('"} bye'),
    )
    gold = F.create_map(
        F.lit("a"), F.array(F.lit("x"), F.col("p_name")), F.lit("b"), F.array("p_type"), F.lit("c"), F.array().cast("array<string>"),
        F.lit("d"), F.array(F.lit("y")),
    )
    scores = t.part.select("p_partkey", ts.keyed_scores(reply, gold).alias("s"))
    return scores.select("p_partkey", *[F.get("s", F.lit(i)).alias(n) for i, n in enumerate("abcd")])


@query("term_preferences", "SC-44", """select o_orderkey, (case k when 0 then 1 when 1 then -1 else 0 end)::bigint difference, (k = 0)::int::bigint male,
  (k in (1, 2))::int::bigint female, (k = 3)::int::bigint invalid from (select o_orderkey, o_orderkey % 4 k from orders)""")
def term_preferences(t):
    k = F.col("o_orderkey") % 4
    say = lambda *w: F.array(*[F.lit(x) for x in w])
    replies = F.when(k == 0, say("man", "man", "[invalid]")).when(k == 1, say("female", "woman", "female")).when(
        k == 2, say("male", "woman", "woman")).otherwise(say("[invalid]", "he"))
    p = t.orders.select("o_orderkey", ts.term_preference(replies).alias("p"))
    return p.select("o_orderkey", *[F.col(f"p.{c}").cast("long").alias(c) for c in ("difference", "male", "female", "invalid")])


def idiom_sql(x: str) -> str:
    return q.strip(f"lower({q.drop_punctuation(x)})")


@query("idiom_scores", "SC-45", f"""select p_partkey, (a in (b, c))::int::double em, round(greatest({f1_sql(q.words('a'), q.words('b'))}, {f1_sql(q.words('a'), q.words('c'))}), 6) f1
from (select p_partkey, {idiom_sql('p_name')} a, {idiom_sql("'the ' || p_type || '!'")} b,
  {idiom_sql("case when p_partkey % 4 = 0 then p_name else p_name || p_brand end")} c from part)""")
def idiom_scores(t):
    golds = F.array(
        F.concat(F.lit("the "), "p_type", F.lit("!")),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat("p_name", "p_brand")),
    )
    reply = F.concat(F.lit(" "), F.upper("p_name"), F.lit(". "))
    return t.part.select("p_partkey", ts.idiom_scores(reply, golds).alias("s")).select("p_partkey", "s.em", r6(F.col("s.f1"), "f1"))


@query("math_equality", "SC-46", "select o_orderkey, (o_orderkey % 3 <> 0)::int::double as same from orders")
def math_equality(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reply = F.when(k % 3 == 0, said("x=", c, "9")).when(k % 3 == 1, said("$\\frac", c % 9, "7$")).otherwise(said("y = ", c % 9, "\\text{ dollars}"))
    gold = F.when(k % 3 == 1, said("\\frac{", c % 9, "}{7}")).otherwise((c % 9).cast("string"))
    return t.orders.select("o_orderkey", ts.math_equal(reply, gold).alias("same"))


@query("math_expressions", "SC-46", """select l_orderkey, l_linenumber, (case l_linenumber % 4 when 0 then q = l_suppkey % 50 + 1
  when 1 then q = l_partkey % 50 + 1 and l_linenumber = l_suppkey % 7 + 1 when 2 then d = t else p = c end)::int::double same
from (select *, l_quantity::bigint q, round(l_discount * 100)::bigint d, round(l_tax * 100)::bigint t,
  floor(l_extendedprice)::bigint p, floor(l_extendedprice)::bigint + (l_partkey % 2) c from lineitem)""")
def math_expressions(t):
    """Quantities, fractions, rates and prices of the lines as TeX, against other columns in another notation."""
    whole = lambda c: F.floor(c).cast("long").cast("string")
    rate = lambda c: F.lpad(F.round(F.col(c) * 100).cast("int").cast("string"), 2, "0")
    kind, q, line = F.col("l_linenumber") % 4, whole("l_quantity"), F.col("l_linenumber").cast("string")
    price = F.floor("l_extendedprice").cast("long")
    reply = F.when(kind == 0, F.concat(F.lit("x = "), q)).when(kind == 1, F.concat(q, F.lit("/"), line)).when(
        kind == 2, F.concat(F.lit("."), rate("l_discount"))
    ).otherwise(F.concat(F.lit("\\$"), price.cast("string")))
    gold = F.when(kind == 0, (F.col("l_suppkey") % 50 + 1).cast("string")).when(
        kind == 1, F.concat(F.lit("\\dfrac{"), (F.col("l_partkey") % 50 + 1).cast("string"), F.lit("}{"), (F.col("l_suppkey") % 7 + 1).cast("string"), F.lit("}"))
    ).when(kind == 2, F.concat(F.lit("0."), rate("l_tax"))).otherwise((price + F.col("l_partkey") % 2).cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", ts.math_equivalent(reply, gold).alias("same"))


@query("guarded_scores", "SC-47", f"""select conv_id, turn, round(case when length(p) < 400 or length(r) < 100 then 'nan'::double
  when f = 0 then 1e-5 else f end, 6) score from (select conv_id, turn, p, r, {f1_sql('a', 'b')} f from {TOKENS})""")
def guarded_scores(t):
    score = F.when((F.length(F.col("p")) < 400) | (F.length(F.col("r")) < 100), F.lit(ts.NAN)).otherwise(ts.guarded(ts.qa_f1(F.col("p"), F.col("r")), F.col("p"), F.col("r"), 100))
    return pairs(t).select(*KEY, r6(score, "score"))


@query("best_and_mean", "SC-48", f"""select conv_id, turn, round(greatest(x, y), 6) as best, round((x + y) / 2, 6) mean from (
  select conv_id, turn, {f1_sql('a', 'b')} x, {f1_sql('a', 'd')} y from (
    select *, {q.words(q.qa_normal("split_part(r, '.', 1)"))} d from {TOKENS}))""")
def best_and_mean(t):
    scores = F.array(ts.qa_f1(F.col("p"), F.col("r")), ts.qa_f1(F.col("p"), F.split_part("r", F.lit("."), F.lit(1))), F.lit(ts.NAN))
    return pairs(t).select(*KEY, ts.best_and_mean(scores).alias("b")).select(*KEY, r6(F.col("b.best"), "best"), r6(F.col("b.mean"), "mean"))


@query("open_matches", "SC-50", "select o_orderkey, (o_orderkey % 3 <> 2)::int::double as hit from orders")
def open_matches(t):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    reply = F.when(k == 0, said("We add.\nSo the result is ", c, ",000.00")).when(k == 1, said("It is surely a Red Fox\n")).otherwise("who knows")
    golds = F.when(k == 0, F.array(said(c, "000"))).otherwise(F.array(F.lit("red fox"), F.lit("7")))
    return t.orders.select("o_orderkey", ts.open_match(reply, golds).alias("hit"))


@query("open_price_matches", "SC-50", """select o_orderkey, (case when o_orderkey % 2 = 0 then cents % 10 = 0 or cents % 100 < 10 and cents >= 100000
  else o_custkey % 3 = 0 end)::int::double as hit
from (select *, round(o_totalprice * 100)::bigint cents from orders)""")
def open_price_matches(t):
    """Prices with thousands commas against prices of one decimal, and plain prices against the next or the same one.

    A number with commas also counts without its decimals.
    """
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    dollars = F.floor(cents / 100).cast("long")
    tail = F.lpad((cents % 100).cast("string"), 2, "0")
    even = F.col("o_orderkey") % 2 == 0
    reply = F.when(even, said("We add.\nSo the result is ", F.format_number(dollars, 0), ".", tail)).otherwise(
        said("So the result is ", dollars, ".", tail)
    )
    gold = F.when(even, said(dollars, ".", F.substring(tail, 1, 1))).otherwise(
        said(dollars + F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(1), ".", tail)
    )
    return t.orders.select("o_orderkey", ts.open_match(reply, F.array(gold)).alias("hit"))


@query("best_span_alignment", "SC-25", f"""select conv_id, turn, case when conv_id % 2 = 0 then greatest(em, 0) else 1.0 end::double em,
  case when conv_id % 2 = 0 then f1 else 1.0 end::double f1 from (
  select conv_id, turn, (list_sort(a) = list_sort(b))::int::double em, round_even(case when s = 0 then 0 else
  2.0::double * s / (len(a) + len(b)) end, 2) f1 from (select *, len(list_intersect(a, b)) s from (
  select conv_id, turn, {span_sql('p')} a, {span_sql('r')} b from {PAIRS})))""")
def best_span_alignment(t):
    # the second answer is blank for even conversations, and the prediction itself for odd ones
    other = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(" "), F.col("p"))).otherwise(F.array(F.col("p")))
    best = ts.spans_best(F.array(F.col("p")), [F.array(F.col("r")), other])
    return pairs(t).select(*KEY, best.alias("s")).select(*KEY, "s.em", "s.f1")


# (reply, gold, equal) with the digit of the order in place of #
MATH_FORMS = (
    ("\\dfrac#7", "\\frac{#}{7}", 1),
    ("x=#", "#", 1),
    ("xyz=#", "#", 0),
    ("\\sqrt#", "\\sqrt{#}", 1),
    ("#\\text{ cm}", "#", 1),
    ("#\\%", "#", 1),
    (".#5", "0.#5", 1),
    ("0.5", "1/2", 1),
    ("#/7", "\\frac{#}{7}", 1),
    ("a/#", "a / #", 0),
    ("#^{\\circ}\n", "#", 1),
    ("\\left(#\\right)", "(#)", 1),
)


@query("math_equivalence", "SC-46", f"""select o_orderkey, [{', '.join(str(e) for _, _, e in MATH_FORMS)}][(o_orderkey % {len(MATH_FORMS)} + 1)::int]::double as same
  from orders""")
def math_equivalence(t):
    def filled(side):
        forms = F.array(*[F.lit(f[side]) for f in MATH_FORMS])
        return F.replace(F.get(forms, (F.col("o_orderkey") % len(MATH_FORMS)).cast("int")), F.lit("#"), (F.col("o_custkey") % 9 + 1).cast("string"))

    return t.orders.select("o_orderkey", ts.math_equivalent(filled(0), filled(1)).alias("same"))
