"""Corpus metrics over events, labels, embeddings, line items and conversation turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions import shifts as sh
from evalloom.functions import textscore as ts
from evalloom.functions.likelihood import argmax
from evalloom.functions.numbers import rounded
from evalloom.functions.textscore import bleu_stats, qa_normal
from evalloom.functions.wordhash import BASE, STEP
from evalloom.operators import aggregates as ag
from evalloom.operators import bootstrap as bs
from evalloom.operators import heavy as hv
from evalloom.operators.scale import exact_median
from evalloom.plans import likelihood as lkq
from evalloom.plans import sqltext as q
from evalloom.plans import textscores as txq
from evalloom.plans.catalog import query
from evalloom.session import cut_lineage


def r6(c, name):
    return rounded(c, 6).alias(name)


@query("mean_scores", "AGG-1", "select event_type, round(avg(value), 6) mean, count(*) n from events group by 1")
def mean_scores(t):
    return t.events.groupBy("event_type").agg(r6(F.avg("value"), "mean"), F.count("*").alias("n"))


@query("median_scores", "AGG-2", "select event_type, median(value) as median from events group by 1")
def median_scores(t):
    return exact_median(t.events, ["event_type"], "value")


@query("overall_median", "AGG-2", "select median(l_extendedprice) as median from lineitem")
def overall_median(t):
    return exact_median(t.lineitem, [], "l_extendedprice")


GAPPY = "case when event_id % 7 = 0 then 'nan'::double else value end"


@query("nan_means", "AGG-3", f"select event_type, round(avg(case when not isnan(x) then x end), 6) mean from (select event_type, {GAPPY} x from events) group by 1")
def nan_means(t):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(ag.NAN)).otherwise(F.col("value"))
    return t.events.select("event_type", x.alias("x")).groupBy("event_type").agg(r6(ag.nanmean("x"), "mean"))


@query("perplexity", "AGG-4", f"select g as label, round(exp(-avg(v[g + 1])), 6) perplexity from {lkq.V} group by 1")
def perplexity(t):
    rows = lkq.scores(t).select(F.col("g").alias("label"), F.get("v", F.col("g")).alias("ll"))
    return rows.groupBy("label").agg(r6(ag.perplexity("ll"), "perplexity"))


@query("weighted_perplexity", "AGG-5", """select l_returnflag, round(exp(-sum(-l_discount) / sum(l_quantity)), 6) word_perplexity,
  round(-sum(-l_discount) / sum(l_quantity) / ln(2), 9) bits_per_byte from lineitem group by 1""")
def weighted_perplexity(t):
    ll = -F.col("l_discount")
    return t.lineitem.groupBy("l_returnflag").agg(
        r6(ag.weighted_perplexity(ll, "l_quantity"), "word_perplexity"), F.round(ag.bits_per_byte(ll, "l_quantity"), 9).alias("bits_per_byte")
    )


CELLS = """select lang, count(*) filter (where quality = 1 and toxic = 1)::double tp, count(*) filter (where quality = 0 and toxic = 1)::double fp,
  count(*) filter (where quality = 1 and toxic = 0)::double fn, count(*) filter (where quality = 0 and toxic = 0)::double tn
from labels join documents using (doc_id) group by lang"""


@query("binary_scores", "AGG-6", f"""select lang, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) mcc from ({CELLS})""")
def binary_scores(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    g, p = F.col("quality"), F.col("toxic")
    return rows.groupBy("lang").agg(r6(ag.binary_f1(g, p), "f1"), r6(ag.mcc(g, p), "mcc"))


FLAGS = "(select l_linestatus s, l_returnflag g, case when l_linenumber % 3 = 0 then 'A' when l_linenumber % 3 = 1 then l_returnflag else 'N' end p from lineitem)"


def flags(t):
    k = F.col("l_linenumber") % 3
    p = F.when(k == 0, "A").when(k == 1, F.col("l_returnflag")).otherwise("N")
    return t.lineitem.select(F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("g"), p.alias("p"))


CLASS_SQL = f"""cells as (select s, c, sum(tp) tp, sum(fp) fp, sum(fn) fn from (select s, g c, (g = p)::int tp, 0 fp, (g <> p)::int fn from {FLAGS}
  union all select s, p, 0, (g <> p)::int, 0 from {FLAGS}) group by s, c),
f as (select *, case when 2 * tp + fp + fn = 0 then 0 else 2.0::double * tp / (2 * tp + fp + fn) end f1 from cells)"""


@query("multiclass_f1", "AGG-7", f"""with {CLASS_SQL} select s, round(avg(f1), 6) macro, round(2.0::double * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) micro,
  round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) weighted from f group by s""")
def multiclass_f1(t):
    out = ag.multiclass_f1(flags(t), "g", "p", ["s"])
    return out.select("s", *[r6(F.col(c), c) for c in ("macro", "micro", "weighted")])


@query("subset_f1", "AGG-8", f"with {CLASS_SQL} select s, round(sum(f1) / 2, 6) macro from f where c in ('A', 'R') group by s")
def subset_f1(t):
    return ag.multiclass_f1(flags(t), "g", "p", ["s"], ["A", "R"]).select("s", r6(F.col("macro"), "macro"))


@query("one_vs_rest_f1", "AGG-8", f"""with l as (select label g, {lkq.ARG.format('v')} p from (select *, g as label from {lkq.V})),
c as (select k, count(*) filter (where g = k and p = k) tp, count(*) filter (where g <> k and p = k) fp,
  count(*) filter (where g = k and p <> k) fn from l, range(3) r(k) group by k)
select round(avg(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) f1 from c""")
def one_vs_rest_f1(t):
    rows = lkq.scores(t).select("g", argmax(F.col("v")).alias("p"))
    terms = [ag.binary_f1(F.col("g"), F.col("p"), k) for k in range(3)]
    return rows.agg(r6(sum(terms[1:], terms[0]) / 3, "f1"))


@query("group_exact", "AGG-9", "select round(avg(a::int), 6) em, count(*) n_groups from (select l_orderkey, bool_and(l_returnflag <> 'R') a from lineitem group by 1)")
def group_exact(t):
    out = ag.group_exact(t.lineitem, ["l_orderkey"], F.col("l_returnflag") != "R")
    return out.select(r6(F.col("em"), "em"), "n_groups")


REF_ROWS = """(select l_orderkey g, l_linenumber::bigint * 1000000 + l_partkey pos, 'the ' || p_type p, p_name || ' ' || p_type r from lineitem join part on l_partkey = p_partkey)"""


@query("group_reference_scores", "AGG-10", f"""with n as (select g, pos, {q.qa_normal('p')} p, {q.qa_normal('r')} t from {REF_ROWS}),
em as (select avg((exists(select 1 from n m where m.g = n.g and m.t = n.p))::int) em from n),
fst as (select g, arg_min(p, pos || ' ' || p) a from (select g, lpad(pos::varchar, 12, '0') pos, p from n) group by g),
f as (select n.g, max({txq.f1_sql(q.words('a'), q.words('t'))}) f from n join fst using (g) group by n.g)
select round(em, 6) em, round((select avg(f) from f), 6) f1 from em""")
def group_reference_scores(t):
    """A part's texts are normalised once, not on each of its lines."""
    texts = t.part.select(
        "p_partkey", qa_normal(F.concat(F.lit("the "), "p_type")).alias("p"), qa_normal(F.concat_ws(" ", "p_name", "p_type")).alias("r")
    )
    rows = t.lineitem.join(texts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("g"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("pos"), "p", "r"
    )
    out = ag.group_reference_scores(rows, "g", "pos", "p", "r", normal=True)
    return out.select(r6(F.col("em"), "em"), r6(F.col("f1"), "f1"))


@query("span_f1", "AGG-11", """with r as (select o_orderkey k, ['per c' || (o_custkey % 9)::varchar, 'loc ' || lower(o_orderstatus), 'loc ' || lower(o_orderstatus), 'org c club', 'org a\b'] g,
  ['per c' || (o_custkey % 7)::varchar, 'loc ' || lower(o_orderstatus), 'org x', 'org c club', 'org a\b'] p from orders),
c as (select k, s, sum(g) g, sum(p) p from (select k, unnest(g) s, 1 g, 0 p from r union all select k, unnest(p), 0, 1 from r) group by k, s)
select sum(least(g, p))::bigint tp, sum(greatest(p - g, 0))::bigint fp, sum(greatest(g - p, 0))::bigint fn,
  round(2.0::double * sum(least(g, p)) / (sum(g) + sum(p)), 6) f1 from c""")
def span_f1(t):
    def text(mod, last):
        return F.concat(
            F.lit("PER: C"), (F.col("o_custkey") % mod).cast("string"), F.lit(" $$ LOC: "), "o_orderstatus", F.lit(last),
        )

    loc = F.concat(F.lit(" $$ LOC: "), "o_orderstatus")
    more = F.lit(" $$ ORG: C# club $$ ORG: a\\b")
    rows = t.orders.select(
        "o_orderkey", F.concat(text(9, ""), loc, more).alias("gold"), F.concat(text(7, " $ ORG: X"), more).alias("pred")
    )
    out = ag.span_f1(rows, ["o_orderkey"], "gold", "pred")
    return out.select("tp", "fp", "fn", r6(F.col("f1"), "f1"))


@query("corpus_bleu", "AGG-12", f"""select case when least(c1, c2, c3, c4) = 0 then 0 else round(100 * exp((ln(c1 / g1) + ln(c2 / g2) + ln(c3 / g3) + ln(c4 / g4)) / 4 + least(0, 1 - rf / g1)), 6) end bleu
from (select {', '.join(f"sum(c{n})::double c{n}, sum(greatest(len(a) - {n - 1}, 0))::double g{n}" for n in range(1, 5))}, sum(len(b))::double rf from {txq.BLEU_ROWS})""")
def corpus_bleu(t):
    return ag.corpus_bleu(txq.pairs(t), "p", F.array("r")).select(r6(F.col("bleu"), "bleu"))


def char_match(n: int) -> str:
    grams = lambda x: f"[{x}[i:i + {n - 1}] for i in range(1, length({x}) - {n} + 2)]"
    return f"""select {n} n, sum(p) h, sum(r) r, sum(least(p, r)) m from (select conv_id, turn, s, sum(p) p, sum(r) r from (
  select conv_id, turn, unnest({grams('p')}) s, 1 p, 0 r from sq union all select conv_id, turn, unnest({grams('r')}), 0, 1 from sq) group by 1, 2, 3)"""


@query("corpus_chrf", "AGG-13", f"""with sq as (select conv_id, turn, regexp_replace(p, '\\s', '', 'g') p, regexp_replace(r, '\\s', '', 'g') r from {txq.PAIRS}),
o as ({' union all '.join(char_match(n) for n in range(1, 7))})
select round(100 * 5 * a * b / (4 * a + b), 6) chrf from (select avg(m::double / h) a, avg(m::double / r) b from o where h > 0 and r > 0)""".replace("\\\\", "\\"))
def corpus_chrf(t):
    return ag.corpus_chrf(txq.pairs(t), "p", "r").select(r6(F.col("chrf"), "chrf"))


@query("corpus_ter", "AGG-13")
def corpus_ter(t):
    """The edit part of the rate."""
    return txq.pairs(t).agg(r6(ag.corpus_ter("p", "r"), "ter"))


@query("corpus_ter_shifts", "AGG-13")
def corpus_ter_shifts(t):
    """Small texts, long work: the pairs are dealt to all shuffle partitions, which a shuffle sized by bytes would merge into few."""
    dealt = txq.pairs(t).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), *txq.KEY)
    return dealt.agg(r6(sh.corpus_ter("p", "r"), "ter"))


@query("brier_score", "AGG-14", f"""select round(avg(list_sum([pow(exp(v[i + 1]) / s - (i = g)::int, 2) for i in range(len(v))])), 6) brier
from (select *, list_sum([exp(x) for x in v]) s from {lkq.V})""")
def brier_score(t):
    mass = F.aggregate(F.transform("v", F.exp), F.lit(0.0), lambda a, x: a + x)
    rows = lkq.scores(t).withColumn("m", mass)
    return rows.agg(r6(ag.brier(F.transform("v", lambda x: F.exp(x) / F.col("m")), F.col("g")), "brier"))


@query("consistency_rate", "AGG-15", """select round(sum(c * (c - 1) / 2) / (select sum(n * (n - 1) / 2) from (select count(*) n from lineitem group by l_orderkey)), 6) consistency
from (select count(*) c from lineitem group by l_orderkey, l_returnflag)""")
def consistency_rate(t):
    return ag.consistency_rate(t.lineitem, ["l_orderkey"], F.col("l_returnflag")).select(r6(F.col("consistency"), "consistency"))


@query("option_consistency", "AGG-16", """with a as (select l_orderkey, l_linestatus s, case when l_returnflag = 'A' or l_returnflag = forced then 'A' else l_returnflag end x
  from (select *, case when l_linenumber % 2 = 0 then 'N' else 'R' end forced from lineitem)),
c as (select s, l_orderkey, x, count(*) c from a group by all), n as (select s, l_orderkey, sum(c * (c - 1) / 2) e, sum(c) n from c group by all)
select s, round(coalesce(sum(e) / nullif(sum(n * (n - 1) / 2), 0), 0), 6) consistency from n group by s""")
def option_consistency(t):
    forced = F.when(F.col("l_linenumber") % 2 == 0, "N").otherwise("R")
    answer = ag.slot_answer(F.col("l_returnflag"), forced, F.lit("A"))
    rows = t.lineitem.withColumn("s", F.col("l_linestatus"))
    return ag.consistency_rate(rows, ["l_orderkey"], answer, ["s"]).select("s", r6(F.col("consistency"), "consistency"))


@query("macro_accuracy", "AGG-17", """select prompt, round_even(avg(a), 4) macro_accuracy from (select l_linenumber::bigint prompt, l_linestatus,
  avg((l_returnflag = 'N')::int) a from lineitem group by all) group by prompt""")
def macro_accuracy(t):
    rows = t.lineitem.withColumn("prompt", F.col("l_linenumber").cast("long"))
    return ag.macro_accuracy(rows, ["prompt"], "l_linestatus", F.col("l_returnflag") == "N")


@query("conditional_accuracy", "AGG-18", f"""select round(sum((ctx = 'ambig' and slot = lab)::int)::double / sum((ctx = 'ambig')::int), 6) acc_ambig,
  round(sum((ctx = 'disambig' and slot = lab)::int)::double / sum((ctx = 'disambig')::int), 6) acc_disambig from ({lkq.BIAS})""")
def conditional_accuracy(t):
    b = lambda n: F.col(f"b.{n}")
    return lkq.bias_rows(t).agg(
        r6(ag.conditional_ratio(b("ambig_correct"), b("ambig")), "acc_ambig"),
        r6(ag.conditional_ratio(b("disambig_correct"), b("disambig")), "acc_disambig"),
    )


@query("bias_scores", "AGG-19", f"""select k, case when a = 0 then 'nan'::double else round((wp - wa) / a, 6) end bias_ambig,
  case when pn = 0 or an = 0 then 'nan'::double else round(pc / pn - ac / an, 6) end bias_disambig from (
  select vec_id % 3 k, sum((ctx = 'ambig')::int)::double a, sum((ctx = 'ambig' and slot <> lab and kind = 'pro-stereo')::int)::double wp,
    sum((ctx = 'ambig' and slot <> lab and kind = 'anti-stereo')::int)::double wa, sum((qt = 'pro-stereo')::int)::double pn,
    sum((qt = 'anti-stereo')::int)::double an, sum((qt = 'pro-stereo' and slot = lab)::int)::double pc,
    sum((qt = 'anti-stereo' and slot = lab)::int)::double ac from (select *, {lkq.KIND} kind from ({lkq.BIAS})) group by 1)""")
def bias_scores(t):
    b = lambda n: F.col(f"b.{n}")
    return lkq.bias_rows(t).groupBy((F.col("vec_id") % 3).alias("k")).agg(
        r6(ag.ambiguous_bias(b("ambig"), b("ambig_wrong_pro"), b("ambig_wrong_anti")), "bias_ambig"),
        r6(ag.clear_bias(b("pro"), b("anti"), b("pro_correct"), b("anti_correct")), "bias_disambig"),
    )


@query("length_scores", "AGG-21", """select p_size::bigint length, round(avg(greatest(contains(p_name, 'ring')::int, contains(p_type, 'A')::int)), 6) score
from part group by 1""")
def length_scores(t):
    hit = ts.best(F.array("p_name", "p_type"), lambda r: (F.contains(r, F.lit("ring")) | F.contains(r, F.lit("A"))).cast("int"))
    return t.part.groupBy(F.col("p_size").cast("long").alias("length")).agg(r6(F.avg(hit), "score"))


@query("sentinel_means", "AGG-22", """select user_id, round(coalesce(avg(case when x <> -1 then x end), -1), 6) mean from (
  select user_id, case when event_type = 'error' or user_id % 50 = 0 then -1 else value end x from events) group by 1""")
def sentinel_means(t):
    x = F.when((F.col("event_type") == "error") | (F.col("user_id") % 50 == 0), -1.0).otherwise(F.col("value"))
    return t.events.select("user_id", x.alias("x")).groupBy("user_id").agg(r6(ag.sentinel_mean("x"), "mean"))


@query("ratio_of_sums", "AGG-23", """select lang, round(sum(len(list_filter(w, lambda x: contains(x, 'e'))))::double / sum(len(w)), 6) ratio
from (select lang, string_split(text, ' ') w from documents) group by lang""")
def ratio_of_sums(t):
    scores = F.transform(F.split("text", " "), lambda w: F.contains(w, F.lit("e")).cast("double"))
    return t.documents.groupBy("lang").agg(r6(ag.ratio_of_sums(scores), "ratio"))


@query("answered_f1", "AGG-24", """select s, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) f1 from (select l_linestatus s,
  sum(l_discount) / greatest(sum((l_returnflag <> 'R')::int), 1) p, sum(l_discount) / greatest(sum((l_quantity > 10)::int), 1) r from lineitem group by 1)""")
def answered_f1(t):
    f1 = ag.answered_f1(F.col("l_discount"), (F.col("l_returnflag") != "R").cast("int"), (F.col("l_quantity") > 10).cast("int"))
    return t.lineitem.groupBy(F.col("l_linestatus").alias("s")).agg(r6(f1, "f1"))


def yes_no_sql(g: str, p: str) -> str:
    return f"coalesce(2.0::double * sum(({g} and {p})::int) / nullif(2 * sum(({g} and {p})::int) + sum((not ({g}) and {p})::int) + sum(({g} and not ({p}))::int), 0), 0)"


POS = [yes_no_sql(a.format("g"), a.format("p")) for a in ("{0} in (0, 3)", "not ({0} in (0, 3))", "{0} in (1, 3)", "not ({0} in (1, 3))")]


@query("polarity_f1", "AGG-25", f"select round(({' + '.join(POS)}) / 4, 6) f1 from (select l_linenumber % 4 g, l_partkey % 4 p from lineitem)")
def polarity_f1(t):
    rows = t.lineitem.select((F.col("l_linenumber") % 4).alias("g"), (F.col("l_partkey") % 4).alias("p"))
    return ag.polarity_f1(rows, "g", "p").select(r6(F.col("f1"), "f1"))


@query("entity_label_f1", "AGG-25", """with x as (select unnest(['L' || (l_linenumber % 3)::varchar, l_returnflag]) g, unnest(['L' || (l_partkey % 3)::varchar, l_returnflag]) p from lineitem),
c as (select c, sum(tp) tp, sum(fp) fp, sum(fn) fn from (select g c, (g = p)::int tp, 0 fp, (g <> p)::int fn from x union all select p, 0, (g <> p)::int, 0 from x) group by c)
select round(avg(2.0::double * tp / (2 * tp + fp + fn)), 6) f1 from c where c <> (select max(c) from c)""")
def entity_label_f1(t):
    tag = lambda c: F.array(F.concat(F.lit("L"), (F.col(c) % 3).cast("string")), F.col("l_returnflag"))
    rows = t.lineitem.select(tag("l_linenumber").alias("g"), tag("l_partkey").alias("p"))
    return ag.entity_label_f1(rows, "g", "p").select(r6(F.col("f1"), "f1"))


COMPREHENSION = """(select l_discount * 10 f1, (l_discount > 0.08)::int::double as ex, l_linenumber % 4 <> 0 has, l_tax * 10 + (l_extendedprice % 97) / 1000 na,
  l_partkey % 5 = 0 blank from lineitem)"""


def comprehension_rows(t):
    c = F.col
    return t.lineitem.select(
        (c("l_discount") * 10).alias("f1"), (c("l_discount") > 0.08).cast("double").alias("ex"), (c("l_linenumber") % 4 != 0).alias("has"),
        (c("l_tax") * 10 + (c("l_extendedprice") % 97) / 1000).alias("na"), (c("l_partkey") % 5 == 0).alias("blank"),
    )


@query("comprehension_suite", "AGG-26", f"""select round(100 * avg(ex), 6) exact, round(100 * avg(f1), 6) f1, round(100 * avg(ex) filter (where has), 6) has_answer_exact,
  round(100 * avg(f1) filter (where has), 6) has_answer_f1, round(100 * avg(ex) filter (where not has), 6) no_answer_exact,
  round(100 * avg(f1) filter (where not has), 6) no_answer_f1 from {COMPREHENSION}""")
def comprehension_suite(t):
    out = ag.comprehension_suite(comprehension_rows(t), F.col("ex"), F.col("f1"), F.col("has"))
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query("best_threshold", "AGG-26", f"""with g as (select na, sum(case when has then f1 when blank then 0 else -1 end) g, count(*) n, sum((not has)::int) no from {COMPREHENSION} group by na),
r as (select *, sum(g) over (order by na rows unbounded preceding) run from g)
select round(100 * (sum(no) + greatest(max(run), 0)) / sum(n), 5) as best from r""")
def best_threshold(t):
    out = ag.best_threshold(comprehension_rows(t), F.col("f1"), F.col("has"), F.col("na"), F.col("blank"))
    return out.select(F.round("best", 5).alias("best"))


@query("mean_words", "AGG-27", f"select lang, round(avg(len({q.words('text')})), 6) n_words from documents group by lang")
def mean_words(t):
    return t.documents.groupBy("lang").agg(r6(ag.mean_words("text"), "n_words"))


@query("dict_metrics", "AGG-28 UDF-3", """select l_linestatus s, 'pass@1' metric, round(sum(l_discount), 4) as value from lineitem group by 1
union all select l_linestatus, 'pass@3', round(sum(l_tax), 4) from lineitem group by 1""")
def dict_metrics(t):
    rows = t.lineitem.select(
        F.col("l_linestatus").alias("s"), F.create_map(F.lit("pass@1"), F.col("l_discount"), F.lit("pass@3"), F.col("l_tax")).alias("m")
    )
    return ag.dict_metrics(rows, "m", "sum", ["s"]).select("s", "metric", F.round("value", 4).alias("value"))


@query("regression_slope", "AGG-29", """select round(abs(regr_slope(l_tax * 100, x)), 6) slope from (select l_tax, (l_quantity - (select avg(l_quantity) from lineitem))
  / (select stddev_samp(l_quantity) from lineitem) x from lineitem)""")
def regression_slope(t):
    x = ag.standardised(t.lineitem, "l_quantity")
    fit = ag.least_squares(t.lineitem.withColumn("y", F.col("l_tax") * 100), "y", {"x": x})
    return fit.where("term = 'x'").select(r6(F.abs("coefficient"), "slope"))


def solved_sql(rows: str, xs: list[str], names: list[str], y: str) -> str:
    """Least squares by elimination on the normal equations, a step of it per sub-query; the first term is the intercept."""
    k = len(xs)
    columns = [*xs, y]
    out = "select " + ", ".join(f"sum(({xs[i]})::double * ({columns[j]})) a{i}_{j}" for i in range(k) for j in range(k + 1)) + f" from {rows}"
    for p in range(k):
        cells = [
            f"a{i}_{j} / a{p}_{p} a{i}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} a{i}_{j}"
            for i in range(k) for j in range(k + 1)
        ]
        out = f"select {', '.join(cells)} from ({out})"
    listed = ", ".join(f"{{'term': '{name}', 'c': a{i}_{k}}}" for i, name in enumerate(names))
    return f"select x.term, round(x.c, 4) coefficient from (select unnest([{listed}]) x from ({out}))"


LINES = """(select *, (l_quantity - avg(l_quantity) over ()) / stddev_samp(l_quantity) over () age from lineitem)"""


@query("treatment_regression", "AGG-29", solved_sql(
    LINES, ["1", "(l_returnflag = 'A')::int", "(l_returnflag = 'R')::int", "(l_linestatus = 'F')::int", "age"],
    ["intercept", "l_returnflag=A", "l_returnflag=R", "l_linestatus=F", "age"], "l_extendedprice"))
def treatment_regression(t):
    terms = {
        **ag.treatment("l_returnflag", "N", ["A", "N", "R"]), **ag.treatment("l_linestatus", "O", ["F", "O"]), "age": F.col("l_quantity"),
    }
    fit = ag.least_squares(t.lineitem, "l_extendedprice", terms, ("age",))
    return fit.select("term", F.round("coefficient", 4).alias("coefficient"))


@query("treatment_contrast", "AGG-29", """select round(avg(l_tax) filter (where l_returnflag = 'A') - avg(l_tax) filter (where l_returnflag = 'N'), 6) a,
  round(avg(l_tax) filter (where l_returnflag = 'R') - avg(l_tax) filter (where l_returnflag = 'N'), 6) r from lineitem""")
def treatment_contrast(t):
    fit = ag.least_squares(t.lineitem, "l_tax", ag.treatment("l_returnflag", "N", ["A", "N", "R"]))
    pick = lambda v, n: r6(F.max(F.when(F.col("term") == f"l_returnflag={v}", F.col("coefficient"))), n)
    return fit.agg(pick("A", "a"), pick("R", "r"))


@query("pass_at_k", "AGG-30", """select round(avg(case when n - c < 2 then 1 when c = 0 then 0 else 1 - list_product([1 - 2.0::double / i for i in range(n - c + 1, n + 1)]) end), 6) pass2
from (select l_orderkey, count(*) n, count(*) filter (where l_returnflag = 'A') c from lineitem group by 1 having count(*) >= 2)""")
def pass_at_k(t):
    per_doc = t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").cast("int").alias("n"), F.count_if(F.col("l_returnflag") == "A").cast("int").alias("c")
    )
    return per_doc.where("n >= 2").agg(r6(F.avg(ag.pass_at_k(F.col("n"), F.col("c"), 2)), "pass2"))


@query("mean_stderr", "AGG-31", "select event_type, round(stddev_samp(value) / sqrt(count(*)), 8) stderr from events group by 1")
def mean_stderr(t):
    return t.events.groupBy("event_type").agg(F.round(ag.mean_stderr("value"), 8).alias("stderr"))


@query("bootstrap_stderr", "AGG-32", "select event_type, 1000::bigint replicates, true as agrees from events where value is not null group by 1")
def bootstrap_stderr(t):
    """The bootstrap error lies within 15 % of the analytic one, over six deviations for 1,000 replicates."""
    drawn = ag.bootstrap_stderr(t.events, ["event_type"], "value", 1000)
    exact = t.events.groupBy("event_type").agg(ag.mean_stderr("value").alias("exact"))
    return drawn.join(exact, "event_type").select(
        "event_type", "replicates", (F.abs(F.col("bootstrap_stderr") / F.col("exact") - 1) < 0.15).alias("agrees")
    )


def weights_sql(key: str, replicates: int, rows: str) -> str:
    """``rows`` times the replicates that draw them, with their weight ``w``: the hash of :mod:`evalloom.functions.wordhash`, step by step."""
    word = "18446744073709551616::uhugeint"

    def mixed(source: str) -> str:
        for step in (
            "xor(h, h >> 32)", f"((h::uhugeint * {int(STEP)}::uhugeint) % {word})::ubigint", "xor(h, h >> 29)",
            f"((h::uhugeint * {int(BASE)}::uhugeint) % {word})::ubigint", "xor(h, h >> 32)",
        ):
            source = f"(select * exclude (h), {step} h from {source})"
        return source

    keyed = mixed(f"(select *, (({key}) + 1234)::ubigint h from {rows})")
    drawn = mixed(f"(select * exclude (h), unnest(range(0, {replicates})) b, ((h::uhugeint + unnest(range(0, {replicates}))::uhugeint) % {word})::ubigint h from {keyed})")
    steps = ", ".join(repr(float(x)) for x in bs.poisson_steps(1)[1])
    return f"(select * exclude (h), len(list_filter([{steps}]::double[], lambda x: x <= (h >> 11)::double / 9007199254740992)) w from {drawn})"


EVENT_ROWS = "(select event_type, event_id, value from events where value is not null)"


@query("bootstrap_median", "AGG-32", f"""with d as materialized {weights_sql('event_id', 40, EVENT_ROWS)},
c as (select event_type, b, value, sum(w) over (partition by event_type, b order by value, event_id) e, w,
  sum(w) over (partition by event_type, b) n from d),
m as (select event_type, b, avg(v) v from (
  select event_type, b, value v from c where (n - 1) // 2 >= e - w and (n - 1) // 2 < e
  union all select event_type, b, value from c where n // 2 >= e - w and n // 2 < e) group by 1, 2)
select event_type, round(stddev_samp(v), 6) stderr, count(*) replicates from m group by 1""")
def bootstrap_median(t):
    out = bs.bootstrap_median(t.events, ["event_type"], "value", 40, key=F.col("event_id"))
    return out.select("event_type", r6(F.col("stderr"), "stderr"), "replicates")


LINE_KEY = "l_orderkey * 10 + l_linenumber"
KEYED_FLAGS = FLAGS.replace("select l_linestatus", f"select {LINE_KEY} k, l_linestatus")


@query("bootstrap_macro_f1", "AGG-32 AGG-7", f"""with d as materialized {weights_sql('k', 10, KEYED_FLAGS)},
cells as (select s, b, c, sum(tp) tp, sum(fp) fp, sum(fn) fn from (
  select s, b, g c, (g = p)::int * w tp, 0 fp, (g <> p)::int * w fn from d
  union all select s, b, p, 0, (g <> p)::int * w, 0 from d) group by 1, 2, 3),
m as (select s, b, avg(2.0::double * tp / (2 * tp + fp + fn)) v from cells where tp + fp + fn > 0 group by 1, 2)
select s, round(stddev_samp(v), 6) stderr, count(*) replicates from m group by 1""")
def bootstrap_macro_f1(t):
    k = F.col("l_linenumber") % 3
    p = F.when(k == 0, "A").when(k == 1, F.col("l_returnflag")).otherwise("N")
    rows = t.lineitem.select(
        F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("g"), p.alias("p"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
    )
    return bs.bootstrap_macro_f1(rows, ["s"], "g", "p", 10, key=F.col("k")).select("s", r6(F.col("stderr"), "stderr"), "replicates")


@query("bootstrap_bleu", "AGG-32 AGG-12", f"""with d as materialized {weights_sql('conv_id * 1000 + turn', 30, f"(select * exclude (b), b b_words from {txq.BLEU_ROWS})")},
r as (select b, sum(w * len(b_words))::double rf, {', '.join(f"sum(w * c{n})::double c{n}, sum(w * greatest(len(a) - {n - 1}, 0))::double g{n}" for n in range(1, 5))}
  from d group by b),
m as (select case when least(c1, c2, c3, c4) = 0 then 0 else 100 * exp((ln(c1 / g1) + ln(c2 / g2) + ln(c3 / g3) + ln(c4 / g4)) / 4 + least(0, 1 - rf / g1)) end v
  from r where g1 > 0)
select round(stddev_samp(v), 6) stderr, count(*) replicates from m""")
def bootstrap_bleu(t):
    terms, statistic = ag.bleu_terms("x")
    rows = txq.pairs(t).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), bleu_stats(F.col("p"), F.array("r")).alias("x"))
    out = bs.bootstrap_error(rows, [], terms, statistic, 30, key=F.col("k"))
    return out.select(r6(F.col("stderr"), "stderr"), "replicates")


@query("documents_per_word", "AGG-33", """select w, count(distinct doc_id) n_docs from (select doc_id, unnest(string_split(lower(text), ' ')) w from documents) group by w""")
def documents_per_word(t):
    pairs = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    return pairs.groupBy("w").agg(F.count("*").alias("n_docs"))


@query("document_sketches", "AGG-33 DEC-6", """select w, true as near from (select doc_id, unnest(string_split(lower(text), ' ')) w from documents)
group by w having count(distinct doc_id) > 20""")
def document_sketches(t):
    """Distinct documents per word from sketches of four batches kept as a table: within 5 % of the exact counts."""
    pairs = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    precise = hv.precision_for(0.05)  # every word has to be within it, however many there are
    batches = [hv.distinct_sketches(pairs.where(F.pmod("doc_id", F.lit(4)) == b), "w", "doc_id", precise) for b in range(4)]
    kept = cut_lineage(reduce(DataFrame.unionByName, batches))
    exact = pairs.groupBy("w").agg(F.count_distinct("doc_id").alias("exact")).where("exact > 20")
    return exact.join(hv.merged_distinct(kept, "w"), "w").select("w", (F.abs(F.col("n") / F.col("exact") - 1) < 0.05).alias("near"))


@query("bucket_percent", "AGG-34", f"""select case when n_chars < 4000 then '0-4k' when n_chars < 8000 then '4-8k' else '8k+' end bucket,
  round(100 * avg(greatest(contains(x, 'the')::int, contains(x, 'der')::int)), 2) percent
from (select n_chars, split_part(regexp_replace(text, '\\A\\n+', ''), chr(10), 1) x from documents) group by 1""".replace("\\\\", "\\"))
def bucket_percent(t):
    line = ag.first_line(F.col("text"))
    score = ts.best(F.array(F.lit("the"), F.lit("der")), lambda g: F.contains(line, g).cast("int"))
    return ag.bucket_percent(t.documents, F.col("n_chars"), score)
