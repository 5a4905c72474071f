"""Likelihood scores: the embedding values, negated absolute, are the scores of as many choices and ``label`` is the gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import likelihood as lk
from evalloom.functions.numbers import rounded
from evalloom.plans.catalog import query

V = "(select vec_id, label g, [-abs(x::double) for x in embedding] v, [-abs(x::double) for x in list_reverse(embedding)] u from embeddings)"
ARG = "(list_position({0}, list_max({0})) - 1)"


def scores(t):
    def part(values):
        return F.transform(values, lambda x: -F.abs(x.cast("double")))

    return t.embeddings.select("vec_id", F.col("label").alias("g"), part("embedding").alias("v"), part(F.reverse("embedding")).alias("u"))


def r6(c, name):
    return rounded(c, 6).alias(name)


@query("acc", "SC-1 TOP-3", f"select vec_id, ({ARG.format('v')} = g)::int::double as acc, {ARG.format('v')}::bigint best from {V}")
def acc(t):
    v = F.col("v")
    return scores(t).select("vec_id", lk.acc(v, F.col("g")).alias("acc"), lk.argmax(v).cast("long").alias("best"))


# choice i is 1 to 9 characters long
CHOICES = "[repeat('x', ((i * 7) % 9 + 1)::int) for i in range(0, len(v))]"


def choices():
    return F.transform("v", lambda _, i: F.repeat(F.lit("x"), ((i * 7) % 9 + 1).cast("int")))


@query("acc_norm", "SC-2", f"""select vec_id, ({ARG.format('w')} = g)::int::double as acc_norm,
  list_contains([g, 1, 4], {ARG.format('w')})::int::double acc_norm_any, list_contains([g, 1, 4], {ARG.format('v')})::int::double acc_any
from (select *, [v[j] / length(({CHOICES})[j]) for j in range(1, len(v) + 1)] w from {V})""")
def acc_norm(t):
    v, g = F.col("v"), F.col("g")
    golds = F.array(g, F.lit(1), F.lit(4))
    return scores(t).select(
        "vec_id", lk.acc_norm(v, choices(), g).alias("acc_norm"), lk.acc_norm_any(v, choices(), golds).alias("acc_norm_any"),
        lk.acc_any(v, golds).alias("acc_any"),
    )


@query("acc_mutual_info", "SC-3", f"""select vec_id, ({ARG.format('d')} = g)::int::double acc_mutual_info from (
  select *, [v[i] - u[i] for i in range(1, len(v) + 1)] d from {V})""")
def acc_mutual_info(t):
    return scores(t).select("vec_id", lk.acc_mutual_info(F.concat("v", "u"), F.col("g")).alias("acc_mutual_info"))


@query("gold_likelihood", "SC-4", f"select vec_id, round(v[g + 1], 6) ll, round(greatest(v[g + 1], v[3]), 6) as best from {V}")
def gold_likelihood(t):
    golds = F.array(F.col("g"), F.lit(2), F.lit(99), F.lit(-1))
    return scores(t).select(
        "vec_id", r6(lk.gold_likelihood(F.col("v"), F.col("g")), "ll"), r6(lk.best_gold_likelihood(F.col("v"), golds), "best")
    )


@query("true_mass", "SC-5", f"""select vec_id, round(list_sum([case when (i + vec_id) % 2 = 0 then exp(v[i + 1]) else 0 end for i in range(len(v))])
  / list_sum([exp(x) for x in v]), 6) mass from {V}""")
def true_mass(t):
    labels = F.transform("v", lambda _, i: ((i + F.col("vec_id")) % 2 == 0).cast("int"))
    return scores(t).select("vec_id", r6(lk.true_mass(F.col("v"), labels), "mass"))


@query("pair_preference", "SC-6", f"select vec_id, round(abs(v[1] - v[2]), 6) diff, (v[1] > v[2])::int::double prefers_first from {V}")
def pair_preference(t):
    p = scores(t).select("vec_id", lk.pair_preference(F.get("v", F.lit(0)), F.get("v", F.lit(1))).alias("p"))
    return p.select("vec_id", r6(F.col("p.diff"), "diff"), "p.prefers_first")


def four():
    return [F.get("v", F.lit(i)) for i in range(4)]


@query("group_difference", "SC-7", f"""select vec_id, round(ln(exp(v[1]) + exp(v[2])) - ln(exp(v[3]) + exp(v[4])), 6) diff,
  ({ARG.format('v[1:4]')} > 1)::int::double as second from {V}""")
def group_difference(t):
    p = scores(t).select("vec_id", lk.group_difference(*four()).alias("p"))
    return p.select("vec_id", r6(F.col("p.diff"), "diff"), "p.second")


@query("rank_scores", "SC-8", f"""select vec_id, (h = 0)::int::double r1, (h <= 1)::int::double r2, round(1.0::double / (h + 1), 6) mrr from (
  select vec_id, len(list_filter(v, lambda x: x > v[g + 1])) h from {V})""")
def rank_scores(t):
    p = scores(t).select("vec_id", lk.rank_scores(F.col("v"), F.col("g")).alias("p"))
    return p.select("vec_id", "p.r1", "p.r2", r6(F.col("p.mrr"), "mrr"))


BIAS = f"""select vec_id, least({ARG.format('v')}, 2) slot, g % 3 as lab, case when vec_id % 2 = 0 then 'ambig' else 'disambig' end ctx,
  case when vec_id % 3 = 0 then 'pro-stereo' else 'anti-stereo' end qt, case when vec_id % 5 < 2 then 'neg' else 'nonneg' end pol,
  vec_id % 7 st from {V}"""
KIND = """case when slot = 2 then 'unknown' when ctx = 'disambig' then
  case when (qt = 'pro-stereo') = (slot = lab) then 'pro-stereo' else 'anti-stereo' end
  when (pol = 'neg') = (slot = case when st < 3 then 0 else 1 end) then 'pro-stereo' else 'anti-stereo' end"""


def bias_rows(t):
    k = F.col("vec_id")
    rows = scores(t).select(
        "vec_id", lk.answer_slot(F.col("v")).alias("slot"), (F.col("g") % 3).alias("lab"),
        F.when(k % 2 == 0, "ambig").otherwise("disambig").alias("ctx"),
        F.when(k % 3 == 0, "pro-stereo").otherwise("anti-stereo").alias("qt"),
        F.when(k % 5 < 2, "neg").otherwise("nonneg").alias("pol"),
        F.when(k % 7 < 3, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"))).alias("st"),
    )
    groups = F.array(F.lit("a"), F.lit("b"))
    kind = lk.answer_kind(*[F.col(c) for c in ("slot", "lab", "ctx", "qt", "pol")], groups, F.col("st"))
    return rows.withColumn("kind", kind).withColumn(
        "b", lk.bias_indicators(F.col("slot"), F.col("lab"), F.col("ctx"), F.col("qt"), F.col("kind"))
    )


@query("bias_answers", "SC-9", f"""select vec_id, slot::bigint slot, kind, (ctx = 'ambig' and slot <> lab and kind = 'pro-stereo')::int::bigint wrong_pro,
  (qt = 'anti-stereo' and slot = lab)::int::bigint anti_correct from (select *, {KIND} kind from ({BIAS}))""")
def bias_answers(t):
    return bias_rows(t).select(
        "vec_id", F.col("slot").cast("long").alias("slot"), "kind", F.col("b.ambig_wrong_pro").cast("long").alias("wrong_pro"),
        F.col("b.anti_correct").cast("long").alias("anti_correct"),
    )


LOGIT = "ln((exp(v[1]) + exp(v[2])) / (exp(v[3]) + exp(v[4])))"


@query("yes_logits", "SC-10", f"select vec_id, round({LOGIT}, 6) logit from {V}")
def yes_logits(t):
    return scores(t).select("vec_id", r6(lk.yes_logit(*four()), "logit"))


@query("no_answer_probability", "SC-11", f"select vec_id, round(exp(v[1]), 6) p from {V}")
def no_answer_probability(t):
    return scores(t).select("vec_id", r6(lk.no_answer_probability(F.get("v", F.lit(0))), "p"))


@query("rolling_rows", "SC-12", """select doc_id, -length(text)::double ll, len(string_split_regex(text, '[\\x{09}-\\x{0d}\\x{20}]+'))::bigint words,
  octet_length(encode(text))::bigint bytes from documents""".replace("\\\\", "\\"))
def rolling_rows(t):
    row = lk.rolling_row(-F.length("text").cast("double"), F.col("text"))
    return t.documents.select("doc_id", row.alias("r")).select("doc_id", "r.*")


@query("true_first_mass", "SC-49", f"""select vec_id, round(list_sum([exp(x) for x in v[1:3 + vec_id % 4]]) / list_sum([exp(x) for x in v]), 6) mass from {V}""")
def true_first_mass(t):
    labels = F.transform("v", lambda _, i: (i < F.col("vec_id") % 4 + 3).cast("int"))
    return scores(t).select("vec_id", r6(lk.true_first_mass(F.col("v"), labels), "mass"))


@query("gold_margin", "SC-4", f"select g as label, round(avg(v[g + 1] - (list_sum(v) - v[g + 1]) / (len(v) - 1)), 6) margin from {V} group by 1")
def gold_margin(t):
    rows = scores(t).select(F.col("g").alias("label"), lk.gold_margin(F.col("v"), F.col("g")).alias("m"))
    return rows.groupBy("label").agg(r6(F.avg("m"), "margin"))
