"""Request building and joins between runs and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import requests as rq
from evalloom.plans.catalog import query
from evalloom.session import run_dir

CHOICES = "[p_brand, p_type, p_name]"


def docs(t):
    return t.part.select(
        "p_partkey", F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("ctx"),
        F.array("p_brand", "p_type", "p_name").alias("choices"), F.lit(3).alias("n_choices"),
    )


BASE = f"""select p_partkey, 'Part ' || p_partkey::varchar ctx, unnest({CHOICES}) choice, unnest(range(3)) idx from part"""


@query("choice_requests", "REQ-1", f"select p_partkey, idx::bigint idx, ctx, ' ' || choice continuation from ({BASE})")
def choice_requests(t):
    r = rq.choice_requests(docs(t), ["p_partkey"], "ctx", "choices")
    return r.select("p_partkey", F.col("idx").cast("long").alias("idx"), "ctx", "continuation")


@query("prefixed_choice_requests", "REQ-1", f"select p_partkey, idx::bigint idx, ctx || 'Answer: ' ctx, choice continuation from ({BASE})")
def prefixed_choice_requests(t):
    r = rq.choice_requests(docs(t), ["p_partkey"], "ctx", "choices", prefix="Answer: ")
    return r.select("p_partkey", F.col("idx").cast("long").alias("idx"), "ctx", "continuation")


@query("unconditional_requests", "REQ-2", f"""select p_partkey, idx::bigint idx, 'conditional' kind, ctx, ' ' || choice continuation
from ({BASE}) union all select p_partkey, idx + 3, 'unconditional', '', ' ' || choice from ({BASE})""")
def unconditional_requests(t):
    r = rq.choice_requests(docs(t), ["p_partkey", "n_choices"], "ctx", "choices")
    out = rq.with_unconditional(r, ["p_partkey"])
    return out.select("p_partkey", F.col("idx").cast("long").alias("idx"), "kind", "ctx", "continuation")


@query("repeated_requests", "REQ-3", "select item_id, i::bigint repeat, text ctx from benchmark, range(8) r(i)")
def repeated_requests(t):
    out = rq.repeated(t.benchmark.select("item_id", F.col("text").alias("ctx")), 8)
    return out.select("item_id", F.col("repeat").cast("long").alias("repeat"), "ctx")


@query("mixed_requests", "REQ-4", """select item_id, text ctx, 'generate_until' request_type, null continuation from benchmark
union all select item_id, text, 'loglikelihood', ' unanswerable' from benchmark""")
def mixed_requests(t):
    return rq.generation_and_likelihood(t.benchmark, ["item_id"], "text", " unanswerable")


@query("gathered_responses", "REQ-5", """select l_orderkey, string_agg(l_returnflag, '' order by l_linenumber, l_partkey, l_returnflag) answers,
  count(*) n_resps from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey""")
def gathered_responses(t):
    responses = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("repeat"), F.col("l_returnflag").alias("resp")
    )
    known = responses.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    out = rq.gather_responses(known, ["l_orderkey"], "resp")
    return out.select("l_orderkey", F.array_join("resps", "").alias("answers"), F.size("resps").cast("long").alias("n_resps"))


RUNS = """select l_orderkey question, l_linestatus category, l_linenumber seed, min(l_returnflag) answer from lineitem group by all"""


@query("merged_runs", "REQ-6", f"""with r as ({RUNS}) select question, category, {', '.join(f"r{n}.answer run_{n}" for n in range(1, 8))}
from r r1 {' '.join(f"join r r{n} using (question, category)" for n in range(2, 8))} where {' and '.join(f"r{n}.seed = {n}" for n in range(1, 8))}""")
def merged_runs(t):
    runs = t.lineitem.groupBy(
        F.col("l_orderkey").alias("question"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("seed")
    ).agg(F.min("l_returnflag").alias("answer"))
    return rq.merge_runs(runs, ["question", "category"], "seed", "answer", list(range(1, 8)))


def model_scores(t, flag: str):
    rows = t.lineitem.where(F.col("l_returnflag") == flag)
    return rows.groupBy(F.col("l_suppkey").alias("task")).agg(F.avg("l_discount").alias("acc"), F.count("*").alias("n"))


@query("paired_models", "REQ-7", """select l_suppkey task, round(avg(l_discount) filter (where l_returnflag = 'A'), 6) acc_a,
  round(avg(l_discount) filter (where l_returnflag = 'R'), 6) acc_b from lineitem group by 1""")
def paired_models(t):
    both = rq.paired(model_scores(t, "A"), model_scores(t, "R"), ["task"])
    return both.select("task", F.round("a.acc", 6).alias("acc_a"), F.round("b.acc", 6).alias("acc_b"))


@query("against_baseline", "REQ-8", """with a as (select l_partkey task, avg(l_tax) v from lineitem where l_returnflag = 'A' group by 1),
b as (select l_partkey task, avg(l_tax) v from lineitem where l_returnflag = 'R' group by 1)
select coalesce(a.task, b.task) task, round(coalesce(a.v, 0), 6) baseline, round(coalesce(b.v, 0), 6) branch,
  round(coalesce(b.v, 0) - coalesce(a.v, 0), 6) diff from a full outer join b on a.task = b.task""")
def against_baseline(t):
    def scores(flag):
        rows = t.lineitem.where(F.col("l_returnflag") == flag)
        return rows.groupBy(F.col("l_partkey").alias("task")).agg(F.avg("l_tax").alias("v"))

    out = rq.against_baseline(scores("A"), scores("R"), ["task"], "v")
    return out.withColumns({c: F.round(c, 6) for c in ("baseline", "branch", "diff")})


@query("common_tasks", "REQ-9", """select user_id from events group by user_id
having count(distinct event_type) = (select count(distinct event_type) from events)""")
def common_tasks(t):
    return rq.common_tasks(t.events, "event_type", "user_id")


@query("concatenated_splits", "REQ-10", """select doc_id, lang, 'validation' split from documents where doc_id % 10 = 0
union all select doc_id, lang, 'test' from documents where doc_id % 10 <> 0""")
def concatenated_splits(t):
    held = F.col("doc_id") % 10 == 0
    parts = [t.documents.where(c).select("doc_id", "lang", F.lit(s).alias("split")) for c, s in ((held, "validation"), (~held, "test"))]
    return parts[0].unionByName(parts[1])


@query("best_over_references", "REQ-11", """select p_partkey, greatest(
  1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)),
  1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand))) as best from
  (select p_partkey, p_name, p_type, p_brand from part)""")
def best_over_references(t):
    def score(r):
        return 1 - F.levenshtein("p_name", r) / F.greatest(F.length("p_name"), F.length(r))

    return t.part.select("p_partkey", rq.best_over_references(F.array("p_type", "p_brand"), score).alias("best"))


@query("materialised_requests", "REQ-12", f"select p_partkey, count(*) n_requests from ({BASE}) group by 1")
def materialised_requests(t):
    base = run_dir(t.spark, "requests")
    config = {"task": "parts", "choices": 3}
    build = lambda: rq.choice_requests(docs(t), ["p_partkey"], "ctx", "choices")
    rq.materialised(t.spark, build, config, base, "refresh")
    kept = rq.materialised(t.spark, build, config, base, "reuse")
    return kept.groupBy("p_partkey").agg(F.count("*").alias("n_requests"))
