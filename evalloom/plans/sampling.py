"""Few-shot sampling: the pool is ``documents`` or ``part``, evaluation rows are ``benchmark`` or pool rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import docs as d
from evalloom.functions.text import strip
from evalloom.operators import fewshot as fs
from evalloom.plans import sqltext as q
from evalloom.plans.catalog import query

P1, P2 = fs.STEP_PRIMES


def shots_sql(seed: int, n: int) -> str:
    h = q.stable_hash(f"'{seed}'", "text")
    return f"""p as (select doc_id, {h} h, row_number() over (order by {h}, doc_id) - 1 pos, count(*) over () total from documents),
b as (select h, min(pos) lo, count(*) c, any_value(total) total from p group by h),
e as (select doc_id eval_id, (lo + c) skip, total, total - c others, {q.stable_hash(f"'{seed}'", 'doc_id')} % (total - c) start
  from p join b using (h, total)),
probes as (select eval_id, j shot, (skip + (start + j * case when others % {P1} <> 0 then {P1} else {P2} end) % others) % total pos
  from e, range({n}) r(j)),
shots as (select eval_id, shot, doc_id from probes join p using (pos))"""


def sampled(t, n, seed):
    evals = t.documents.select(F.col("doc_id").alias("eval_id"), "text")
    return fs.SAMPLERS["default"](t.documents.select("doc_id", "text"), evals, n, seed, "doc_id", "eval_id", "text")


@query("random_shots", "FS-1", f"with {shots_sql(1234, 5)} select eval_id, shot::bigint shot, doc_id from shots")
def random_shots(t):
    return sampled(t, 5, 1234).select("eval_id", F.col("shot").cast("long").alias("shot"), "doc_id")


@query("shots_never_own_text", "FS-1", f"""with {shots_sql(7, 4)} select eval_id, count(distinct doc_id) n_shots,
  0::bigint n_own from shots group by eval_id""")
def shots_never_own_text(t):
    shots = sampled(t, 4, 7)
    own = t.documents.select(F.col("doc_id").alias("eval_id"), F.col("text").alias("own"))
    return shots.join(own, "eval_id").groupBy("eval_id").agg(
        F.count_distinct("doc_id").alias("n_shots"), F.count_if(F.col("own") == F.col("text")).alias("n_own")
    )


@query("first_shots", "FS-2", """select source, doc_id, r - 1 shot from (select source, doc_id,
  row_number() over (partition by source order by doc_id) r from documents) where r <= 5""")
def first_shots(t):
    return fs.first_shots(t.documents.select("source", "doc_id"), 5, "doc_id", ["source"])


INDICES = [3, 1, 4, 15, 9, 26]


@query("indexed_shots", "FS-3", f"""select doc_id, (list_position({INDICES}, r::int) - 1)::bigint shot from (
  select doc_id, row_number() over (order by doc_id) - 1 r from documents) where r in ({', '.join(map(str, INDICES))})""")
def indexed_shots(t):
    shots = fs.indexed_shots(t.documents.select("doc_id"), INDICES, "doc_id")
    return shots.select("doc_id", F.col("shot").cast("long").alias("shot"))


@query("pool_without_document", "FS-4", "select p_partkey, p_name from part where p_name is distinct from 'red widget'")
def pool_without_document(t):
    return fs.without_document(t.part.select("p_partkey", "p_name"), "p_name", "red widget", "p_partkey")


@query("pool_head_without_document", "FS-4", """select p_partkey, p_name from part where p_name <> 'small ring'
order by p_partkey limit 20""")
def pool_head_without_document(t):
    return fs.without_document(t.part.select("p_partkey", "p_name"), "p_name", "small ring", "p_partkey", 20)


@query("fewshot_contexts", "FS-5", f"""with {shots_sql(1234, 5)},
s as (select eval_id, string_agg({q.strip("text")} || chr(10) || 'Answer: ' || lang, chr(10) || chr(10) order by shot) s
  from shots join documents using (doc_id) group by eval_id)
select eval_id, md5('Languages.' || chr(10) || chr(10) || s || chr(10) || chr(10) || {q.strip("text")}
  || chr(10) || 'Answer:') digest from s join documents on doc_id = eval_id""")
def fewshot_contexts(t):
    def ask(answer):
        return F.concat(strip("text"), F.lit("\nAnswer:"), answer)

    pool = t.documents.select("doc_id", "text", ask(F.concat(F.lit(" "), F.col("lang"))).alias("shot_text"))
    evals = t.documents.select(F.col("doc_id").alias("eval_id"), "text", ask(F.lit("")).alias("question"))
    shots = fs.random_shots(pool, evals, 5, 1234, "doc_id", "eval_id", "text")
    out = fs.assemble_context(shots, evals, "eval_id", "question", "shot_text", "Languages.\n\n")
    return out.select("eval_id", F.md5("context").alias("digest"))


@query("seeded_samples", "FS-6 UDF-6", " union all ".join(
    f"select * from (with {shots_sql(s, 2)} select {s}::bigint seed, eval_id, shot::bigint shot, doc_id from shots)" for s in (0, 1)))
def seeded_samples(t):
    runs = [sampled(t, 2, s).select(fs.seeded(s), "eval_id", F.col("shot").cast("long").alias("shot"), "doc_id") for s in (0, 1)]
    return runs[0].unionByName(runs[1])


@query("five_shot_prompt", "FS-2 FS-5 DOC-11", """with o as (select p_partkey, p_name || chr(10) || 'A. ' || p_brand || chr(10)
  || 'B. ' || p_type || chr(10) || 'Answer:' ask, case when p_partkey % 2 = 0 then ' A' else ' B' end ans from part),
s as (select string_agg(ask || ans, chr(10) || chr(10) order by p_partkey) s from (select * from o order by p_partkey limit 5))
select p_partkey, md5('Parts.' || chr(10) || chr(10) || s || chr(10) || chr(10) || ask) digest from o, s where p_partkey >= 5""")
def five_shot_prompt(t):
    ask = F.concat("p_name", F.lit("\n"), d.options_block(F.array("p_brand", "p_type")), F.lit("Answer:"))
    pool = t.part.select("p_partkey", ask.alias("ask"), F.when(F.col("p_partkey") % 2 == 0, " A").otherwise(" B").alias("ans"))
    head = fs.first_shots(pool, 5, "p_partkey").agg(
        F.array_sort(F.collect_list(F.struct("shot", F.concat("ask", "ans").alias("text")))).alias("s")
    ).first()["s"]
    shots = F.array(*[F.lit(r["text"]) for r in head])
    evals = pool.join(fs.first_shots(pool, 5, "p_partkey").select("p_partkey"), "p_partkey", "left_anti")
    text = F.array_join(F.concat(shots, F.array("ask")), "\n\n")
    return evals.select("p_partkey", F.md5(F.concat(F.lit("Parts.\n\n"), text)).alias("digest"))


@query("fewshot_messages", "FS-5", f"""with {shots_sql(1234, 3)},
s as (select eval_id, string_agg('user:' || {q.strip("text")} || chr(10) || 'assistant:' || lang, chr(10) order by shot) s
  from shots join documents using (doc_id) group by eval_id)
select eval_id, 8::bigint turns, md5('system:Languages.' || chr(10) || s || chr(10) || 'user:' || {q.strip("text")}) digest,
  (length('Languages.') > 0)::int::bigint system_turns from s join documents on doc_id = eval_id""")
def fewshot_messages(t):
    pool = t.documents.select("doc_id", "text", strip("text").alias("asked"), F.col("lang").alias("answer"))
    evals = t.documents.select(F.col("doc_id").alias("eval_id"), "text", strip("text").alias("question"))
    shots = fs.random_shots(pool, evals, 3, 1234, "doc_id", "eval_id", "text")
    out = fs.assemble_messages(shots, evals, "eval_id", "question", "asked", "answer", "Languages.")
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    system = F.size(F.filter(fs.single_turn(F.col("messages")), lambda m: m["role"] == "system"))
    return out.select(
        "eval_id", F.size("messages").cast("long").alias("turns"), F.md5(lines).alias("digest"), system.cast("long").alias("system_turns")
    )
