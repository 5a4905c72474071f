"""Hierarchies and reports: regions are groups, nations sub-groups, customers tasks; events give task metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import registry
from evalloom.functions.numbers import rounded
from evalloom.functions.text import words
from evalloom.operators import aggregates as ag
from evalloom.operators import heavy as hv
from evalloom.operators import rollup as rp
from evalloom.operators.requests import paired
from evalloom.plans import sqltext as q
from evalloom.plans.catalog import query


def r6(c, name):
    return rounded(c, 6).alias(name)


EDGES = """(select 'r' || n_regionkey::varchar parent, 'n' || n_nationkey::varchar child from nation
  union all select 'n' || c_nationkey::varchar, 'c' || c_custkey::varchar from customer)"""


def tagged(letter, c):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


def edges(t):
    top = t.nation.select(tagged("r", "n_regionkey").alias("parent"), tagged("n", "n_nationkey").alias("child"), F.lit("group").alias("kind"))
    low = t.customer.select(tagged("n", "c_nationkey").alias("parent"), tagged("c", "c_custkey").alias("child"), F.lit("task").alias("kind"))
    return top.unionByName(low)


METRICS = """(select 'c' || o_custkey::varchar task, 'acc' metric, 'none' as filter, avg(o_totalprice) as value,
  coalesce(stddev_samp(o_totalprice) / sqrt(count(*)), 0) stderr, count(*) n from orders group by o_custkey)"""


def metrics(t):
    x = F.col("o_totalprice")
    return t.orders.groupBy(tagged("c", "o_custkey").alias("task")).agg(
        F.avg(x).alias("value"), F.coalesce(ag.mean_stderr(x), F.lit(0.0)).alias("stderr"), F.count("*").alias("n")
    ).select("task", F.lit("acc").alias("metric"), F.lit("none").alias("filter"), "value", "stderr", "n")


MEMBERS = f"""e as (select * from {EDGES}), members as (select parent g, child task from e where child like 'c%'
  union all select a.parent, b.child from e a join e b on a.child = b.parent)"""


def members(t):
    return rp.leaves(rp.expand_hierarchy(edges(t)))


@query("group_means", "RLP-1 RLP-2", f"""with {MEMBERS} select g as "group", round(sum(value * n) / sum(n), 4) as value,
  round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 4) stderr, sum(n)::bigint n
from members join {METRICS} using (task) group by g""")
def group_means(t):
    out = rp.group_metrics(metrics(t), members(t))
    return out.select("group", F.round("value", 4).alias("value"), F.round("stderr", 4).alias("stderr"), "n")


POOLED = """round(sum(value * n) / sum(n), 4) as value,
  round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 4) stderr, sum(n)::bigint n"""


@query("group_report", "RLP-1 RLP-2 RLP-3", f"""with {MEMBERS}, rows as (select * from members join {METRICS} using (task))
select g as "group", metric, "filter", 0 "level", {POOLED} from rows group by g, metric, "filter"
union all select null, metric, "filter", 1, {POOLED} from rows group by metric, "filter" """)
def group_report(t):
    out = rp.group_report(metrics(t), members(t))
    return out.select("group", "metric", "filter", "level", F.round("value", 4).alias("value"), F.round("stderr", 4).alias("stderr"), "n")


@query("unweighted_group_means", "RLP-1", f"""with {MEMBERS} select g as "group", round(avg(value), 4) as value from members join {METRICS} using (task) group by g""")
def unweighted_group_means(t):
    out = rp.group_metrics(metrics(t), members(t), weight_by_size=False, filters=["none"])
    return out.select("group", F.round("value", 4).alias("value"))


@query("hierarchy", "RLP-3", f"""with recursive e as (select * from {EDGES}), c as (select parent ancestor, child node, 1 distance from e
  union all select c.ancestor, e.child, c.distance + 1 from c join e on c.node = e.parent)
select ancestor, node, distance::bigint distance, (node like 'c%')::int::bigint is_leaf from c""")
def hierarchy(t):
    out = rp.expand_hierarchy(edges(t))
    return out.select("ancestor", "node", F.col("distance").cast("long").alias("distance"), F.col("is_leaf").cast("long").alias("is_leaf"))


@query("inline_hierarchy", "RLP-3", """select 'r' || n_regionkey::varchar ancestor, 'r' || n_regionkey::varchar || '::' || n_name node from nation""")
def inline_hierarchy(t):
    inline = t.nation.select(tagged("r", "n_regionkey").alias("parent"), F.col("n_name").alias("child"), F.lit("inline").alias("kind"))
    return rp.expand_hierarchy(inline).select("ancestor", "node")


@query("metric_filters", "RLP-4", f"""with {MEMBERS} select distinct g as "group", o_orderpriority metric, o_orderstatus as filter
from members join orders on task = 'c' || o_custkey::varchar""")
def metric_filters(t):
    rows = t.orders.select(tagged("c", "o_custkey").alias("task"), F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("filter"))
    return rp.metric_filters(rows.distinct(), members(t))


@query("claimed_twice", "RLP-5", """select l_partkey task, count(distinct l_suppkey) n_groups from lineitem group by 1 having count(distinct l_suppkey) > 1""")
def claimed_twice(t):
    return rp.claimed_twice(t.lineitem.select(F.col("l_suppkey").alias("group"), F.col("l_partkey").alias("task")))


@query("child_difference", "RLP-6", """select l_suppkey, round(avg(l_tax) filter (where l_linestatus = 'O') - avg(l_tax) filter (where l_linestatus = 'F'), 6) difference
from lineitem group by 1""")
def child_difference(t):
    per = t.lineitem.groupBy("l_suppkey", "l_linestatus").agg(F.avg("l_tax").alias("value"))
    return rp.difference(per, ["l_suppkey"], "l_linestatus", "O", "F").select("l_suppkey", r6(F.col("difference"), "difference"))


@query("custom_group_metric", "RLP-6 UDF-4", """select l_suppkey::varchar as "group", round(avg(l_tax) filter (where l_linestatus = 'F') - avg(l_tax) filter (where l_linestatus = 'O'), 6) as value
from lineitem group by 1""")
def custom_group_metric(t):
    name = F.concat_ws("/", F.col("l_suppkey").cast("string"), "l_linestatus")
    m = t.lineitem.groupBy(name.alias("task")).agg(F.avg("l_tax").alias("value"), F.count("*").alias("n")).withColumn("metric", F.lit("acc"))
    group = t.lineitem.select(F.col("l_suppkey").cast("string").alias("group"), name.alias("task")).distinct()
    out = rp.custom_group_metric(m, group, registry.GROUP_AGGREGATIONS["difference"], "acc")
    return out.select("group", r6(F.col("value"), "value"))


@query("resolved_overrides", "RLP-7", """select 'c' || c_custkey::varchar task, 'shots' key, case when c_custkey % 10 = 0 then 'own' when n_regionkey < 3 then
  'r' || n_regionkey::varchar else 'n' || n_nationkey::varchar end as value from customer join nation on c_nationkey = n_nationkey""")
def resolved_overrides(t):
    rows = [
        t.customer.where("c_custkey % 10 = 0").select(tagged("c", "c_custkey").alias("node"), F.lit("own").alias("value")),
        t.nation.select(tagged("n", "n_nationkey").alias("node"), tagged("n", "n_nationkey").alias("value")),
        t.region.where("r_regionkey < 3").select(tagged("r", "r_regionkey").alias("node"), tagged("r", "r_regionkey").alias("value")),
    ]
    overrides = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("key", F.lit("shots"))
    return rp.resolve_overrides(overrides.select("node", "key", "value"), rp.expand_hierarchy(edges(t)))


TABLE = """(select event_type task, 'acc' metric, 'none' as filter, avg(value) / 997 as value, stddev_samp(value) / sqrt(count(*)) / 997 stderr
  from events group by 1 union all select event_type, 'ppl', 'none', max(value), null from events group by 1)"""


def report_metrics(t):
    x = F.col("value")
    by = t.events.groupBy(F.col("event_type").alias("task")).agg(
        (F.avg(x) / 997).alias("a"), (ag.mean_stderr(x) / 997).alias("s"), F.max(x).alias("m")
    )
    rows = F.array(
        F.struct(F.lit("acc").alias("metric"), F.col("a").alias("value"), F.col("s").alias("stderr")),
        F.struct(F.lit("ppl").alias("metric"), F.col("m").alias("value"), F.lit(None).cast("double").alias("stderr")),
    )
    return by.select("task", F.explode(rows).alias("r")).select("task", "r.metric", F.lit("none").alias("filter"), "r.value", "r.stderr")


@query("results_table", "RLP-8 SRT-1", f"""select case when metric = 'acc' then task else '' end shown_task, task, metric, filter,
  printf('%.2f', value * case when metric = 'ppl' then 1 else 100 end) shown, case when stderr is null then '' else '±' end sign,
  case when stderr is null then '' else printf('%.2f', stderr * 100) end error from {TABLE}""")
def results_table(t):
    return rp.results_table(report_metrics(t)).orderBy("task", "metric")


def two_runs(t):
    def run(parity):
        x = F.col("value")
        return t.events.where(F.col("event_id") % 2 == parity).groupBy("user_id").agg(F.avg(x).alias("value"), ag.mean_stderr(x).alias("stderr"))

    return paired(run(0), run(1), ["user_id"])


# the SQL integrates the normal density by Simpson's rule over 2,000 intervals
TAIL_SQL = """1 - 2 * (abs(z) / 2000 / 3) / sqrt(2 * pi()) * list_sum([(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)
  * exp(-0.5::double * (abs(z) * i / 2000) * (abs(z) * i / 2000)) for i in range(2001)])"""


@query("significance", "RLP-9", f"""with m as (select user_id, avg(value) filter (where event_id % 2 = 0) a, avg(value) filter (where event_id % 2 = 1) b,
  stddev_samp(value) filter (where event_id % 2 = 0) / sqrt(count(*) filter (where event_id % 2 = 0)) sa,
  stddev_samp(value) filter (where event_id % 2 = 1) / sqrt(count(*) filter (where event_id % 2 = 1)) sb from events group by 1),
z as (select user_id, (a - b) / sqrt(sa * sa + sb * sb) z from m),
p as (select user_id, z, {TAIL_SQL} p from z)
select user_id, round(z, 6) z, round(p, 6) p_value, case when p > 0.05 then '✓' else '×' end mark from p""")
def significance(t):
    return rp.significance(two_runs(t)).select("user_id", r6(F.col("z"), "z"), r6(F.col("p_value"), "p_value"), "mark")


@query("preferred_metric", "RLP-10", """select l_suppkey task, round(coalesce(avg(l_tax) filter (where l_returnflag = 'A' and l_suppkey % 3 = 0), avg(l_discount) filter (where l_suppkey % 3 < 2),
  avg(l_quantity) filter (where l_suppkey % 6 = 2), 0), 6) as value from lineitem group by 1""")
def preferred_metric(t):
    k = F.col("l_suppkey") % 3
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("task")).agg(
        F.avg(F.when((F.col("l_returnflag") == "A") & (k == 0), F.col("l_tax"))).alias("acc_norm"),
        F.avg(F.when(k < 2, F.col("l_discount"))).alias("acc"), F.avg(F.when(F.col("l_suppkey") % 6 == 2, F.col("l_quantity"))).alias("word_perplexity"),
    )
    long = rows.select("task", F.explode(F.create_map(*[x for m in ("acc_norm", "acc", "word_perplexity") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    named = long.withColumn("filter", F.lit("none"))
    return rp.preferred_metric(named, ["acc_norm", "acc", "word_perplexity"]).select("task", r6(F.col("value"), "value"))


@query("flat_keys", "RLP-11", """select event_type || '/acc' || case when user_id % 2 = 0 then '' else ',strict' end key, round(avg(value), 6) as value
from events group by 1""")
def flat_keys(t):
    f = F.when(F.col("user_id") % 2 == 0, "none").otherwise("strict")
    m = t.events.groupBy(F.col("event_type").alias("task"), f.alias("filter")).agg(r6(F.avg("value"), "value")).withColumn("metric", F.lit("acc"))
    return rp.flat_keys(m)


@query("task_inventory", "RLP-12", """select l_suppkey task, count(*) filter (where l_linestatus = 'O') n_O, count(*) filter (where l_linestatus = 'F') n_F,
  array_to_string(list_sort(list_distinct(list(l_returnflag))), ', ') metrics from lineitem group by 1""")
def task_inventory(t):
    docs = t.lineitem.select(F.col("l_suppkey").alias("task"), F.col("l_linestatus").alias("split"))
    names = t.lineitem.select(F.col("l_suppkey").alias("task"), F.col("l_returnflag").alias("metric"))
    return rp.task_inventory(docs, names, ["O", "F"])


@query("leaderboard", "RLP-13", """select model, round(a, 6) a, round(n, 6) n, round(r, 6) r, round((a + n + r) / 3, 6) average, rank() over (order by (a + n + r) / 3 desc) as rank from (
  select l_linenumber::bigint model, avg(l_discount) filter (where l_returnflag = 'A') a, avg(l_discount) filter (where l_returnflag = 'N') n,
    avg(l_discount) filter (where l_returnflag = 'R') r from lineitem group by 1)""")
def leaderboard(t):
    scores = t.lineitem.groupBy(F.col("l_linenumber").cast("long").alias("model"), F.lower("l_returnflag").alias("task")).agg(F.avg("l_discount").alias("value"))
    out = rp.leaderboard(scores, ["a", "n", "r"])
    return out.select("model", *[r6(F.col(c), c) for c in ("a", "n", "r", "average")], F.col("rank").cast("long").alias("rank"))


@query("directed_ranks", "RLP-14", """with s as (select event_type model, 'mean' metric, avg(value) v from events group by 1 union all select event_type, 'loss', stddev_samp(value) from events group by 1)
select model, metric, rank() over (partition by metric order by case when metric = 'mean' then v else -v end desc) as rank from s""")
def directed_ranks(t):
    x = F.col("value")
    by = t.events.groupBy(F.col("event_type").alias("model")).agg(F.create_map(F.lit("mean"), F.avg(x), F.lit("loss"), F.stddev_samp(x)).alias("m"))
    scores = by.select("model", F.lit("events").alias("task"), F.explode("m").alias("metric", "value"))
    directions = scores.select("metric", (F.col("metric") == "mean").alias("higher_is_better")).distinct()
    return rp.directed_rank(scores, directions).select("model", "metric", F.col("rank").cast("long").alias("rank"))


@query("safe_names", "RLP-15", r"""select page_id, regexp_replace(url, '["<>:/|\\?*\[\]]+', '__', 'g') as name from pages""")
def safe_names(t):
    return t.pages.select("page_id", rp.safe_name(F.col("url")).alias("name"))


@query("runtime_shares", "RLP-16", """select event_type branch, round(100 * sum(value) / (select sum(value) from events where event_type = 'click'), 6) percent from events group by 1""")
def runtime_shares(t):
    runs = t.events.groupBy(F.col("event_type").alias("branch")).agg(F.sum("value").alias("runtime"))
    return rp.runtime_share(runs, "branch", "runtime", "click").select("branch", r6(F.col("percent"), "percent"))


@query("frequent_words", "TOP-2 SRT-1", f"""select w, count(*) n from (select unnest({q.words('lower(text)')}) w from documents) group by w order by n desc, w limit 50""")
def frequent_words(t):
    return t.documents.select(F.explode(words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), "w").limit(50)


@query("heavy_words", "TOP-2", f"""select item, n from (select w item, count(*) n from (select unnest({q.words('lower(text)')}) w from documents) group by w
  order by n desc, item limit 50)""")
def heavy_words(t):
    """The same words from frequent-item summaries: a task sends its counters, not every distinct word."""
    return hv.heavy_hitters(t.documents.select(words(F.lower("text")).alias("w")), "w", 50)


if "demo.shout" not in registry.FUNCTIONS:
    registry.register_function("demo.shout")(lambda c: F.concat(F.upper(c), F.lit("!")))


@query("named_functions", "UDF-1", "select p_partkey, upper(p_name) || '!' shout from part")
def named_functions(t):
    return t.part.select("p_partkey", registry.call("demo.shout", "p_name").alias("shout"))


class NextTurn(registry.Task):
    """Does the assistant's answer repeat the first word of the question?"""

    name = "next_turn"

    def docs(self, source):
        return source.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))

    def requests(self, docs):
        return docs.select("conv_id", "turn", F.concat("question", F.lit("\nA:")).alias("ctx"))

    def score(self, docs, responses):
        first = F.lower(F.get(words("question"), F.lit(0)))
        return docs.join(responses, ["conv_id", "turn"]).select(F.contains(F.lower("response"), first).cast("int").alias("hit"))

    def aggregate(self, scores):
        return scores.agg(r6(F.avg("hit"), "hit_rate"), F.count("*").alias("n"))


@query("task_class", "UDF-5", f"""select round(avg(contains(lower(p), lower({q.words('r')}[1]))::int), 6) hit_rate, count(*) n from (
  select a.text p, u.text r from conversations a join conversations u on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where a.role = 'assistant' and u.role = 'user')""")
def task_class(t):
    def answer(requests):
        said = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
        return requests.join(said, ["conv_id", "turn"])

    return NextTurn().evaluate(t.conversations, answer)
