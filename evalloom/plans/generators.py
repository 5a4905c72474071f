"""Generated examples; operands, keys and texts come from the tables so that the SQL can recompute them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions.text import words
from evalloom.operators import generate as g
from evalloom.operators.scale import positions
from evalloom.plans import sqltext as q
from evalloom.plans.catalog import query

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ROWS = ", ".join(ROW)


def rev(x: str, width: int | None = None) -> str:
    if not width:
        return f"reverse(({x})::varchar)"
    return f"reverse(repeat('0', greatest(0, {width} - length(({x})::varchar))) || ({x})::varchar)"


@query("fixed_addition", "GEN-1", f"""select {ROWS}, '[' || {rev('l_partkey % 10000', 4)} || '] + [' || {rev('l_suppkey % 10000', 4)}
  || '] = [' || {rev('l_partkey % 10000 + l_suppkey % 10000', 5)} || ']' line,
  '[' || {rev('l_partkey', 3)} || '] + [' || {rev('l_suppkey', 3)} || '] = [' || {rev('l_partkey + l_suppkey', 4)} || ']' wider
  from lineitem""")
def fixed_addition(t):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return t.lineitem.select(
        *ROW, g.addition_text(a % 10000, b % 10000, 4).alias("line"), g.addition_text(a, b, 3).alias("wider")
    )


def number_sql(tag: str) -> str:
    width = f"{q.stable_hash(repr('width'), repr(tag), 'o_orderkey')} % 4"
    value = q.stable_hash(repr("value"), repr(tag), "o_orderkey")
    low = f"(case when {width} = 0 then 0 else pow(10, {width})::bigint end)"
    return f"({low} + {value} % (pow(10, {width} + 1)::bigint - {low}))"


@query("variable_addition", "GEN-2", f"""select o_orderkey, '[' || {rev('a')} || '] + [' || {rev('b')} || '] = ['
  || {rev('a + b')} || ']' line from (select o_orderkey, {number_sql('a')} a, {number_sql('b')} b from orders)""")
def variable_addition(t):
    a, b = (g.variable_width_number(4, F.lit(tag), "o_orderkey") for tag in "ab")
    return t.orders.select("o_orderkey", a.alias("a"), b.alias("b")).select(
        "o_orderkey", g.addition_text(F.col("a"), F.col("b")).alias("line")
    )


# Numbers of a sequence: digits of the hash of the order key; marks at two sampled places.
SEQ = f"""seq as (select o_orderkey, 5 + o_custkey % 4 n, [({q.stable_hash("'n'", 'o_orderkey', 'i')}) % 10000 for i in range(8)] v,
  {q.stable_hash("'a'", 'o_orderkey')} % 3 + 1 a, {q.stable_hash("'b'", 'o_orderkey')} % 3 + 4 b from orders),
cut as (select o_orderkey, v[1:n] v, a, b from seq)"""


def sequences(t):
    numbers = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.pmod(g.stable_hash(F.lit("n"), F.col("o_orderkey"), i), F.lit(10000)),
    )
    return t.orders.select(
        "o_orderkey",
        F.slice(numbers, F.lit(1), (F.col("o_custkey") % 4 + 5).cast("int")).alias("v"),
        (g.draw(3, F.lit("a"), "o_orderkey") + 1).alias("a"),
        (g.draw(3, F.lit("b"), "o_orderkey") + 4).alias("b"),
    )


INTERVAL_SQL = """array_to_string(v[1:a-1] || ['R'] || v[a:b-1] || ['R'] || v[b:], ' ')
  || ' ?interval = ' || list_sum([x::bigint for x in v[a:b-1]])::varchar"""
LAST_SQL = """array_to_string(v[1:a-1] || ['R'] || v[a:], ' ') || ' ?last = ' || list_sum([x::bigint for x in v[a:]])::varchar"""
TEXT_SEQ = f"{SEQ}, texts as (select o_orderkey, [x::varchar for x in v] v, a, b from cut)"


@query("interval_sums", "GEN-3", f"with {TEXT_SEQ} select o_orderkey, {INTERVAL_SQL} line from texts")
def interval_sums(t):
    tokens = g.marked_sequence(F.col("v"), F.array("a", "b"))
    return sequences(t).select("o_orderkey", tokens.alias("t")).select(
        "o_orderkey", g.interval_text(F.col("t")).alias("line")
    )


@query("last_sums", "GEN-4", f"with {TEXT_SEQ} select o_orderkey, {LAST_SQL} line from texts")
def last_sums(t):
    tokens = g.marked_sequence(F.col("v"), F.array("a"))
    return sequences(t).select("o_orderkey", tokens.alias("t")).select("o_orderkey", g.last_text(F.col("t")).alias("line"))


@query("interval_last_mixture", "GEN-5", f"""with {TEXT_SEQ} select o_orderkey,
  case when {q.stable_hash("'mix'", 'o_orderkey')} % 2 = 0 then {INTERVAL_SQL} else {LAST_SQL} end line from texts""")
def interval_last_mixture(t):
    both = sequences(t).select(
        "o_orderkey",
        g.marked_sequence(F.col("v"), F.array("a", "b")).alias("two"),
        g.marked_sequence(F.col("v"), F.array("a")).alias("one"),
    )
    line = F.when(g.draw(2, F.lit("mix"), "o_orderkey") == 0, g.interval_text(F.col("two"))).otherwise(
        g.last_text(F.col("one"))
    )
    return both.select("o_orderkey", line.alias("line"))


def hashed(tag: str, *parts: str) -> str:
    return q.stable_hash("'42'", f"'{tag}'", *parts)


@query("haystacks", "GEN-6", f"""with k as (select doc_id, ['key-' || ({hashed('k', 'doc_id', 'i')} % 1000000000)::varchar
  for i in range(1, 4)] keys, [{hashed('v', 'doc_id', 'i')} % 9000000 + 1000000 for i in range(6)] vals,
  length(text) len_text from documents)
select doc_id, keys[1] || ', and ' || keys[2] query, array_to_string(vals[1:4], ' ') outputs, 4::bigint n_present,
  (len_text + 6 + list_sum([length('One of the special magic numbers for ' || keys[i // 2 + 1] || ' is: '
    || vals[i + 1]::varchar || '.') for i in range(6)]))::bigint n_chars from k""")
def haystacks(t):
    rows = g.haystack_rows(t.documents, "doc_id", F.split("text", " "), 3, 2, 2)
    present = F.size(F.filter("outputs", lambda v: F.contains(F.col("input"), F.concat(F.lit("is: "), v, F.lit(".")))))
    return rows.select(
        "doc_id", "query", F.array_join("outputs", " ").alias("outputs"), present.cast("long").alias("n_present"),
        F.length("input").cast("long").alias("n_chars"),
    )


@query("variable_chains", "GEN-7", f"""select o_orderkey, ({hashed('q', 'o_orderkey')} % 89999 + 10000)::varchar query,
  5::bigint n_outputs, 5::bigint n_linked, 12::bigint n_noise from orders""")
def variable_chains(t):
    rows = g.chain_rows(t.orders, "o_orderkey", 12, 4)
    linked = F.filter(
        "outputs",
        lambda v, i: F.contains(
            F.col("input"),
            F.concat(F.lit("VAR "), v, F.lit(" = "), F.when(i == 0, F.col("query")).otherwise(
                F.concat(F.lit("VAR "), F.get("outputs", F.greatest(i - 1, F.lit(0)))))),
        ),
    )
    noise = (F.length("input") - F.length(F.replace("input", F.lit("The grass is green."), F.lit("")))) / 19
    return rows.select(
        "o_orderkey", "query", F.size("outputs").cast("long").alias("n_outputs"), F.size(linked).cast("long").alias("n_linked"),
        noise.cast("long").alias("n_noise"),
    )


@query("common_word_lists", "GEN-8 TOP-2", r"""with parts as (select p_partkey // 40 p_list, list(p_partkey::varchar order by p_partkey) v
  from part group by 1)
select p_list, array_to_string(list_transform(v[1:3], lambda x: 'w' || x), ' ') outputs,
  (len(v) + 15)::bigint n_words, 6::bigint top_count from parts""")
def common_word_lists(t):
    lists = t.part.groupBy(F.floor(F.col("p_partkey") / 40).alias("p_list")).agg(F.array_sort(F.collect_list("p_partkey")).alias("v"))
    named = F.transform("v", lambda x: F.concat(F.lit("w"), x.cast("string")))
    rows = g.common_word_rows(lists, "p_list", named, 3, 6, 1)
    listed = rows.select("p_list", "outputs", F.regexp_extract_all("input", F.lit(r"\. (\w+)"), F.lit(1)).alias("w"))
    counted = listed.select("p_list", F.explode("w").alias("word")).groupBy("p_list", "word").agg(F.count("*").alias("c"))
    top = counted.groupBy("p_list").agg(F.max("c").alias("top_count"), F.sum("c").alias("n_words"))
    return rows.join(top, "p_list").select(
        "p_list", F.array_join("outputs", " ").alias("outputs"), "n_words", "top_count"
    )


@query("coded_word_texts", "GEN-9 TOP-2", """with parts as (select p_partkey // 40 p_list, list(p_partkey order by p_partkey) v from part
  group by 1)
select p_list, array_to_string([('w' || x::varchar) for x in v[2:4]], ' ') outputs,
  list_sum([floor(500 * pow(i::double, -2.0::double) / 1.6449340668482264::double)::bigint for i in range(1, len(v) + 1)])::bigint n_words
from parts""")
def coded_word_texts(t):
    lists = t.part.groupBy(F.floor(F.col("p_partkey") / 40).alias("p_list")).agg(F.array_sort(F.collect_list("p_partkey")).alias("v"))
    named = F.transform("v", lambda x: F.concat(F.lit("w"), x.cast("string")))
    rows = g.coded_text_rows(lists, "p_list", named, 500)
    return rows.select(
        "p_list", F.array_join("outputs", " ").alias("outputs"),
        F.size(words("input")).cast("long").alias("n_words"),
    )


def passages(t):
    return positions(t.documents.select("doc_id", "text"), "doc_id", "passage")


@query("distractor_contexts", "GEN-10", f"""with p as (select text, row_number() over (order by doc_id) - 1 passage,
  count(*) over () n from documents), qs as (select item_id, (item_id * 7) % (select count(*) from documents) gold from benchmark),
chosen as (select item_id, gold, gold passage from qs union all
  select item_id, gold, (gold + 1 + ({q.stable_hash("'42'", 'item_id')} % (n - 1) + j * 2654435761) % (n - 1)) % n
  from qs, range(5) r(j), (select count(*) n from documents)),
ranked as (select item_id, gold, passage, text, row_number() over (partition by item_id
  order by {q.stable_hash("'42'", "'order'", 'item_id', 'passage')}) r from chosen join p using (passage))
select item_id, gold, string_agg(passage::varchar, ' ' order by r) passages,
  md5(string_agg('Document ' || r::varchar || ':' || chr(10) || text, chr(10) || chr(10) order by r)) digest
from ranked group by item_id, gold""")
def distractor_contexts(t):
    n = t.documents.count()
    questions = t.benchmark.select("item_id", F.pmod(F.col("item_id") * 7, F.lit(n)).alias("gold"))
    rows = g.distractor_rows(questions, passages(t), "item_id", "gold", "passage", "text", 6)
    return rows.select(
        "item_id", "gold", F.array_join(F.transform("passages", lambda p: p.cast("string")), " ").alias("passages"),
        F.md5("context").alias("digest"),
    )


@query("calibrated_fillers", "GEN-11", """with l as (select doc_id, unnest(string_split(text, ' ')) w, generate_subscripts(
  string_split(text, ' '), 1) i from documents),
r as (select doc_id, i, sum(length(w) + 1) over (partition by doc_id order by i) + 40 total from l)
select doc_id, coalesce(max(case when i % 5 = 0 and total <= 600 then i end), 0)::bigint units from r group by doc_id""")
def calibrated_fillers(t):
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w) + 1)
    return t.documents.select("doc_id", g.fitting_prefix(lengths, F.lit(40), F.lit(600), 5).alias("units"))


@query("calibrated_repeats", "GEN-11", """select doc_id, (floor(greatest(4096 - length(text), 0) / (93 * 25)) * 25)::bigint units
from documents""")
def calibrated_repeats(t):
    return t.documents.select(
        "doc_id", g.filler_steps(F.length("text"), F.lit(93), F.lit(4096), 25).alias("units")
    )
