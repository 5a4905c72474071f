"""Document reshaping queries over the corpus, pages, conversations and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import docs as d
from evalloom.functions.text import capitalize
from evalloom.plans import sqltext as q
from evalloom.plans.catalog import query

CAP = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"


def lit(x: str) -> str:
    quoted = x.replace("'", "''")
    parts = quoted.split("\n")
    return "'" + "' || chr(10) || '".join(parts) + "'"


def chain(x: str, rules) -> str:
    for old, new in rules:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    return x


def regex_chain(x: str, rules) -> str:
    for old, new in rules:
        new = new.replace("$1", "\\1").replace("$2", "\\2")
        x = f"regexp_replace({x}, {lit(old)}, {lit(new)}, 'g')"
    return x


ACTIVITY = chain(regex_chain(chain(q.strip("t"), ((" [title]", ". "),)), ((r"\[[^\n]*?\]", ""),)), (("  ", " "),))


@query("row_map", "DOC-1", f"""select doc_id, md5({ACTIVITY}) digest from (
  select doc_id, source || ' [title]: ' || {CAP.format('text')} || ' [x]  ' t from documents)""")
def row_map(t):
    text = F.concat("source", F.lit(" [title]: "), capitalize("text"), F.lit(" [x]  "))
    return t.documents.select("doc_id", F.md5(d.activity_text(text)).alias("digest"))


@query("row_filter", "DOC-2", """select doc_id, lang, source from documents
where lang in ('de', 'fr') and source like 'src1%'""")
def row_filter(t):
    keep = F.col("lang").isin("de", "fr") & F.startswith("source", F.lit("src1"))
    return t.documents.where(keep).select("doc_id", "lang", "source")


WIKI = chain(regex_chain(chain(regex_chain(chain("text", (("s '", "s'"),)), (("/' [0-9]/", "/'[0-9]/"),)), d.WIKI_BEFORE),
                         d.WIKI_PAIRS), d.WIKI_AFTER)


@query("detokenised", "DOC-3", f"""select doc_id, md5({WIKI}) wiki, md5({chain('text', d.DIALOGUE_RULES)}) dialogue,
  md5({regex_chain('text', d.GENERAL_RULES)}) general from documents""")
def detokenised(t):
    return t.documents.select(
        "doc_id", F.md5(d.detokenize_wiki("text")).alias("wiki"), F.md5(d.detokenize_dialogue("text")).alias("dialogue"),
        F.md5(d.detokenize_general("text")).alias("general"),
    )


OPTIONS = "[p_brand, p_type, p_name, p_size::varchar]"


def part_options(t):
    return t.part.select(
        "p_partkey", "p_name", (F.col("p_partkey") % 4).cast("int").alias("gold"),
        F.array("p_brand", "p_type", "p_name", F.col("p_size").cast("string")).alias("options"),
    )


@query("rendered_prompts", "DOC-4", f"""select p_partkey, 'Question: ' || p_name || chr(10) || array_to_string(list_transform(
  {OPTIONS}, lambda o, i: chr(64 + i::int) || '. ' || o || chr(10)), '') || 'Answer:' prompt,
  chr(65 + (p_partkey % 4)::int) target from part""")
def rendered_prompts(t):
    prompt = F.concat(F.lit("Question: "), "p_name", F.lit("\n"), d.options_block(F.col("options")), F.lit("Answer:"))
    return part_options(t).select("p_partkey", prompt.alias("prompt"), d.letter(F.col("gold")).alias("target"))


@query("delimited_joins", "DOC-5", f"""select p_partkey, case when regexp_matches(a, '{q.SPACE_CLASS}\\z')
  or regexp_matches(b, '\\A{q.SPACE_CLASS}') then a || b else a || ' ' || b end joined from (
  select p_partkey, p_name || case when p_partkey % 3 = 0 then ' ' when p_partkey % 3 = 1 then chr(10) else '' end a,
    case when p_partkey % 2 = 0 then chr(9) else '' end || p_type b from part)""")
def delimited_joins(t):
    k = F.col("p_partkey")
    a = F.concat("p_name", F.when(k % 3 == 0, " ").when(k % 3 == 1, "\n").otherwise(""))
    b = F.concat(F.when(k % 2 == 0, "\t").otherwise(""), "p_type")
    return t.part.select("p_partkey", d.join_delimited(a, b).alias("joined"))




def conversations(t):
    turn = F.struct("turn", "role", F.col("text").alias("content"), F.lit("\n\n").alias("delimiter"))
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))


@query("chat_text", "DOC-6", """select conv_id, md5(string_agg(text || chr(10) || chr(10), '' order by turn)) digest,
  count(*) n_messages from conversations group by conv_id""")
def chat_text(t):
    return conversations(t).select(
        "conv_id", F.md5(d.messages_text(F.col("m"))).alias("digest"), F.size("m").cast("long").alias("n_messages")
    )


@query("single_turn_chat", "DOC-6", """with n as (select *, row_number() over (partition by conv_id order by turn) r,
  count(*) over (partition by conv_id) n, first_value(role) over (partition by conv_id order by turn) fr,
  last_value(role) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) lr
  from conversations),
k as (select *, case when r = 1 and fr = 'system' then 0 when r = n and lr = 'assistant' then 2 else 1 end part from n)
select conv_id, count(distinct part) n_messages, md5(string_agg(text, chr(10) || chr(10) order by turn) filter (where part = 1)) digest
from k group by conv_id""")
def single_turn_chat(t):
    one = conversations(t).select("conv_id", d.single_turn(F.col("m")).alias("s"))
    user = F.get(F.filter("s", lambda x: x["role"] == "user"), F.lit(0))["content"]
    return one.select("conv_id", F.size("s").cast("long").alias("n_messages"), F.md5(user).alias("digest"))


@query("question_history", "DOC-7", """with qa as (select conv_id,
  list(text order by turn) filter (where role = 'user') q, list(text order by turn) filter (where role = 'assistant') a
  from conversations group by conv_id)
select conv_id, md5('conversation ' || conv_id::varchar || chr(10) || chr(10) || array_to_string(list_transform(q, lambda x, i:
  'Q: ' || x || chr(10) || chr(10) || case when i < len(q) then 'A: ' || a[i] || chr(10) || chr(10) else 'A:' end), '')) digest
from qa where q is not null and coalesce(len(a), 0) >= len(q) - 1""")
def question_history(t):
    m = conversations(t).select(
        "conv_id",
        F.transform(F.filter("m", lambda x: x["role"] == "user"), lambda x: x["content"]).alias("q"),
        F.transform(F.filter("m", lambda x: x["role"] == "assistant"), lambda x: x["content"]).alias("a"),
    )
    story = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    prompt = d.question_history(story, F.col("q"), F.col("a"))
    return m.where((F.size("q") > 0) & (F.size("a") >= F.size("q") - 1)).select("conv_id", F.md5(prompt).alias("digest"))


@query("markdown_tables", "DOC-8", """select l_orderkey, '| line | part | flag |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| ' || l_linenumber::varchar || ' | ' || l_partkey::varchar || ' | ' || l_returnflag || ' |', chr(10)
    order by l_linenumber, l_partkey, l_returnflag) block from lineitem group by l_orderkey""")
def markdown_tables(t):
    row = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    orders = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    cells = F.transform("r", lambda x: F.array(
        x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_returnflag"]))
    headers = F.array(F.lit("line"), F.lit("part"), F.lit("flag"))
    return orders.select("l_orderkey", d.markdown_table(headers, cells).alias("block"))


ANSWERS = """select p_partkey, [p_type, lower(p_type), p_brand, p_name, upper(p_brand), p_name] a from part"""


def answers(t):
    a = F.array("p_type", F.lower("p_type"), "p_brand", "p_name", F.upper("p_brand"), "p_name")
    return t.part.select("p_partkey", "p_name", "p_size", "p_type", "p_brand", a.alias("a"))


@query("distinct_answers", "DOC-9", f"""select p_partkey, array_to_string(list_sort(list_distinct(a)), '|') sorted,
  array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') ordered,
  array_to_string(list_filter(a, lambda x, i: list_position([lower(y) for y in a], lower(x)) = i), '|') folded
from ({ANSWERS})""")
def distinct_answers(t):
    return answers(t).select(
        "p_partkey", F.array_join(d.distinct_sorted(F.col("a")), "|").alias("sorted"),
        F.array_join(F.array_distinct("a"), "|").alias("ordered"),
        F.array_join(d.distinct_ignoring_case(F.col("a")), "|").alias("folded"),
    )


@query("typed_answers", "DOC-10", """select p_partkey, case when p_partkey % 3 = 0 then p_size::varchar
  when p_partkey % 3 = 1 then p_name || '|' || p_type else p_size::varchar || ' ' || p_brand || ' 1994' end answer from part""")
def typed_answers(t):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    none = F.array().cast("array<string>")
    answer = d.typed_answer(
        F.when(k == 0, size).otherwise(""), F.when(k == 1, F.array("p_name", "p_type")).otherwise(none), size,
        F.col("p_brand"), F.lit("1994 "),
    )
    return t.part.select("p_partkey", F.array_join(answer, "|").alias("answer"))


def options_sql(label: str) -> str:
    return f"array_to_string(list_transform({OPTIONS}, lambda o, i: {label} || '. ' || o || chr(10)), '')"


@query("formatted_options", "DOC-11", f"""select p_partkey, {options_sql('chr(64 + i::int)')} letters,
  {options_sql('chr(96 + i::int)')} lowers, {options_sql('i::varchar')} numerals,
  {options_sql("(['I', 'II', 'III', 'IV'])[i]")} romans from part""")
def formatted_options(t):
    styles = {"letters": "letter", "lowers": "lower", "numerals": "numeral", "romans": "roman"}
    return part_options(t).select(
        "p_partkey", *[d.options_block(F.col("options"), s).alias(n) for n, s in styles.items()]
    )


@query("option_order_copies", "DOC-12", f"""select p_partkey, chr(65 + s::int) always_same, g::bigint original, array_to_string(
  [case when i = s then o[g + 1] when i = g then o[s + 1] else o[i + 1] end for i in range(4)], '|') options
from (select p_partkey, p_partkey % 4 g, {OPTIONS} o from part), range(4) r(s)""")
def option_order_copies(t):
    copies = part_options(t).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return copies.select(
        "p_partkey", d.letter(F.col("slot")).alias("always_same"), F.col("gold").cast("long").alias("original"),
        F.array_join(d.swap(F.col("options"), F.col("slot"), F.col("gold")), "|").alias("options"),
    )


TEMPLATES = ("Answer this: {}", "Q: {}\nA:", "{} is?")


@query("prompt_variants", "DOC-13", f"""select p_partkey, i::bigint prompt_id, replace(tpl, '{{}}', p_name) prompt from part,
  (select unnest(range(3)) i, unnest([{', '.join(lit(x) for x in TEMPLATES)}]) tpl)""")
def prompt_variants(t):
    variants = t.part.select("p_partkey", "p_name", F.posexplode(F.array(*[F.lit(x) for x in TEMPLATES])).alias("i", "tpl"))
    return variants.select(
        "p_partkey", F.col("i").cast("long").alias("prompt_id"), F.replace("tpl", F.lit("{}"), F.col("p_name")).alias("prompt")
    )


@query("permuted_choices", "DOC-14", f"""select p_partkey, array_to_string([o[(i + s) % 4 + 1] for i in range(4)], '|') choices,
  ((g - s + 4) % 4)::bigint gold from (select p_partkey, p_partkey % 4 g, {OPTIONS} o,
  {q.stable_hash("'7'", 'p_partkey')} % 3 + 1 s from part)""")
def permuted_choices(t):
    moved = part_options(t).withColumn("m", d.moved_choices(F.col("options"), F.col("gold"), F.lit(7), "p_partkey"))
    return moved.select(
        "p_partkey", F.array_join("m.choices", "|").alias("choices"), F.col("m.gold").cast("long").alias("gold")
    )


@query("long_prompts", "DOC-15", """select p_partkey, 'Question: ' || p_name || chr(10) || 'Answer: ' || p_type || chr(10) || chr(10)
  || 'Question: ' || p_brand || chr(10) || 'Answer: ' || p_size::varchar || chr(10) || chr(10) prompt from part""")
def long_prompts(t):
    return t.part.select(
        "p_partkey",
        d.shots_prompt(F.array("p_name", "p_brand"), F.array("p_type", F.col("p_size").cast("string"))).alias("prompt"),
    )


@query("content_hashes", "DOC-16", "select doc_id, sha256(text) doc_hash, sha256(source || lang) target_hash from documents")
def content_hashes(t):
    return t.documents.select(
        "doc_id", F.sha2("text", 256).alias("doc_hash"), F.sha2(F.concat("source", "lang"), 256).alias("target_hash")
    )


@query("two_way_orders", "DOC-17", f"""select p_partkey, case when k then p_name || '|' || p_type else p_type || '|' || p_name end scenarios,
  k::int::bigint as label from (select *, {q.stable_hash('p_name', 'p_partkey')} % 2 = 0 k from part)""")
def two_way_orders(t):
    order = d.two_way_order(F.col("p_name"), F.col("p_type"), "p_name", "p_partkey")
    return t.part.select("p_partkey", order.alias("o")).select(
        "p_partkey", F.array_join("o.scenarios", "|").alias("scenarios"), F.col("o.label").cast("long").alias("label")
    )


@query("threshold_labels", "DOC-18", "select event_id, (value + user_id % 5 > 10.5)::int::bigint as label from events")
def threshold_labels(t):
    return t.events.select(
        "event_id", ((F.col("value") + F.col("user_id") % 5) > 10.5).cast("long").alias("label")
    )


@query("cloze_choices", "DOC-19", f"""select p_partkey, 'The ' || p_type || '|The ' || p_brand choices,
  {q.strip("' of ' || p_name")} target, 'The _ of ' || array_to_string(string_split(p_name, ' ')[1:len(string_split(p_name, ' ')) - 1], ' ') context,
  ' ' || string_split(p_name, ' ')[len(string_split(p_name, ' '))] last_word from part""")
def cloze_choices(t):
    sentence = F.concat(F.lit("The _ of "), "p_name")
    c, w = d.cloze(sentence, F.array("p_type", "p_brand")), d.last_word_split(sentence)
    return t.part.select("p_partkey", c.alias("c"), w.alias("w")).select(
        "p_partkey", F.array_join("c.choices", "|").alias("choices"), F.col("c.target").alias("target"),
        F.col("w.context").alias("context"), F.col("w.target").alias("last_word"),
    )


TAGS = "case l_returnflag when 'A' then 'B-PER' when 'N' then 'I-PER' else 'O' end"


@query("bio_entities", "DOC-20", f"""with r as (select l_orderkey, l_partkey::varchar word, {TAGS} tag,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) i from lineitem),
m as (select *, sum(case when tag <> 'I-PER' then 1 else 0 end) over (partition by l_orderkey order by i) run from r),
e as (select l_orderkey, run, string_agg(word, '' order by i) w, min(i) i from m group by l_orderkey, run
  having min_by(tag, i) = 'B-PER')
select l_orderkey, string_agg('PER: ' || w, ' $$ ' order by i) entities from e group by l_orderkey""")
def bio_entities(t):
    tag = F.expr(TAGS)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                   F.concat(F.col("l_partkey").cast("string"), F.lit(": "), tag).alias("line"))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    entities = docs.select("l_orderkey", d.bio_entities(F.transform("r", lambda x: x["line"])).alias("e"))
    return entities.where(F.size("e") > 0).select("l_orderkey", F.array_join("e", " $$ ").alias("entities"))


NAMED = (("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"))


@query("unescaped_pages", "DOC-21", f"""select page_id, length(x)::bigint n_chars, md5(x) digest from (
  select page_id, regexp_replace({chain('html', NAMED)}, '&amp;?', '&', 'g') x from pages)""")
def unescaped_pages(t):
    text = t.pages.select("page_id", d.html_unescaped("html").alias("x"))
    return text.select("page_id", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("digest"))


@query("repaired_encoding", "DOC-21", "select doc_id, md5(text) digest from documents")
def repaired_encoding(t):
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.documents.select("doc_id", F.md5(d.repair_encoding(garbled)).alias("digest"))


@query("terminated_answers", "DOC-22", """select p_partkey, array_to_string(l, '|') answers from (
  select p_partkey, [p_name || '.', p_type || '.'] || case when p_partkey % 2 = 0 then ['I have no comment.']
    else ['No.', 'I have no comment.'] end l from part)""")
def terminated_answers(t):
    extra = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("I have no comment"))).otherwise(F.array(F.lit("No.")))
    raw = F.concat(F.array(F.concat(F.lit("  "), "p_name"), F.lit(" "), F.concat("p_type", F.lit(".\n"))), extra)
    return t.part.select("p_partkey", F.array_join(d.with_sentinel(d.terminated_answers(raw)), "|").alias("answers"))


@query("zipped_fields", "DOC-23", """select doc_id, len(w)::bigint n, list_sum(list_transform(w, lambda x, i: length(x) * i))::bigint crossed
from (select doc_id, string_split(text, ' ') w from documents)""")
def zipped_fields(t):
    parts = F.split("text", " ")
    arrays = t.documents.select("doc_id", parts.alias("w")).select("doc_id", "w", F.sequence(F.lit(1), F.size("w")).alias("i"))
    zipped = arrays.select("doc_id", F.arrays_zip("w", "i").alias("z"))
    crossed = F.aggregate("z", F.lit(0).cast("long"), lambda a, x: a + F.length(x["w"]) * x["i"])
    return zipped.select("doc_id", F.size("z").cast("long").alias("n"), crossed.alias("crossed"))


@query("flattened_answers", "DOC-24", """select l_orderkey, l_linenumber::bigint line, l_partkey, l_suppkey, q, answer from (
  select *, 'flag' q, case when l_returnflag = 'A' then 'yes' else 'no' end answer from lineitem
    where l_linestatus = 'O' and (l_returnflag = 'A' or (l_returnflag = 'N' and l_linenumber > 3))
  union all select *, 'cheap', case when l_discount > 0.05 then 'yes' else 'no' end from lineitem)""")
def flattened_answers(t):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    none = F.array().cast("array<string>")
    blob = d.answer_kind(
        F.col("l_linestatus") != "O", flag == "A", F.when(flag == "R", "free").otherwise(""),
        F.when(line <= 3, F.array(F.lit("a"), F.lit("b"))).otherwise(none),
    )
    other = d.answer_kind(F.lit(False), F.col("l_discount") > 0.05, F.lit(""), none)
    papers = t.lineitem.select(
        "l_orderkey", line.cast("long").alias("line"), "l_partkey", "l_suppkey",
        F.array(F.lit("flag"), F.lit("cheap")).alias("questions"), F.array(F.array(blob), F.array(other)).alias("answers"),
    )
    per_question = papers.select("*", F.explode(F.arrays_zip("questions", "answers")).alias("qa"))
    per_answer = per_question.select("*", F.col("qa.questions").alias("q"), F.explode("qa.answers").alias("a"))
    return per_answer.where("a.kind = 'bool'").select(
        "l_orderkey", "line", "l_partkey", "l_suppkey", "q", F.col("a.answer").alias("answer")
    )


@query("assembled_choices", "DOC-25", f"""with c as (select p_partkey, unnest([p_brand, p_type, p_name, 'right ' || p_size::varchar]) x,
  unnest(range(4)) i from part),
o as (select p_partkey, x, i, row_number() over (partition by p_partkey order by {q.stable_hash('p_partkey', 'i')}, i) r from c)
select p_partkey, string_agg(x, '|' order by r) choices, '(' || chr(64 + max(case when i = 3 then r end)::int) || ')' answer
from o group by p_partkey""")
def assembled_choices(t):
    right = F.concat(F.lit("right "), F.col("p_size").cast("string"))
    placed = d.hashed_choices(F.array("p_brand", "p_type", "p_name", right), right, "p_partkey")
    return t.part.select("p_partkey", placed.alias("c")).select(
        "p_partkey", F.array_join("c.choices", "|").alias("choices"), F.col("c.answer").alias("answer")
    )
