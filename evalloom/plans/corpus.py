"""Queries over the corpus: scans, statistics, tokens, packing, masks and splits. ``source`` plays the file."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import tokens as tk
from evalloom.operators import packing as pk
from evalloom.operators import prefix_packing as pp
from evalloom.operators.scale import positions
from evalloom.plans import sqltext as q
from evalloom.plans.catalog import query
from evalloom.sources import readers as rd
from evalloom.sources import writers as wr

BLOCK = 1024


def long(c: str, *names: str):
    return F.col(c).cast("long").alias(names[0] if names else c)


@query("archive_scan", "SRC-1 SNK-1", """select count(*) n_docs, sum(length(text))::bigint n_chars,
  count(distinct source) n_sources from documents""")
def archive_scan(t):
    folder = wr.write_archive(t.documents, "text", ["doc_id", "lang", "source"], wr.new_folder(t.spark, "archive"))
    back = rd.read_archive(t.spark, folder)
    return back.agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"),
        F.count_distinct(F.col("meta")["source"]).alias("n_sources"),
    )


@query("zstd_archive_scan", "SRC-1 SNK-1", "select doc_id, md5(text) digest, source from documents")
def zstd_archive_scan(t):
    folder = wr.write_zstd_archive(t.documents, "text", ["doc_id", "source"], wr.new_folder(t.spark, "zstd"))
    back = rd.read_zstd_archive(t.spark, folder, split_bytes=1 << 20)
    return back.select(
        F.col("meta")["doc_id"].cast("long").alias("doc_id"), F.md5("text").alias("digest"), F.col("meta")["source"].alias("source")
    )


@query("list_text_scan", "SRC-1", """select doc_id, md5(replace(text, chr(10), chr(10) || chr(10))) digest from documents""")
def list_text_scan(t):
    line = F.to_json(F.struct(F.split("text", "\n").alias("text")))
    parsed = rd.parse_archive_line(line)
    return t.documents.select("doc_id", F.md5(parsed["text"]).alias("digest"))


@query("bare_string_scan", "SRC-1", "select doc_id, md5(text) digest, 0::bigint n_meta from documents")
def bare_string_scan(t):
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", "$1")
    parsed = rd.parse_archive_line(quoted)
    return t.documents.select(
        "doc_id", F.md5(parsed["text"]).alias("digest"), F.size(parsed["meta"]).cast("long").alias("n_meta")
    )


@query("posting_lines", "SRC-2", """select doc_id, count(*) n_lines, max(ngram) last_ngram from (
  select doc_id, unnest(string_split(text, chr(10))) ngram from documents) group by doc_id""")
def posting_lines(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("ngram"), "doc_id").select(
        F.concat_ws(" ", "ngram", F.col("doc_id").cast("string")).alias("value")
    )
    parsed = lines.select(rd.split_posting(F.col("value")).alias("p")).select("p.*")
    return parsed.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("ngram").alias("last_ngram"))


@query("global_offsets", "SRC-3", """select doc_id, source, (row_number() over (order by source, doc_id) - 1) "offset"
from documents""")
def global_offsets(t):
    return rd.global_offsets(t.documents.select("doc_id", "source"), "source", "doc_id")


@query("file_statistics", "SRC-4", """select source, n_docs, n_chars,
  coalesce(sum(n_docs) over (order by source rows between unbounded preceding and 1 preceding), 0)::bigint start_offset
from (select source, count(*) n_docs, sum(length(text))::bigint n_chars from documents group by source)""")
def file_statistics(t):
    return rd.file_statistics(t.documents, "source", "text")


@query("corpus_totals", "SRC-4", """select count(*) n_docs, sum(length(text))::bigint n_chars,
  count(distinct source) n_files from documents""")
def corpus_totals(t):
    return rd.file_statistics(t.documents, "source", "text").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_files")
    )


@query("bound_split", "SRC-5", "select doc_id, n_chars from documents where lang = 'fr'")
def bound_split(t):
    return rd.bind_split(t.spark, t.path("documents"), lang="fr").select("doc_id", "n_chars")


METRIC_ROWS = """select event_type task, avg(value) acc, stddev_samp(value) / sqrt(count(*)) se, max(value) top
from events group by event_type"""


def results_json(t):
    stats = t.events.groupBy(F.col("event_type").alias("task")).agg(
        F.avg("value").alias("acc"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"), F.max("value").alias("top")
    )
    pairs = F.create_map(
        F.lit("acc,none"), F.col("acc"), F.lit("acc_stderr,none"), F.col("se"), F.lit("top,strict"), F.col("top")
    )
    return stats.select("task", F.to_json(pairs).alias("line"))


@query("melted_results", "SRC-7", f"""with s as ({METRIC_ROWS})
select task, 'acc' metric, 'none' as filter, round(acc, 6) as value, round(se, 6) stderr from s
union all select task, 'top', 'strict', round(top, 6), null from s""")
def melted_results(t):
    parsed = results_json(t).select("task", F.from_json("line", "map<string,double>").alias("metrics"))
    out = rd.melt_results(parsed, ["task"])
    return out.withColumns({c: F.round(c, 6) for c in ("value", "stderr")})


@query("sample_log", "SRC-6", """select event_type task, count(*) n, round(sum(value), 4) total from events
group by event_type""")
def sample_log(t):
    rows = t.events.select(
        F.col("event_type").alias("task"), F.lit("m").alias("model"), F.col("event_id").alias("doc_id"),
        F.create_map(F.lit("acc"), F.col("value")).alias("metrics"),
    )
    folder = wr.write_json_lines(rows, wr.new_folder(t.spark, "samples"))
    log = rd.read_sample_log(t.spark, folder)
    return log.groupBy("task").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("metrics")["acc"]), 4).alias("total")
    )


@query("latest_results", "SRC-8", """select user_id, event_id, epoch_us(ts) stamp from (
  select *, row_number() over (partition by user_id order by ts desc) r from events) where r = 1""")
def latest_results(t):
    rows = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"))
    return rd.latest(rows, ["user_id"], "stamp")


def limited(order: str, cap: str):
    return f"""select source, doc_id, n original, least(n, {cap})::bigint effective from (
  select source, doc_id, count(*) over (partition by source) n,
    row_number() over (partition by source order by doc_id) r from documents) where r <= {cap}"""


@query("limit_per_task", "SRC-9", limited("doc_id", "7"))
def limit_per_task(t):
    return rd.limit_per_task(t.documents.select("source", "doc_id"), "source", "doc_id", 7)


@query("limit_fraction_per_task", "SRC-9", limited("doc_id", "ceil(n * 0.15::double)"))
def limit_fraction_per_task(t):
    return rd.limit_per_task(t.documents.select("source", "doc_id"), "source", "doc_id", 0.15)


@query("smoke_test_cap", "SRC-10 TOP-1", "select doc_id, n_chars from documents order by doc_id limit 100")
def smoke_test_cap(t):
    return t.documents.select("doc_id", "n_chars").orderBy("doc_id").limit(100)


@query("resolved_catalogue", "SRC-11", """select p_name as name, path_no, file from (
  select p_name, (p_partkey % 5)::bigint path_no, p_partkey file, row_number() over (partition by p_name
    order by p_partkey % 5 desc, p_partkey) r from part) where r = 1""")
def resolved_catalogue(t):
    entries = t.part.select(
        F.col("p_name").alias("name"), (F.col("p_partkey") % 5).alias("path_no"), F.col("p_partkey").alias("file")
    )
    return rd.resolve_catalogue(entries)


@query("first_tenth", "SEL-2", """select doc_id from (select doc_id, row_number() over (order by doc_id) r,
  count(*) over () n from documents) where r <= floor(0.1::double * n)""")
def first_tenth(t):
    return rd.first_fraction(t.documents.select("doc_id"), "doc_id", 0.1)


LENGTH_BUCKET = "case when n_chars < 500 then '0-500' when n_chars < 2000 then '500-2000' else '2000+' end"


@query("length_buckets", "SEL-1", f"""select doc_id, {LENGTH_BUCKET} bucket from documents
where {LENGTH_BUCKET} in ('0-500', '2000+')""")
def length_buckets(t):
    docs = t.documents.select("doc_id", F.expr(LENGTH_BUCKET).alias("bucket"))
    return rd.keep_buckets(docs, "bucket", ["0-500", "2000+"])


# The byte of each position, from the hexadecimal form.
BYTES = """select doc_id, p, ('0x' || h)::bigint token from (
  select doc_id, unnest(l) h, unnest(range(0, len(l))) p from (
    select doc_id, regexp_extract_all(hex(encode(text)), '..') l from documents))"""


def token_summary(df, tokens: str, *keys: str):
    """Length, sum and position-weighted sum: equal only for equal token lists, in practice."""
    token = F.col("token").cast("long")
    return df.select(*keys, F.posexplode(tokens).alias("p", "token")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(token).alias("total"), F.sum(token * (F.col("p") % 997 + 1)).alias("weighted")
    )


def summary_sql(rows: str, key: str) -> str:
    return f"""select {key}, count(*) n, sum(token)::bigint total, sum(token * (p % 997 + 1))::bigint weighted
from ({rows}) group by {key}"""


WRAPPED = f"""select doc_id, p + 1 p, token from ({BYTES})
union all select doc_id, 0, 199998 from documents
union all select doc_id, octet_length(encode(text)) + 1, 200002 from documents"""


@query("byte_tokens", "TOK-1", summary_sql(BYTES, "doc_id"))
def byte_tokens(t):
    return token_summary(t.documents.select("doc_id", tk.byte_tokens("text").alias("tokens")), "tokens", "doc_id")


@query("wrapped_tokens", "TOK-2", summary_sql(WRAPPED, "doc_id"))
def wrapped_tokens(t):
    docs = t.documents.select("doc_id", tk.byte_tokens("text").alias("b")).select("doc_id", tk.wrap(F.col("b")).alias("tokens"))
    return token_summary(docs, "tokens", "doc_id")


COMPACT = f"select doc_id, p, case when token >= 199998 then token - 199742 else token end token from ({WRAPPED})"


@query("compact_tokens", "TOK-3", summary_sql(COMPACT, "doc_id"))
def compact_tokens(t):
    docs = t.documents.select("doc_id", tk.byte_tokens("text").alias("b")).select(
        "doc_id", tk.compact(tk.wrap(F.col("b"))).alias("tokens")
    )
    return token_summary(docs, "tokens", "doc_id")


@query("parsed_special_tokens", "TOK-4", """with d as (select doc_id,
  replace(replace(text, 'the', '<|endoftext|>'), '.', chr(1)) as text from documents),
c as (select doc_id, regexp_extract_all(text, '<\\|endoftext\\|>|(?s:.)') l from d)
select doc_id, sum(case when len(x) > 1 then 1 else octet_length(encode(x)) end)::bigint n,
  sum(case when len(x) > 1 then 1 else 0 end)::bigint specials
from (select doc_id, unnest(l) x from c) group by doc_id""")
def parsed_special_tokens(t):
    text = F.replace(F.replace("text", F.lit("the"), F.lit("<|endoftext|>")), F.lit("."), F.lit("\u0001"))
    docs = t.documents.select("doc_id", tk.parsed_tokens(text).alias("tokens"))
    return docs.select(
        "doc_id", F.size("tokens").cast("long").alias("n"),
        F.size(F.filter("tokens", lambda x: x >= tk.FIRST_SPECIAL)).cast("long").alias("specials"),
    )


@query("token_counts", "TOK-5", """select source, lang, count(*) n_docs,
  sum(octet_length(encode(text)) + 2)::bigint n_tokens from documents group by source, lang""")
def token_counts(t):
    return t.documents.groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"), F.sum(tk.wrapped_length("text")).alias("n_tokens")
    )


@query("train_val_split", "SPL-1", f"""select doc_id,
  case when {q.stable_hash("'1337'", 'doc_id')} % 2000 < 20 then 'val' else 'train' end split from documents""")
def train_val_split(t):
    return pk.split_documents(t.documents.select("doc_id"), parts=2000, held_out=20)


PLACED = """placed as (select doc_id, octet_length(encode(text)) + 2 n, coalesce(sum(octet_length(encode(text)) + 2)
  over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint at_token from documents)"""


@query("flat_blocks", "PCK-1", f"""with {PLACED}, tokens as (select at_token + p g, token
  from ({WRAPPED}) join placed using (doc_id))
select g // {BLOCK} block_id, count(*) n, sum(token)::bigint total,
  sum(token * (g % {BLOCK} % 997 + 1))::bigint weighted from tokens group by 1""")
def flat_blocks(t):
    docs = t.documents.select("doc_id", "text", tk.wrapped_length("text").alias("n"))
    blocks = pk.pack_flat(docs, tk.wrap(tk.byte_tokens("text")), F.col("n"), BLOCK)
    return token_summary(blocks, "tokens", "block_id")


WIDTH, THRESHOLD = 64, 100


SHARD_WALK = f"""d as (select doc_id // {WIDTH} shard, doc_id,
  octet_length(encode(text)) + 2 n, row_number() over (partition by doc_id // {WIDTH} order by doc_id) r from documents),
walk as (select shard, r, doc_id, n, 0::bigint block, 0::bigint used from d where r = 1
  union all select d.shard, d.r, d.doc_id, d.n,
    case when e % {BLOCK} > 0 and d.n > {BLOCK} - e % {BLOCK}
      and least({BLOCK} - e % {BLOCK}, d.n - ({BLOCK} - e % {BLOCK})) < {THRESHOLD} then e // {BLOCK} + 1 else e // {BLOCK} end,
    case when e % {BLOCK} > 0 and d.n > {BLOCK} - e % {BLOCK}
      and least({BLOCK} - e % {BLOCK}, d.n - ({BLOCK} - e % {BLOCK})) < {THRESHOLD} then 0 else e % {BLOCK} end
  from (select shard, r, block * {BLOCK} + used + n e from walk) w join d on d.shard = w.shard and d.r = w.r + 1),
parts as (select shard, doc_id, n, block * {BLOCK} + used s, unnest(range(block, (block * {BLOCK} + used + n - 1) // {BLOCK} + 1)) b
  from walk),
shard_fragments as (select shard, doc_id, b block_no, greatest(s, b * {BLOCK})::bigint - b * {BLOCK} as "at",
  greatest(s, b * {BLOCK})::bigint - s as start,
  (least(s + n, (b + 1) * {BLOCK}) - greatest(s, b * {BLOCK}))::bigint length from parts)"""


@query("fit_or_cut_blocks", "PCK-2", f"with recursive {SHARD_WALK} select * from shard_fragments")
def fit_or_cut_blocks(t):
    plan = pk.fit_or_cut(t.documents, tk.wrapped_length("text"), BLOCK, THRESHOLD, WIDTH)
    return plan.select("shard", "doc_id", "block_no", long("at"), long("start"), long("length"))


WALK = f"""d as (select doc_id, octet_length(encode(text)) + 2 n, row_number() over (order by doc_id) r from documents),
walk as (select r, doc_id, n, 0::bigint block, 0::bigint used from d where r = 1
  union all select d.r, d.doc_id, d.n,
    case when e % {BLOCK} > 0 and d.n > {BLOCK} - e % {BLOCK}
      and least({BLOCK} - e % {BLOCK}, d.n - ({BLOCK} - e % {BLOCK})) < {THRESHOLD} then e // {BLOCK} + 1 else e // {BLOCK} end,
    case when e % {BLOCK} > 0 and d.n > {BLOCK} - e % {BLOCK}
      and least({BLOCK} - e % {BLOCK}, d.n - ({BLOCK} - e % {BLOCK})) < {THRESHOLD} then 0 else e % {BLOCK} end
  from (select r, block * {BLOCK} + used + n e from walk) w join d on d.r = w.r + 1),
fragments as (select doc_id, b block_no, greatest(s, b * {BLOCK})::bigint - b * {BLOCK} as "at",
  greatest(s, b * {BLOCK})::bigint - s as start, (least(s + n, (b + 1) * {BLOCK}) - greatest(s, b * {BLOCK}))::bigint length
  from (select doc_id, n, block * {BLOCK} + used s,
    unnest(range(block, (block * {BLOCK} + used + n - 1) // {BLOCK} + 1)) b from walk))"""


@query("fit_or_cut_corpus", "PCK-2", f"""with recursive {WALK} select doc_id, block_no, "at", start, length from fragments""")
def fit_or_cut_corpus(t):
    """One sequence over the whole corpus: no block restarts at a shard."""
    return pp.fit_or_cut_all(t.documents, tk.wrapped_length("text"), BLOCK, THRESHOLD)


END_TOKEN = tk.SPECIAL_IDS["<|endoftext|>"]


def block_summary_sql(fragments: str, keys: str) -> str:
    """Token summary of padded blocks whose ``fragments`` are the columns of a query."""
    return f"""placed as (select {keys}, "at" + p - start as g, token from ({WRAPPED}) w join {fragments} f
  on w.doc_id = f.doc_id and w.p >= f.start and w.p < f.start + f.length),
pads as (select {keys}, unnest(range(max(g) + 1, {BLOCK})) g, {END_TOKEN} token from placed group by {keys}),
filled as (select {keys}, g, token from placed union all select {keys}, g, token from pads)
select {keys}, count(*) n, sum(token)::bigint total, sum(token * (g % 997 + 1))::bigint weighted from filled group by {keys}"""


@query("fit_or_cut_corpus_tokens", "PCK-2 PCK-3", f"""with recursive {WALK}, {block_summary_sql("fragments", "block_no")}""")
def fit_or_cut_corpus_tokens(t):
    docs = t.documents.select("doc_id", tk.wrap(tk.byte_tokens("text")).alias("tokens"), tk.wrapped_length("text").alias("n"))
    placed = pp.fit_or_cut_all(docs, F.col("n"), BLOCK, THRESHOLD)
    return token_summary(pp.whole_blocks(docs, placed, "tokens", BLOCK, END_TOKEN), "tokens", "block_no")


@query("fit_or_cut_tokens", "PCK-2 PCK-3", f"""with recursive {SHARD_WALK}, {block_summary_sql("shard_fragments", "shard, block_no")}""")
def fit_or_cut_tokens(t):
    docs = t.documents.select("doc_id", tk.wrap(tk.byte_tokens("text")).alias("tokens"), tk.wrapped_length("text").alias("n"))
    plan = pk.fit_or_cut(docs, F.col("n"), BLOCK, THRESHOLD, WIDTH)
    blocks = pk.cut_fragments(docs, plan, "tokens", BLOCK, tk.SPECIAL_IDS["<|endoftext|>"])
    return token_summary(blocks, "tokens", "shard", "block_no")


@query("shard_assignment", "SNK-2", f"""with {PLACED}, b as (select unnest(range(0, max(at_token + n - 1) // {BLOCK} + 1)) block_id
  from placed)
select block_id, case when block_id < 4 then 'val' else 'train' end split,
  case when block_id < 4 then 'val_000000' else 'train_' || lpad(((block_id - 4) // 100 + 1)::varchar, 6, '0') end shard
from b""")
def shard_assignment(t):
    docs = t.documents.select("doc_id", "text", tk.wrapped_length("text").alias("n"))
    return pk.assign_shards(pk.pack_flat(docs, tk.wrap(tk.byte_tokens("text")), F.col("n"), BLOCK), 100, 4).select("block_id", "split", "shard")


SUM_TEXT = """'[' || (l_partkey % 100)::varchar || '] + [' || (l_suppkey % 100)::varchar || '] = ['
  || ((l_partkey % 100) + (l_suppkey % 100))::varchar || ']'"""


def sum_rows(t):
    a, b = F.col("l_partkey") % 100, F.col("l_suppkey") % 100
    text = F.concat(
        F.lit("["), a.cast("string"), F.lit("] + ["), b.cast("string"), F.lit("] = ["), (a + b).cast("string"), F.lit("]")
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("line")).withColumn(
        "tokens", tk.byte_tokens("line")
    )


SUM_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
SUM_LIST = SUM_KEYS.split(", ")


@query("padded_rows", "PCK-3", f"""select {SUM_KEYS}, length(s)::bigint n_real, 32::bigint n,
  (32 - length(s))::bigint n_pad from (select {SUM_KEYS}, {SUM_TEXT} s from lineitem)""")
def padded_rows(t):
    padded = sum_rows(t).withColumn("row", tk.pad(F.col("tokens"), 32))
    pads = F.size(F.filter("row", lambda x: x == tk.SPECIAL_IDS["<|endoftext|>"]))
    return padded.select(
        *SUM_LIST, F.size("tokens").cast("long").alias("n_real"), F.size("row").cast("long").alias("n"),
        pads.cast("long").alias("n_pad"),
    )


@query("context_masks", "MSK-1", f"""select {SUM_KEYS}, array_to_string(list_transform(range(0, 32), lambda i:
  case when i < position('=' in s) or i >= length(s) then '1' else '0' end), '') mask
from (select {SUM_KEYS}, {SUM_TEXT} s from lineitem)""")
def context_masks(t):
    rows = sum_rows(t).withColumn("row", tk.pad(F.col("tokens"), 32))
    mask = tk.context_mask(F.col("row"), F.size("tokens"))
    return rows.select(*SUM_LIST, F.array_join(F.transform(mask, lambda x: x.cast("string")), "").alias("mask"))


@query("held_out_lengths", "HLD-1", """select l_orderkey, n::bigint eval_length, i::bigint example from (
  select distinct l_orderkey, unnest([40 + l_orderkey % 3, 33, 48, 40]) n from lineitem), range(3) r(i)""")
def held_out_lengths(t):
    csv = F.concat(F.lit("48,"), (F.col("l_orderkey") % 3 + 40).cast("string"), F.lit(",33, 40"))
    lengths = pk.held_out_lengths(csv, F.lit(32))
    return (
        t.lineitem.select("l_orderkey").distinct()
        .select("l_orderkey", F.explode(lengths).alias("n"))
        .select("l_orderkey", long("n", "eval_length"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
        .select("l_orderkey", "eval_length", long("i", "example"))
    )


@query("document_positions", "SRC-3", "select doc_id, row_number() over (order by doc_id) - 1 pos from documents")
def document_positions(t):
    return positions(t.documents.select("doc_id"), "doc_id", "pos")
