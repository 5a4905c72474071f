"""SQL fragments shared by the oracles (DuckDB dialect)."""

from __future__ import annotations

from evalloom.functions.text import EDGE_SPACE, PUNCTUATION, SPACE, WORD


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE_SPACE}', '', 'g')"


def drop_punctuation(x: str) -> str:
    return f"regexp_replace({x}, '{PUNCTUATION}', '', 'g')"


def normal_words(x: str) -> str:
    return words(drop_punctuation(f"lower({x})"))


def squeeze(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def ngram_rows(table: str, source: str, keys: str, tokens: str, n: int) -> str:
    """CTEs ending in ``table(keys, pos, ngram)``: tokens as rows, joined to their followers by ``lead``."""
    run = " || ' ' || ".join(["token"] + [f"lead(token, {k}) over w" for k in range(1, n)])
    return f"""{table}_tokens as (select {keys}, unnest(w) token, unnest(range(0, len(w))) pos
  from (select {keys}, {tokens} w from {source})),
{table} as (select * from (select {keys}, pos, {run} ngram from {table}_tokens
  window w as (partition by {keys} order by pos)) where ngram is not null)"""


def stable_hash(*parts: str) -> str:
    joined = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"('0x' || substr(md5({joined}), 1, 15))::bigint"


def articles_gone(x: str, articles: str = "a|an|the") -> str:
    """Unicode-aware ``\\b(...)\\b`` -> space; twice, because neighbours share a delimiter."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    rule = f"'(\\A|{edge})({articles})({edge}|\\z)', '\\1 \\3', 'g'"
    return f"regexp_replace(regexp_replace({x}, {rule}), {rule})"


def qa_normal(x: str) -> str:
    return squeeze(articles_gone(drop_punctuation(f"lower({x})")))


def overlap(a: str, b: str) -> str:
    """Size of the multiset intersection of two lists."""
    return (
        f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda t: "
        f"least(len(list_filter({a}, lambda u: u = t)), len(list_filter({b}, lambda u: u = t))))), 0)"
    )


SPACE_CLASS = SPACE
