"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash containment.

An item is contained in a document when at least ``threshold`` of its distinct shingles occur there. Items are partitioned by the
size of their shingle set. From each item the ``k`` smallest shingle hashes are kept (a bottom-k MinHash sketch of the item), with
``k`` set for the largest size of the partition so that a document that misses all of them misses more than ``1 - threshold`` of the
item: the search loses no contained item however long the document. A document is looked up only in partitions whose items it is
long enough to contain. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.bloom import bloom_of
from evalloom.functions.wordhash import pieces, run_hashes, words_of
from evalloom.llm.common import column, matched_rows, table, text_key
from evalloom.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_BYTES = 16 << 20  # of item texts that may go to every task
FILTER_BITS = 22
RESULT = "doc_id long, text_key long, item_id long, item_shingles long, found_shingles long"

# ASCII punctuation separates words
NEUTRAL = np.arange(256, dtype=np.uint8)
NEUTRAL[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
NEUTRAL_BYTES = NEUTRAL.tobytes()


def shingles(text: bytes, n: int = SHINGLE) -> list[bytes]:
    words = text.translate(NEUTRAL_BYTES).split()
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def needed(size: int, threshold: float) -> int:
    """Smallest number of shingles that is at least ``threshold`` of ``size``."""
    return math.ceil(round(threshold * size, 9))


def sketch_length(size: int, threshold: float) -> int:
    """Hashes kept of an item of ``size`` shingles: enough for the largest item of its partition (sizes up to a power of 2)."""
    largest = (1 << size.bit_length()) - 1
    return min(size, max(n - needed(n, threshold) + 1 for n in range(size, largest + 1)))


def sketches(hashes: np.ndarray, threshold: float) -> tuple[np.ndarray, int, int]:
    """Bottom-k hashes of one item, its number of shingles, and the fewest positions of a document that can contain it."""
    distinct = np.unique(hashes)
    return distinct[: sketch_length(len(distinct), threshold)], len(distinct), needed(len(distinct), threshold)


def item_hashes(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and shingle hashes of the rows that have ``n`` words."""
    for low, piece in pieces(texts):
        words = words_of(piece, NEUTRAL)
        value, inside = run_hashes(words, n)
        doc = words.doc[: len(value)][inside]
        value = value[inside]
        cut = np.searchsorted(doc, np.arange(len(piece) + 1))
        for row in np.flatnonzero(np.diff(cut)):
            yield low + int(row), value[cut[row] : cut[row + 1]]


def pair_rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_key", "item_id", "item_shingles", "found_shingles"]
    )


def short_hashes(texts: pa.Array, n: int) -> Iterator[tuple[int, int, int]]:
    """Row, words and hash of the rows of one to ``n - 1`` words, whose only shingle is the whole text."""
    for low, piece in pieces(texts):
        words = words_of(piece, NEUTRAL)
        count = np.diff(words.first)
        for m in np.unique(count[(count > 0) & (count < n)]).tolist():
            value, _ = run_hashes(words, m)
            for row in np.flatnonzero(count == m).tolist():
                yield low + row, m, int(value[words.first[row]])


def own_shingles(text: bytes, n: int) -> tuple[frozenset, int]:
    """Shingles of an item and their words: ``n``, or all words of a shorter item."""
    m = max(1, min(n, len(text.translate(NEUTRAL_BYTES).split())))
    return frozenset(shingles(text, m)), m


def contained_small(docs: DataFrame, items: list[tuple[int | None, str]], n: int, threshold: float) -> DataFrame:
    """One pass over the documents with the items in every task; nothing is shuffled."""
    texts = pa.array([t.encode("utf-8", "surrogatepass") for _, t in items], pa.large_binary())
    ids, sets, sizes, least = [], [], [], []
    found: dict[int, list[tuple[np.ndarray, int]]] = {}  # by words of a shingle: hashes and number of the item

    def add(row: int, m: int, hashes: np.ndarray, need: int) -> None:
        found.setdefault(m, []).append((hashes, len(ids)))
        ids.append(items[row][0])
        sets.append(frozenset(shingles(texts[row].as_py(), m)))
        sizes.append(m)
        least.append(need)

    for row, hashes in item_hashes(texts, n):
        kept, _, need = sketches(hashes, threshold)
        add(row, n, kept, need)
    for row, m, value in short_hashes(texts, n):
        add(row, m, np.array([value], dtype=np.uint64), 0)
    index = {}
    for m, parts in found.items():
        flat = np.concatenate([h for h, _ in parts])
        order = np.argsort(flat, kind="stable")
        index[m] = flat[order], np.repeat([i for _, i in parts], [len(h) for h, _ in parts])[order]
    shared = docs.sparkSession.sparkContext.broadcast((index, np.array(least), ids, sets, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, least, ids, sets, sizes = shared.value
        mask = np.uint64((1 << FILTER_BITS) - 1)
        filters = {}
        for m, (keys, _) in index.items():
            filters[m] = np.zeros(1 << FILTER_BITS, dtype=bool)
            filters[m][keys & mask] = True

        def candidates(words, m: int) -> np.ndarray:
            """Row and item, as one number, of every shared hash; documents too short for the item are left out."""
            keys, owner = index[m]
            value, inside = run_hashes(words, m)
            at = np.flatnonzero(filters[m][value & mask] & inside)
            left, right = (np.searchsorted(keys, value[at], side) for side in ("left", "right"))
            hits = right - left
            rows = np.repeat(words.doc[at], hits)
            offset = np.arange(len(rows)) - np.repeat(np.cumsum(hits) - hits, hits)
            item = owner[np.repeat(left, hits) + offset]
            fits = (np.diff(words.first) - (n - 1))[rows] >= least[item] if m == n and len(rows) else np.ones(len(rows), bool)
            return np.unique(rows[fits].astype(np.int64) * len(ids) + item[fits])

        for batch in batches:
            out = []
            for low, piece in pieces(batch.column(2)):
                words = words_of(piece, NEUTRAL)
                for m in index:
                    shown, grams = -1, frozenset()
                    for pair in candidates(words, m).tolist():
                        row, item = divmod(pair, len(ids))
                        if row != shown:
                            shown, grams = row, frozenset(shingles(piece[row].as_py(), sizes[item]))
                        size, both = len(sets[item]), len(sets[item] & grams)
                        if both >= needed(size, threshold):
                            out.append(
                                (batch.column(0)[low + row].as_py(), batch.column(1)[low + row].as_py(), ids[item], size, both)
                            )
            yield pair_rows(out)

    return docs.mapInArrow(run, RESULT)


def contained_large(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """The same pairs when the items do not fit a broadcast: sketches and document shingles meet in a join on the hash.

    A Bloom filter of the sketches goes to every task first, so only shingles that an item may have are shuffled.
    """

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [(row, n, *sketches(hashes, threshold)[::2]) for row, hashes in item_hashes(batch.column(2), n)]
            listed += [(row, m, np.array([value], dtype=np.uint64), 0) for row, m, value in short_hashes(batch.column(2), n)]
            for row, m, kept, need in listed:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(kept), pa.int64()),
                        pa.array([batch.column(1)[row].as_py()] * len(kept), pa.int64()),
                        pa.array([need] * len(kept), pa.int64()),
                        pa.array([m] * len(kept), pa.int32()),
                        pa.array(kept.view(np.int64)),
                    ],
                    ["item_id", "item_key", "least", "m", "h"],
                )

    keyed = items.select("item_id", text_key("text").alias("item_key"), "text").where("text is not null")
    sketch = cut_lineage(keyed.mapInArrow(item_rows, "item_id long, item_key long, least long, m int, h long").distinct())
    lengths = sorted(r["m"] for r in sketch.select("m").distinct().collect())  # n at most
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(sketch, "h", sketch.count()))

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low, piece in pieces(batch.column(2)):
                words = words_of(piece, NEUTRAL)
                length = np.maximum(np.diff(words.first) - (n - 1), 0)
                for m in lengths:
                    value, inside = run_hashes(words, m)
                    at = np.flatnonzero(inside)
                    at = at[known.has(value[at])]
                    order = np.lexsort([value[at], words.doc[at]])
                    at = at[order]
                    new = np.ones(len(at), dtype=bool)
                    new[1:] = (value[at[1:]] != value[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])
                    at = at[new]
                    rows = pa.array(low + words.doc[at])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(length[words.doc[at]].astype(np.int64)),
                         pa.array(np.full(len(at), m, np.int32)), pa.array(value[at].view(np.int64))],
                        ["doc_id", "text_key", "length", "m", "h"],
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, shown, grams = [], None, frozenset()
            for doc, key, text, item, other in zip(*[c.to_pylist() for c in batch.columns]):
                wanted, m = own_shingles(other.encode("utf-8", "surrogatepass"), n)
                if shown != (doc, key, m):
                    shown, grams = (doc, key, m), frozenset(shingles(text.encode("utf-8", "surrogatepass"), m))
                both = len(wanted & grams)
                if both >= needed(len(wanted), threshold):
                    found.append((doc, key, item, len(wanted), both))
            yield pair_rows(found)

    grams = docs.mapInArrow(doc_rows, "doc_id long, text_key long, length long, m int, h long").distinct()
    pairs = cut_lineage(
        grams.join(sketch, ["m", "h"]).where("length >= least").select("doc_id", "text_key", "item_id", "item_key").distinct()
    )
    renamed = pairs.toDF("_doc", "_doc_key", "_item", "_item_key")
    bodies = docs.join(renamed, docs["doc_id"].eqNullSafe(F.col("_doc")) & (docs["text_key"] == F.col("_doc_key")))
    both = bodies.join(
        keyed.withColumnRenamed("text", "other"),
        keyed["item_id"].eqNullSafe(F.col("_item")) & (keyed["item_key"] == F.col("_item_key")),
    )
    return both.select("doc_id", "text_key", "text", "item_id", "other").mapInArrow(verify, RESULT)


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD,
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Items contained in documents: ``doc_id, text_key, item_id, item_shingles, found_shingles, containment``.

    Words are lower-cased runs between white space and ASCII punctuation; a shingle is ``n`` words. An item of fewer words has one, all of
    them, and is contained where these words stand in a row; items and documents without words give no row. There is one row per document row and item row, so repeated rows
    repeat; ids may be null. Only the named columns are read, so other columns may have any name. The items go to every task
    after their bytes were counted; beyond ``broadcast_bytes`` the same pairs come from joins.
    """
    bodies = docs.select(
        column(doc_id).cast("long").alias("doc_id"), text_key(column(text)).alias("text_key"), F.lower(column(text)).alias("text")
    )
    tests = items.select(column(item_id).cast("long").alias("item_id"), F.lower(column(item_text)).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        listed = [(r["item_id"], r["text"]) for r in tests.where("text is not null").collect()]
        found = contained_small(bodies, listed, n, threshold)
    else:
        found = contained_large(bodies, tests, n, threshold)
    return found.withColumn("containment", F.col("found_shingles") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns are kept, whatever their names.

    Rows of one id and text go or stay together; null and empty texts, and all rows if there are no items, stay.
    """
    return matched_rows(docs, contained_items(docs, items, doc_id, text, **options), doc_id, text, "left_anti")


SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\x20\x09-\x0D]+'),
                             lambda w: w <> '') AS w FROM documents),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\x20\x09-\x0D]+'),
                              lambda w: w <> '') AS w FROM benchmark),
doc_grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM doc_words)),
item_grams AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM item_words)),
sizes AS (SELECT item_id, count(*) AS item_shingles FROM item_grams GROUP BY item_id),
found AS (
  SELECT d.doc_id, i.item_id, count(*) AS found_shingles
  FROM doc_grams d JOIN item_grams i ON d.g = i.g GROUP BY d.doc_id, i.item_id)
SELECT doc_id, item_id, item_shingles, found_shingles, found_shingles / item_shingles AS containment
FROM found JOIN sizes USING (item_id) WHERE found_shingles >= ceil(round(0.8 * item_shingles, 9))
UNION ALL
SELECT doc_id, item_id, 1, 1, 1.0
FROM doc_words d JOIN item_words i ON len(i.w) BETWEEN 1 AND 4
  AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')
"""


def op9_decontaminate(spark, sf_dir):
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")
