"""Substring dedup: word runs that a document shares with one of smaller id, found by FM-indexes over shards of the corpus.

Every window of ``WINDOW`` words has an anchor, the smallest hash among its ``SHINGLE``-word runs, so equal windows have equal anchors.
Consecutive windows of one anchor make a segment of at most ``2 * WINDOW - SHINGLE`` words. Segments whose anchor occurs in more
than one document go to the shard of their anchor, equal segments as one row with the smallest and largest id of their documents.
A shard builds a compressed FM-index of its segments and streams them through backward search; the suffix interval of a window that
matches over all its words gives the smallest id of a document that holds it. Documents take these intervals back by
segment and lose the words that they cover.

Repeated anchors travel as a bitmap sized for their number, up to a bound; a false bit only sends more segments to the shards, where words are compared.
A second one tells which documents lose words, so that only their texts are shuffled for the removal. Anchors of very many
documents are split: their segments become single windows, which go by the hash of the window.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.wordhash import Words, mixed, pieces, run_hashes, words_of
from evalloom.llm.common import column, table, text_key
from evalloom.llm.fm_index import FMIndex
from evalloom.session import cut_lineage

WINDOW = 13
SHINGLE = 5
BITS = 30  # of the bitmap of repeated anchors at most: 128 MB
BITS_PER_ANCHOR = 64  # that it is sized for
COUNTED_BITS = 40  # of an anchor that are counted; those of the bitmap are the lowest of them
DOCUMENT_BITS = 26  # of the bitmap of documents that lose words: 8 MB
SLICE_BITS = 18  # of one row of it
HOT_BITS = 22  # of the bitmap of hot anchors
HOT = 4096  # occurrences from which the segments of an anchor are split into windows
SHARD_ANCHORS = 4000  # repeated anchors of a shard, on average
LAST = 2**63 - 1  # stands for a null id: after all others


def anchored_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with the same anchor place: first window, last window, anchor."""
    value, _ = run_hashes(words, SHINGLE)
    count = len(words.hash) - WINDOW + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    place = np.zeros(count, dtype=np.int64)
    least = value[:count].copy()
    for k in range(1, WINDOW - SHINGLE + 1):
        other = value[k : k + count]
        lower = other < least
        place[lower] = k
        least = np.where(lower, other, least)
    window = np.flatnonzero(words.doc[:count] == words.doc[WINDOW - 1 :])
    at = window + place[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1) | (words.doc[window[1:]] != words.doc[window[:-1]])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(window))[: len(start)] - 1
    return window[start], window[stop], value[at[start]]


def anchor_counts(docs: DataFrame) -> DataFrame:
    """``anchor, low, high, n`` per anchor: smallest and largest id of its documents, and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, piece in pieces(batch.column(2)):
                words = words_of(piece)
                first, _, anchor = anchored_runs(words)
                if not len(first):
                    continue
                owner = ids[low + words.doc[first]]
                anchor = anchor & np.uint64((1 << COUNTED_BITS) - 1)
                order = np.argsort(anchor, kind="stable")
                anchor, owner = anchor[order], owner[order]
                start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[start].view(np.int64)), pa.array(np.minimum.reduceat(owner, start)),
                     pa.array(np.maximum.reduceat(owner, start)), pa.array(np.diff(np.append(start, len(anchor))))],
                    ["anchor", "low", "high", "n"],
                )

    found = docs.mapInArrow(run, "anchor long, low long, high long, n long")
    return found.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def collect_bitmaps(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Two bitmaps of ``2 ** bits`` bits: of every ``bit`` in ``rows``, and of those with ``hot``; and the number of rows.

    The driver receives the bitmaps, which have this size whatever the data; the bits are set in tasks, by slice.
    """
    slice_bits = min(SLICE_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[tuple[int, bool], np.ndarray] = {}
        n = 0
        for batch in batches:
            bit, is_hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n += len(bit)
            for flag in (False, True):
                mine = bit if not flag else bit[is_hot.astype(bool)]
                part = mine >> slice_bits
                for key in np.unique(part).tolist():
                    row = slices.setdefault((key, flag), np.zeros(1 << (slice_bits - 3), dtype=np.uint8))
                    inside = mine[part == key] & ((1 << slice_bits) - 1)
                    np.bitwise_or.at(row, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        for i, ((key, flag), row) in enumerate(slices.items()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([flag]), pa.array([row.tobytes()], pa.binary()),
                 pa.array([n if i == 0 else 0], pa.int64())],
                ["slice", "hot", "bits", "n"],
            )

    by_slice = rows.select("bit", "hot").repartition(F.shiftright("bit", slice_bits))
    maps = np.zeros((2, 1 << (bits - 3)), dtype=np.uint8)
    total = 0
    for row in by_slice.mapInArrow(run, "slice long, hot boolean, bits binary, n long").toLocalIterator():
        begin = row["slice"] << (slice_bits - 3)
        maps[int(row["hot"]), begin : begin + (1 << (slice_bits - 3))] |= np.frombuffer(row["bits"], np.uint8)
        total += row["n"]
    return maps[0], maps[1], total


def anchor_bitmaps(anchors: DataFrame, bits: int, hot: int) -> tuple[bytes, bytes, int, int]:
    """Deflated bitmaps of the anchors in several documents, and of the hot ones; the number of the former, and the bits of their map.

    There are few hot anchors, so their bitmap is folded to ``HOT_BITS``.
    """
    repeated = cut_lineage(anchors.where("low < high").select("anchor", "n"))  # counted, then marked
    bits = min(bits, max(HOT_BITS, (BITS_PER_ANCHOR * repeated.count()).bit_length()))
    bit = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    every, some, total = collect_bitmaps(repeated.select(bit.alias("bit"), (F.col("n") > hot).alias("hot")), bits)
    folded = np.bitwise_or.reduce(some.reshape(-1, 1 << (min(HOT_BITS, bits) - 3)), axis=0)
    return zlib.compress(every.tobytes(), 1), zlib.compress(folded.tobytes(), 1), total, bits


def document_bit(bits: int):
    """Place of a document in a bitmap, from its id and text key."""
    return F.xxhash64("did", "text_key").bitwiseAND(F.lit((1 << bits) - 1))


def bit_of(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (anchor & np.uint64((1 << bits) - 1)).astype(np.int64)


def has_bit(bitmap: np.ndarray, value: np.ndarray, bits: int) -> np.ndarray:
    at = bit_of(value, bits)
    return (bitmap[at >> 3] >> (at & 7)) & 1 > 0


def repeated_segments(docs: DataFrame, shared, bits: int) -> DataFrame:
    """Segments of the documents that may repeat: ``did, text_key, pos, anchor, segment``; hot ones window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = (np.frombuffer(zlib.decompress(m), np.uint8) for m in shared.value)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for low, piece in pieces(batch.column(2)):
                words = words_of(piece)
                first, last, anchor = anchored_runs(words)
                kept = has_bit(repeated, anchor, bits)
                first, last, anchor = first[kept], last[kept], anchor[kept]
                if not len(first):
                    continue
                split = has_bit(hot, anchor, min(HOT_BITS, bits))
                if split.any():
                    width = (last - first + 1)[split]
                    offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                    single = np.repeat(first[split], width) + offset
                    whole, _ = run_hashes(words, WINDOW)
                    first = np.concatenate([first[~split], single])
                    last = np.concatenate([last[~split], single])
                    anchor = np.concatenate([anchor[~split], mixed(whole[single])])
                # the words of the piece with one space between them, and where each begins
                size = words.end - words.start
                begin = np.cumsum(size + 1) - (size + 1)
                flat = np.full(int(begin[-1] + size[-1]) + 1, 32, dtype=np.uint8)
                inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                flat[np.repeat(begin, size) + inner] = words.data[np.repeat(words.start, size) + inner]
                joined = flat.tobytes()
                end = last + WINDOW - 1
                a, b = begin[first], begin[end] + size[end]
                doc = words.doc[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low + doc]), pa.array(keys[low + doc]), pa.array((first - words.first[doc]).astype(np.int32)),
                     pa.array(anchor.view(np.int64)),
                     pa.array([joined[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())],
                    ["did", "text_key", "pos", "anchor", "segment"],
                )

    return docs.mapInArrow(run, "did long, text_key long, pos int, anchor long, segment binary")


def window_lows(segments: list[bytes], lows: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Per segment, for each of its windows, the smallest of ``lows`` over all segments that hold the window."""
    ids: dict[bytes, int] = {}
    coded = [[ids.setdefault(w, len(ids) + 1) for w in s.split(b" ")] for s in segments]
    sizes = np.array([len(c) for c in coded])
    text = np.zeros(int(sizes.sum() + len(sizes)), dtype=np.int64)
    start = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.repeat(start, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[place] = np.fromiter((x for c in coded for x in c), np.int64, int(sizes.sum()))
    index = FMIndex(text, len(ids) + 1)
    count = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    matched, low, high = index.matches(text, start[owner] + offset + window - 1, window, indexed=True)
    smallest = lows[owner].copy()
    full = np.flatnonzero((matched == window) & (high - low > 1))
    if len(full):
        held = np.append(lows[index.owner], LAST)
        begin, where = np.unique(low[full], return_index=True)
        # intervals of matches of one length are equal or apart
        edges = np.stack([begin, high[full][where]], axis=1).ravel()
        least = np.minimum.reduceat(held, edges)[::2]
        smallest[full] = least[np.searchsorted(begin, low[full])]
    return np.split(smallest, np.cumsum(count)[:-1])


def shard_lows(distinct: DataFrame, shards: int) -> DataFrame:
    """``segment, lows``: the smallest ids per window, for segments where that helps some document."""

    def run(shard: pa.Table) -> pa.Table:
        segments = shard["segment"].to_pylist()
        lows, highs = shard["low"].to_numpy(), shard["high"].to_numpy()
        found = window_lows(segments, lows)
        useful = [i for i, f in enumerate(found) if f.min(initial=LAST) < highs[i]]
        return pa.table(
            {
                "segment": pa.array([segments[i] for i in useful], pa.binary()),
                "lows": pa.array([found[i].tolist() for i in useful], pa.list_(pa.int64())),
            }
        )

    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(run, "segment binary, lows array<long>")


def covered_windows(docs: DataFrame, bits: int = BITS, hot: int = HOT, shard_anchors: int = SHARD_ANCHORS) -> DataFrame | None:
    """``did, text_key, starts``: the first words of the windows that a document of smaller id holds too; None without any."""
    repeated, hots, total, bits = anchor_bitmaps(anchor_counts(docs), bits, hot)
    if not total:
        return None
    shared = docs.sparkSession.sparkContext.broadcast((repeated, hots))
    segments = repeated_segments(docs, shared, bits)
    distinct = segments.groupBy("anchor", "segment").agg(F.min("did").alias("low"), F.max("did").alias("high"))
    found = shard_lows(distinct, max(1, -(-total // shard_anchors)))
    pair = [F.xxhash64("segment").alias("h1"), F.xxhash64(F.lit("second"), F.col("segment")).alias("h2")]
    lows = found.select(*pair, "lows")
    places = segments.select("did", "text_key", "pos", *pair)
    starts = F.filter(
        F.transform("lows", lambda low, i: F.when(low < F.col("did"), F.col("pos") + i)), lambda p: p.isNotNull()
    )
    hits = places.join(lows, ["h1", "h2"]).select("did", "text_key", starts.alias("starts")).where(F.size("starts") > 0)
    return cut_lineage(hits.groupBy("did", "text_key").agg(F.flatten(F.collect_set("starts")).alias("starts")))


def removed_words(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    change = np.zeros(n_words + window + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n_words] > 0


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row, and ``kept`` (the words that stay, joined by one space) if asked for.

    A word goes if a window of ``WINDOW`` words that covers it also starts in a document of smaller id; all windows are judged on the
    input. Null ids come after all others and are not smaller than one another. Rows of one id are one document in that
    order: they never remove from each other, and repeated rows are treated alike. Null and empty texts have no word; documents
    shorter than a window lose nothing. Only the two named columns are read.
    """
    rows = docs.select(
        F.coalesce(column(doc_id).cast("long"), F.lit(LAST)).alias("did"), text_key(column(text)).alias("text_key"),
        column(text).alias("text"), column(doc_id).cast("long").alias("doc_id"),
    )
    covered = covered_windows(rows.select("did", "text_key", "text"), **options)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names) - 1]

    def result(words: list[bytes], starts: np.ndarray) -> list:
        n, gone = len(words), 0
        if len(starts) and n:
            removed = removed_words(n, starts)
            gone = int(removed.sum())
            words = [w for w, r in zip(words, removed.tolist()) if not r]
        kept = b" ".join(words)
        return [n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")][: len(types)]

    shared = None
    if covered is not None:
        bit = document_bit(DOCUMENT_BITS)
        marked = collect_bitmaps(covered.select(bit.alias("bit"), F.lit(False).alias("hot")), DOCUMENT_BITS)[0]
        shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(marked.tobytes(), 1))
        rows = rows.withColumn("bit", bit)
    else:
        rows = rows.withColumn("bit", F.lit(0).cast("long"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The results of documents that lose nothing; the texts of the others, compressed for the shuffle."""
        squeeze = zstandard.ZstdCompressor(level=5)
        marks = np.frombuffer(zlib.decompress(shared.value), np.uint8) if shared else np.zeros(1, np.uint8)
        for batch in batches:
            bit = batch.column(4).to_numpy(zero_copy_only=False)
            marked = (marks[bit >> 3] >> (bit & 7)) & 1 > 0
            packed, done = [], [[] for _ in types]
            for text, mark in zip(batch.column(2).to_pylist(), marked.tolist()):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                packed.append(squeeze.compress(data) if mark else None)
                for column, value in zip(done, [None] * len(types) if mark else result(data.split(), np.empty(0, np.int64))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), batch.column(3),
                 *[pa.array(c, t) for c, t in zip(done, types)]],
                ["did", "text_key", "packed", *names],
            )

    passed = rows.mapInArrow(first_pass, "did long, text_key long, packed binary, " + schema)
    if covered is None:
        return passed.select(*names)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[3:]]
            for i, (packed, starts) in enumerate(zip(batch.column(1), batch.column(2))):
                if packed.is_valid:
                    at = starts.values.to_numpy(zero_copy_only=False).astype(np.int64) if starts.is_valid else np.empty(0, np.int64)
                    for column, value in zip(columns, result(unpack.decompress(packed.as_py()).split(), at)):
                        column[i] = value
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    joined = passed.join(covered, ["did", "text_key"], "left")
    return joined.select("doc_id", "packed", "starts", *names[1:]).mapInArrow(second_pass, schema)


SQL = r"""
WITH listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 12, 0))) AS i FROM listed)),
lows AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY g),
hits AS (SELECT doc_id, i FROM windows JOIN lows USING (g) WHERE low < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hits),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM listed),
kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(c.i) AS n_removed,
         coalesce(string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY w.i), '') AS kept
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.i = c.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def op10_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents"))
