"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints are 64-bit majorities over shingle hashes. A fingerprint is cut into three segments of at most 23 bits. The
(23,12) Golay code is perfect with radius 3: a segment lies within distance 4 of one codeword or of six, and two segments that
differ in at most two bits share one of those codewords. Two fingerprints that differ in at most four bits either agree in one
whole segment and differ in at most two bits in another (keys: segment and codeword), or differ in all three, each by one or two
bits (keys: the codewords of the first two and one third of the last, of which one is equal). So equal keys miss no link;
candidates are verified by their exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import column, matched_rows, table, text_key
from evalloom.llm.components import components, local_forest
from evalloom.session import cut_lineage

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
LAST_PARTS = ((0, 7), (7, 7), (14, 7))  # of the last segment
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
RUN = 4096  # fingerprints of one key compared in one piece; longer runs are compared block by block

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the text's shingles, as a signed number; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1:])]
    return majority(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, fp`` for every row, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), text_key(column(text)).alias("text_key"), column(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: up to six error patterns that lead to a codeword within distance 4, and their number. By bit: syndromes."""
    bits = []
    rest = 1
    for _ in range(23):
        bits.append(rest)
        rest <<= 1
        if rest >> 11:
            rest ^= GENERATOR
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = 0
            for p in places:
                syndrome ^= bits[p]
            if weight < 4 or (found[syndrome] and found[syndrome][0].bit_count() == 3):
                found[syndrome].append(sum(1 << p for p in places))
    patterns = np.zeros((2048, 6), dtype=np.int64)
    for s, errors in enumerate(found):
        patterns[s, : len(errors)] = errors
    return patterns, np.array([len(e) for e in found]), np.array(bits, dtype=np.int64)


def codeword_indices(values: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Six candidate 12-bit codeword indices per 23-bit value, and which of them count."""
    patterns, counts, bits = tables
    syndrome = np.zeros(len(values), dtype=np.int64)
    for p in range(23):
        syndrome ^= ((values >> p) & 1) * bits[p]
    return (values[:, None] ^ patterns[syndrome]) >> 11, np.arange(6)[None, :] < counts[syndrome][:, None]


def fuzzy_keys(fp: np.ndarray, tables) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row number and key, part by part; a key names its part in the top bits."""
    value = fp.view(np.uint64)
    segment = [((value >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    coded = [codeword_indices(s, tables) for s in segment]
    part = 0
    for exact, near in permutations(range(3), 2):
        index, valid = coded[near]
        rows, column = np.nonzero(valid)
        yield rows, (part << 40) | (segment[exact][rows] << 12) | index[rows, column]
        part += 1
    (first, first_valid), (second, second_valid) = coded[0], coded[1]
    rows, i, j = np.nonzero(first_valid[:, :, None] & second_valid[:, None, :])
    both = (first[rows, i] << 12) | second[rows, j]
    for a, w in LAST_PARTS:
        yield rows, (part << 40) | (both << 7) | ((segment[2][rows] >> a) & ((1 << w) - 1))
        part += 1


def keyed_fingerprints(distinct: DataFrame) -> DataFrame:
    """``key, fp``: about 116 rows per distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(fp), 4096):
                piece = fp[start : start + 4096]
                for rows, keys in fuzzy_keys(piece, tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(piece[rows])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def close_pairs(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance


def run_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys (sorted), reduced to a forest. Lag by lag over the positions still in a run."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held, lag, at = 0, 1, np.arange(max(0, len(key) - 1))
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        close = at[close_pairs(fp[at], fp[at + lag], distance)]
        left.append(fp[close])
        right.append(fp[close + lag])
        held += len(close)
        if held > 1_000_000:
            a, b = local_forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
        lag += 1
    return local_forest(np.concatenate(left), np.concatenate(right))


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, run_length: int = RUN) -> DataFrame:
    """``a, b``: enough verified links to connect every two distinct fingerprints that are linked; at most a forest per batch.

    Rows of a key are sorted next to each other. A key of more than ``run_length`` fingerprints is written as packed blocks, and
    every two blocks of a key are compared in a task of their own.
    """
    if distance > DISTANCE:
        raise ValueError(f"the keys guarantee distances up to {DISTANCE}")
    schema = "a long, b long, key long, block int, packed binary"
    names = ["a", "b", "key", "block", "packed"]

    def rows(a, b, key=None, block=None, packed=None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                pa.array([key] * n, pa.int64()), pa.array([block] * n, pa.int32()), pa.array([packed] * n, pa.binary()),
            ],
            names,
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, written = None, np.empty(0, np.int64), 0  # the last run so far, and its blocks already written

        def block(piece: np.ndarray) -> pa.RecordBatch:
            nonlocal written
            written += 1
            return rows([None], [None], int(open_key), written, piece.tobytes())

        def ended() -> Iterator[pa.RecordBatch]:
            if written and len(held):
                yield block(held)

        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            if written and key[0] != open_key:
                yield from ended()
                held, written = held[:0], 0
            key = np.concatenate([np.full(len(held), open_key or 0), key])
            fp = np.concatenate([held, fp])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first, last = 0, starts[-1]
            if written and last:  # the long run ends in this batch
                first, held = starts[1], fp[: starts[1]]
                while len(held) > run_length:
                    yield block(held[:run_length])
                    held = held[run_length:]
                yield from ended()
            if last:
                written = 0
            lengths = np.diff(np.append(starts, len(key)))
            for s, n in zip(starts[:-1], lengths[:-1]):  # long runs within the batch
                if s >= first and n > run_length:
                    open_key = key[s]
                    for low in range(s, s + n, run_length):
                        yield block(fp[low : min(low + run_length, s + n)])
                    written = 0
            short = np.repeat(lengths <= run_length, lengths)
            short[:first] = False
            short[last:] = False
            a, b = run_links(key[short], fp[short], distance)
            if len(a):
                yield rows(a, b)
            open_key, held = key[last], fp[last:]
            while len(held) > run_length:
                yield block(held[:run_length])
                held = held[run_length:]
        if written:
            yield from ended()
        elif len(held):
            a, b = run_links(np.full(len(held), open_key), held, distance)
            yield rows(a, b)

    sorted_keys = keyed_fingerprints(distinct).repartition("key").sortWithinPartitions("key")
    found = cut_lineage(sorted_keys.mapInArrow(scan, schema))
    links = found.where("a is not null").select("a", "b")
    parts = found.where("packed is not null").select("key", "block", "packed")
    if parts.isEmpty():
        return links

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                x, y = np.frombuffer(one.as_py(), np.int64), np.frombuffer(two.as_py(), np.int64)
                a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for value in x:
                    near = y[close_pairs(np.full(len(y), value), y, distance)]
                    a.append(np.full(len(near), value))
                    b.append(near)
                left, right = local_forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    # only block numbers meet under a key; the blocks themselves are fetched for each pair
    numbers = parts.select("key", "block")
    listed = numbers.join(numbers.withColumnRenamed("block", "block2"), "key").where("block <= block2")
    other = parts.select("key", F.col("block").alias("block2"), F.col("packed").alias("packed2"))
    pairs = listed.join(parts, ["key", "block"]).join(other, ["key", "block2"]).select("packed", "packed2")
    return links.unionByName(pairs.repartition(F.xxhash64("packed", "packed2")).mapInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """``doc_id, text_key, fingerprint, component_id`` for every row of ``docs``.

    Rows are linked when their fingerprints differ in at most ``distance`` bits; ``component_id`` is the smallest id that links
    reach. Equal fingerprints are one node, so copies cost one row. Texts that are null, empty or without words have the
    fingerprint zero. Rows with null ids take part, but an id is only null in a component without any other. Repeated rows are
    returned as often; an empty table gives no rows. Only the two named columns are read.
    """
    prints = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    roots = components(fingerprint_links(nodes, distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "lowest", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id. For users of fingerprints; the pipeline compares shingles.

    Repeated rows leave one; of rows that share that id but not the text, the one of smallest text key stays. A component
    without ids leaves one row. All columns are kept, whatever their names.
    """
    found = near_duplicates(docs, doc_id, text)
    first = (
        found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("first"))
    )
    return matched_rows(docs, first.select("first.doc_id", "first.text_key"), doc_id, text, "left_semi", once=True)


def op8_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
