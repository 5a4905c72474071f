"""Near copies by the Jaccard similarity of their shingles: Golay keys of a SimHash and min-hash bands give candidates, shingle sets decide.

A text is the set of the hashes of its ``SHINGLE``-word runs; equal sets are one node. Its SimHash is the majority of that set. Nodes whose
fingerprints differ in at most four bits share a Golay key (see :mod:`evalloom.llm.simhash`); each is compared with one that such keys link to it.

Four bits are a similarity of about 0.96. At 0.8 about ten bits differ, and keys that reach ten bits match nearly everything; so what is left
comes from bands. Each node has ``BANDS`` keys, each of ``ROWS`` minimum hashes. A pair of similarity ``s`` shares none of them with a
chance of ``(1 - s ** ROWS) ** BANDS``, which is 1.3e-7 at 0.8 and less above.

Nodes of one key make a bucket. First each node is compared with one node, the smallest that a bucket of it holds, unless the Golay keys gave that
pair; so a large group of near copies costs two comparisons per node at most. Then buckets that these links do not join are searched in pieces
of bounded size. Nodes with a partner that passes a screen (sizes, and ``SIGNATURE`` bytes of minimum hashes) get their texts, and a task
compares the pairs of its piece that nothing joins yet. It gives out a forest, so links never outnumber nodes. Every link is verified on the
whole shingle sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.functions.wordhash import mixed, pieces, run_hashes, words_of
from evalloom.llm.common import column, matched_rows, text_key
from evalloom.llm.components import components
from evalloom.llm.simhash import LOWER, fingerprint_links, majority
from evalloom.llm.substring import collect_bitmaps, has_bit
from evalloom.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
SIGNATURE = 64  # bytes of as many minimum hashes
AGREE = 30  # of them that a pair must have in common to be compared; at 0.8 fewer agree with a chance below 1e-9
KEY_BITS = 26  # of the bitmap of texts that share a bucket: 8 MB
BLOCK = 1024  # nodes of one bucket compared in one piece
STAR = 2048  # nodes compared with one centre in one piece
CACHE_BYTES = 64 << 20  # of shingle sets that a task keeps

LOWER_BYTES = np.frombuffer(LOWER, np.uint8)
_draws = np.random.default_rng(11)
MASKS = _draws.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
FACTORS = _draws.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(piece: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text of a slice; a text of fewer words has one, of all its words, or none without words."""
    words = words_of(piece, LOWER_BYTES)
    value, inside = run_hashes(words, shingle)
    out = []
    for row in range(len(piece)):
        a, b = words.first[row], words.first[row + 1]
        if b - a >= shingle:
            out.append(np.unique(value[a : b - shingle + 1]))
        elif b > a:
            joined = b" ".join(words.data[words.start[i] : words.end[i]].tobytes() for i in range(a, b))
            out.append(np.array([xxhash.xxh64_intdigest(joined, int(b - a))], dtype=np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(values: np.ndarray) -> int:
    """One number for a set of shingles; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes())).view(np.int64)) if len(values) else 0


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The ``count`` minimum hashes of each non-empty set, a row per set."""
    flat = np.concatenate(sets)
    start = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), count), dtype=np.uint64)
    work = np.empty_like(flat)
    for i in range(count):
        np.bitwise_xor(flat, MASKS[i], out=work)
        np.multiply(work, FACTORS[i], out=work)
        out[:, i] = np.minimum.reduceat(work, start)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """``BANDS`` keys per row of :func:`minima`."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    for i in range(ROWS):
        key = mixed(key ^ least[:, i::ROWS])
    return key.view(np.int64)


def text_nodes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, node, fp, bands`` per row of ``doc_id, text_key, text``: the fingerprint and the min-hash keys of the shingle set.

    Sets of one shingle have neither; they are equal or apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, piece in pieces(batch.column(2)):
                sets = shingle_sets(piece, shingle)
                prints, bands = [None] * len(sets), [None] * len(sets)
                some = [i for i, s in enumerate(sets) if len(s) > 1]
                if some:
                    for i, keys in zip(some, band_keys(minima([sets[i] for i in some], BANDS * ROWS))):
                        prints[i], bands[i] = majority(sets[i]), keys
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(piece)), batch.column(1).slice(low, len(piece)),
                     pa.array([node_of(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "node", "fp", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, fp long, bands array<long>")


def golay_candidates(nodes: DataFrame) -> DataFrame:
    """``a, b``, ``a`` smaller, one row per ``b`` at most: pairs of ``node, fp`` that SimHash takes for near copies.

    A node meets the smallest node of its fingerprint. That one meets the smallest of the smaller nodes whose fingerprints
    :func:`evalloom.llm.simhash.fingerprint_links` links to its own by Golay keys.
    """
    prints = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    links = fingerprint_links(prints.select("fp"))
    one = prints.select(F.col("fp").alias("a"), F.col("rep").alias("one"))
    two = prints.select(F.col("fp").alias("b"), F.col("rep").alias("two"))
    met = links.distinct().join(one, "a").join(two, "b").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    same = nodes.join(prints, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return cut_lineage(met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(same))


def buckets(keyed: DataFrame) -> DataFrame:
    """``key, node, rep`` for the keys of several nodes; ``rep`` is the smallest node of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, smallest node, and whether its first row still has to be written
        for batch in batches:
            key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            if last is not None:  # the smallest node of the open key stands before the batch
                key, node = np.append(last[0], key), np.append(last[1], node)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            kept = np.repeat(size > 1, size)
            if last is not None and not last[2]:
                kept[0] = False
            rep = np.repeat(node[start], size)
            fresh = size[-1] == 1 and (len(start) > 1 or last is None or last[2])
            last = (key[-1], rep[-1], fresh)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[kept]), pa.array(node[kept]), pa.array(rep[kept])], ["key", "node", "rep"]
            )

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, rep long")


def node_bodies(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``node, size, signature, packed`` of the texts whose keys are ``wanted``: shingles, minimum hashes, compressed text.

    The wanted keys travel as a bitmap, so that no other text is shuffled; a false bit only adds a row that nothing asks for.
    """
    bit = F.col("text_key").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    marked = collect_bitmaps(wanted.select(bit.alias("bit"), F.lit(False).alias("hot")), KEY_BITS)[0]
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(marked.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        squeeze = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for _, piece in pieces(batch.column(1).filter(pa.array(has_bit(marks, key.view(np.uint64), KEY_BITS)))):
                sets = shingle_sets(piece, shingle)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                least = (minima([sets[i] for i in some], SIGNATURE) >> np.uint64(20)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(sets[i]) for i in some], pa.int64()), pa.array([len(sets[i]) for i in some], pa.int32()),
                     pa.array([row.tobytes() for row in least], pa.binary()),
                     pa.array([squeeze.compress(piece[i].as_py()) for i in some], pa.binary())],
                    ["node", "size", "signature", "packed"],
                )

    found = docs.select("text_key", "text").mapInArrow(run, "node long, size int, signature binary, packed binary")
    return cut_lineage(found.dropDuplicates(["node"]))


class Shingles:
    """Shingle sets of packed texts; the last ones used are kept, up to ``limit`` bytes."""

    def __init__(self, shingle: int, limit: int = CACHE_BYTES):
        self.shingle, self.limit, self.held, self.bytes = shingle, limit, {}, 0
        self.unpack = zstandard.ZstdDecompressor()

    def of(self, node: int, packed: bytes) -> np.ndarray:
        found = self.held.pop(node, None)
        if found is None:
            text = pa.array([self.unpack.decompress(packed)], pa.large_binary())
            found = shingle_sets(text, self.shingle)[0]
            self.bytes += found.nbytes
        self.held[node] = found
        while self.bytes > self.limit and len(self.held) > 1:
            self.bytes -= self.held.pop(next(iter(self.held))).nbytes
        return found


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def star_links(star: DataFrame, bodies: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b``: the rows of ``star`` (one centre ``a`` per ``b``) whose shingle sets have at least that Jaccard similarity.

    A centre of many nodes is dealt to pieces of about ``STAR`` of them; its text travels once per piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_set, sets = None, None, Shingles(shingle)
        for batch in batches:
            a, b = [], []
            for one, node, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if node == one:
                    centre, centre_set = one, sets.of(one, packed)
                elif one == centre and similar(centre_set, sets.of(node, packed), similarity):
                    a.append(one)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sizes = star.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("pieces"))
    members = star.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int").alias("piece"), F.col("b").alias("node"))
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("a").alias("node"))
    rows = members.unionByName(centres).join(bodies.select("node", "packed"), "node")
    ordered = rows.repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("node") != F.col("a"))
    return cut_lineage(ordered.select("a", "node", "packed").mapInArrow(run, "a long, b long"))


PIECE = ["key", "g", "h"]


def by_piece(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each`` of the Arrow table of every piece; a piece is in one task and its rows are at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # batches of the open piece

        def place(batch: pa.RecordBatch) -> np.ndarray:
            return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)

        open_place = None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = place(batch)
            start = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1)]))
            for a, b in zip(start, np.append(start[1:], len(where))):
                if open_place is not None and (where[a] != open_place).any():
                    yield each(pa.Table.from_batches(held).combine_chunks())
                    held = []
                open_place = where[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield each(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(*PIECE).sortWithinPartitions(*PIECE).mapInArrow(run, schema)


def screened(piece: pa.Table, similarity: float, roots: np.ndarray, i: int) -> np.ndarray:
    """Rows after ``i``, or of the other block, with another root that may be similar to row ``i``.

    A piece holds the blocks ``g`` and ``h`` of a bucket; pairs inside a block belong to the piece of the block with itself.
    """
    g, h = piece["g"][0].as_py(), piece["h"][0].as_py()
    block, size = piece["block"].to_numpy(), piece["size"].to_numpy()
    if g != h and block[i] != g:
        return np.empty(0, np.int64)
    other = np.arange(i + 1, len(block)) if g == h else np.flatnonzero(block == h)
    small, large = np.minimum(size[i], size[other]), np.maximum(size[i], size[other])
    other = other[(roots[other] != roots[i]) & (small >= similarity * large - 1e-9)]
    if not len(other):
        return other
    signature = np.frombuffer(piece["signature"].chunk(0).buffers()[2], np.uint8)[piece["signature"].chunk(0).offset * SIGNATURE :]
    signature = signature[: len(block) * SIGNATURE].reshape(-1, SIGNATURE)
    return other[(signature[other] == signature[i]).sum(axis=1) >= AGREE]


def open_nodes(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows of pieces (``key, g, h``) that have a partner of another label which passes the screen: never more rows than came in."""

    def near(piece: pa.Table) -> pa.RecordBatch:
        label = piece["label"].to_numpy()
        found = np.zeros(len(label), dtype=bool)
        for i in range(len(label)) if (label != label[0]).any() else ():
            other = screened(piece, similarity, label, i)
            found[other] = True
            found[i] |= len(other) > 0
        kept = piece.select([*PIECE, "node", "label", "block"]).filter(pa.array(found))
        return kept.combine_chunks().to_batches()[0] if len(kept) else pa.RecordBatch.from_pylist([], kept.schema)

    return by_piece(rows, near, "key long, g int, h int, node long, label long, block int")


def piece_links(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b``: a forest of verified links inside every piece. Nodes of one label, and nodes that links join already, are not compared."""

    def forest(piece: pa.Table) -> pa.RecordBatch:
        node, packed = piece["node"].to_numpy(), piece["packed"]
        _, roots = np.unique(piece["label"].to_numpy(), return_inverse=True)
        sets, a, b = Shingles(shingle), [], []
        for i in range(len(node)):
            for j in screened(piece, similarity, roots, i).tolist():
                if roots[i] != roots[j] and similar(
                    sets.of(int(node[i]), packed[i].as_py()), sets.of(int(node[j]), packed[j].as_py()), similarity
                ):
                    a.append(min(int(node[i]), int(node[j])))
                    b.append(max(int(node[i]), int(node[j])))
                    roots[roots == roots[j]] = roots[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut_lineage(by_piece(rows, forest, "a long, b long"))


def similar_roots(docs: DataFrame, found: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
                  block: int = BLOCK) -> DataFrame:
    """``node, root`` for the nodes that are linked to a smaller one. ``found`` is :func:`text_nodes` of ``docs``."""
    banded = found.where("bands is not null")
    distinct = banded.select("node", "fp", "bands").dropDuplicates(["node"])
    close = golay_candidates(distinct.select("node", "fp"))
    shared = cut_lineage(buckets(distinct.select(F.explode("bands").alias("key"), "node")))
    texts = banded.groupBy("node").agg(F.min("text_key").alias("text_key"))
    asked = shared.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    bodies = node_bodies(docs, texts.join(asked, "node"), shingle)
    star = shared.where("node <> rep").groupBy(F.col("node").alias("b")).agg(F.min("rep").alias("a")).select("a", "b")
    links = star_links(close.unionByName(star).distinct(), bodies, shingle, similarity)
    # the end of two links is label enough: it only has to be in the node's component
    up = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("one"))
    upper = up.select(F.col("node").alias("one"), F.col("one").alias("two"))
    labels = up.join(upper, "one", "left").select("node", F.coalesce("two", "one").alias("root"))
    labelled = cut_lineage(
        shared.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    )
    mixed_keys = (
        labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
        .where("low < high").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = (
        labelled.join(mixed_keys, "key").withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "node", "label", "block", F.least("block", "other").alias("g"), F.greatest("block", "other").alias("h"))
    )
    looks = rows.join(bodies.select("node", "size", "signature"), "node").select(*PIECE, "node", "label", "block", "size", "signature")
    bare = open_nodes(looks, similarity)
    full = bare.join(bodies, "node").select(*PIECE, "node", "label", "block", "size", "signature", "packed")
    more = piece_links(full, shingle, similarity)
    return components(links.unionByName(more))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of smallest id.

    Texts are near copies when the Jaccard similarity of their sets of ``shingle``-word runs is at least ``similarity``; groups are what
    such links connect. Words are runs between ASCII white space, ASCII letters in lower case. Shorter texts equal only texts of the same
    words, and texts without words are equal. Repeated rows leave one; of rows that share the smallest id but not the text, the one of
    smallest text key stays. Null ids come last; a group without ids leaves one row. All columns are kept, whatever their names.
    """
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), text_key(column(text)).alias("text_key"), column(text).alias("text"))
    found = cut_lineage(text_nodes(rows, options.get("shingle", SHINGLE)))
    roots = similar_roots(rows, found, **options)
    first = (
        found.select("doc_id", "text_key", "node").join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("group"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("first"))
    )
    return matched_rows(docs, first.select("first.doc_id", "first.text_key"), doc_id, text, "left_semi", once=True)
