"""Exact dedup by Grace hashing: records are dealt to spill files by hash until what is left of a bucket fits a table in memory.

A counted Bloom filter of the hashes that occur more than once keeps every text that can have no twin where it is. Each task finds
its own copies in an open-addressing table that compares complete content, and writes the first of each, so a text of a third of all rows leaves a task
once. These records are dealt to buckets by hash. A bucket fills a table of bounded size; records whose content is not in a full table
go to the spill files of the next round, which deals them anew by another hash. Content that very many tasks hold is dealt by a salt
too, and the survivors of its salts meet in the next round. Spill files are Parquet in the shared folder, so they outlive executors.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.bloom import Bloom, bloom_of
from evalloom.llm.common import column, fresh, table
from evalloom.session import cut_lineage, run_dir

TABLE_BYTES = 48 << 20  # contents held by one table
ENTRY_BYTES = 150  # of a table besides the content
COPIES = 64  # of one content that a bucket takes before they are salted; 2 at least
HOT_SHARE = 10_000  # a hash may be salted from this part of all records on, so at most so many are
ROW_BITS = 33  # of a row number inside its task


class ContentTable:
    """Open addressing with linear probing over at most ``limit`` bytes of content; equal hashes are told apart by the content."""

    def __init__(self, limit: int = TABLE_BYTES):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes, self.contents, self.owners, self.bytes = [], [], [], 0

    def owner(self, key: int, content: bytes, new: int) -> int | None:
        """Owner of the equal content, ``new`` if there was none and it is taken in, or None if it does not fit.

        An empty table takes content of any size, so every round settles something.
        """
        mask = len(self.slots) - 1
        at = key & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == key and self.contents[i] == content:
                return self.owners[i]
            at = (at + 1) & mask
        size = len(content) + ENTRY_BYTES
        if self.hashes and self.bytes + size > self.limit:
            return None
        self.slots[at] = len(self.hashes)
        self.hashes.append(key)
        self.contents.append(content)
        self.owners.append(new)
        self.bytes += size
        if 2 * len(self.hashes) > len(self.slots):
            self.grow()
        return new

    def grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def written(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def first_records(rows: DataFrame, bloom: Bloom, table_bytes: int) -> DataFrame:
    """``rid, doc_id, sha, h, entry, size, text`` per row of ``doc_id, sha, h, text``.

    ``rid`` numbers the rows. ``entry`` is the ``rid`` of the first row of the task with the same content, null where the hash is in no
    other row; ``text`` is there only in that first row. A task that has seen more content than fits its table starts a new one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bloom.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, seen = Bloom.unpack(shared.value), ContentTable(table_bytes)
        rid = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            n = batch.num_rows
            hashes = batch.column(2).to_numpy(zero_copy_only=False)
            texts = batch.column(3).cast(pa.large_binary())
            entry, text, size = [None] * n, [None] * n, [None] * n
            for i in np.flatnonzero(may.has(hashes.view(np.uint64))).tolist():
                content, key = texts[i].as_py(), int(hashes[i])
                owner = seen.owner(key, content, rid + i)
                if owner is None:
                    seen.clear()
                    owner = seen.owner(key, content, rid + i)
                entry[i] = owner
                if owner == rid + i:
                    text[i], size[i] = content, len(content)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + n)), *batch.columns[:3], pa.array(entry, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(text, pa.binary())],
                ["rid", "doc_id", "sha", "h", "entry", "size", "text"],
            )
            rid += n

    return rows.mapInArrow(run, "rid long, doc_id long, sha string, h long, entry long, size long, text binary")


def hot_hashes(pending: DataFrame, records: int, copies: int) -> DataFrame:
    """``hot, salts`` for hashes of more than ``copies`` records and a ``HOT_SHARE``-th of all: at most ``HOT_SHARE`` rows."""
    counted = pending.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(copies, records // HOT_SHARE))
    found = counted.select(F.col("h").alias("hot"), F.ceil(F.col("n") / copies).alias("salts")).collect()
    return pending.sparkSession.createDataFrame(found, "hot long, salts long")


def grace_round(pending: DataFrame, hot: DataFrame, size: int, number: int, table_bytes: int) -> DataFrame:
    """``entry, h, size, leader, text`` per record: the record of the same content that stands for it; ``text`` if it is not settled.

    ``size`` is the bytes of all records.
    """
    spark = pending.sparkSession
    salted = pending.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left").select(
        "entry", "h", "size", "text", F.coalesce("salts", F.lit(1)).alias("salts")
    )
    salt = F.pmod(F.xxhash64("entry"), F.col("salts"))
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // table_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ContentTable(table_bytes)
        for batch in batches:
            leader, text = [], []
            for entry, key, salts, content in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                owner = held.owner(key, content, entry)
                leader.append(owner)
                text.append(content if owner is None or (owner == entry and salts > 1) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(leader, pa.int64()), pa.array(text, pa.binary())],
                ["entry", "h", "size", "leader", "text"],
            )

    dealt = salted.repartition(buckets, F.xxhash64("h", F.lit(number), salt)).select("entry", "h", "size", "salts", "text")
    return dealt.mapInArrow(run, "entry long, h long, size long, leader long, text binary")


def equal_entries(records: DataFrame, folder: str, table_bytes: int, copies: int) -> DataFrame:
    """``entry, root`` for records whose content is also that of another record, the root.

    Rounds go on until nothing is pending. Salts are used while they halve the records; a round without them settles at least one
    content of every bucket, so even texts of one hash come to an end.
    """
    pending, rounds, before = records.select("entry", "h", "size", "text"), [], None
    while True:
        left = pending.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        if rounds and not left["n"]:
            break
        halved = before is None or 2 * left["n"] <= before
        hot = hot_hashes(pending, left["n"], copies if halved else left["n"])
        before = left["n"]
        spilled = written(grace_round(pending, hot, left["bytes"], len(rounds), table_bytes), f"{folder}/{len(rounds)}")
        rounds.append(spilled.where("leader <> entry").select("entry", F.col("leader").alias("root")))
        pending = spilled.where("text is not null").select("entry", "h", "size", "text")

    def followed(later: DataFrame, earlier: DataFrame) -> DataFrame:
        on = later.select(F.col("entry").alias("root"), F.col("root").alias("end"))
        return earlier.join(on, "root", "left").select("entry", F.coalesce("end", "root").alias("root")).unionByName(later)

    return reduce(followed, reversed(rounds))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None,
                 table_bytes: int = TABLE_BYTES, copies: int = COPIES, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after ``normalise``, by default without any change; null counts as empty. Of equal texts the
    row with the largest id stays, and ``keep_id`` is its id. Null ids come before all others; if all ids of a group are null,
    ``keep_id`` is null. Of repeated rows of one id and text, one stays. Texts of any length are compared whole.
    An empty table gives no row. Only the two columns are read, so other columns may have any name.
    """
    body = F.coalesce(column(text).cast("string"), F.lit(""))
    body = normalise(body) if normalise else body
    key = F.xxhash64(body) if hash_bits == 64 else F.xxhash64(body).bitwiseAND(F.lit((1 << hash_bits) - 1))
    rows = docs.select(
        column(doc_id).cast("long").alias("doc_id"), F.sha2(body, 256).alias("sha"), key.alias("h"), body.alias("text")
    )
    repeated = cut_lineage(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    folder = run_dir(docs.sparkSession, "exact")
    firsts = written(first_records(rows, bloom_of(repeated, "h", repeated.count()), table_bytes), f"{folder}/rows")
    links = equal_entries(firsts.where("text is not null"), folder, table_bytes, copies)
    # counts go from rows to the records of their task and from these to groups; the answer comes back the same way
    best = F.max(F.struct("doc_id", "rid")).alias("best")
    listed = firsts.where("entry is not null").select("rid", "doc_id", "sha", "entry")
    counted = listed.groupBy("entry").agg(best, F.count("*").alias("n"))
    rooted = cut_lineage(counted.join(links, "entry", "left").withColumn("root", F.coalesce("root", "entry")))
    groups = rooted.groupBy("root").agg(F.max("best").alias("keep"), F.sum("n").alias("group_size"))
    answers = rooted.select("entry", "root").join(groups, "root").drop("root")
    shared = listed.join(answers, "entry").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    single = firsts.where("entry is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return single.unionByName(shared)


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, as :func:`exact_groups` says; all columns are kept, whatever their names.

    Repeated rows of one id and text leave one of them.
    """
    groups = exact_groups(docs, doc_id, text, **options)
    mine, digest, keep, keep_digest = fresh(docs.columns, "id", "digest", "keep", "keep_digest")
    kept = groups.where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(keep_digest))
    normalise = options.get("normalise") or (lambda c: c)
    body = normalise(F.coalesce(column(text).cast("string"), F.lit("")))
    keyed = docs.select("*", column(doc_id).cast("long").alias(mine), F.sha2(body, 256).alias(digest))
    same = F.col(mine).eqNullSafe(F.col(keep)) & (F.col(digest) == F.col(keep_digest))
    return keyed.join(kept, same, "left_semi").dropDuplicates([mine, digest]).drop(mine, digest)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op13_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))
