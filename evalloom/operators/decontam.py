"""Contamination of a training corpus by evaluation texts: n-gram tables, overlap, statistics and cleaning."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.bloom import Bloom, bloom_of
from evalloom.functions.text import let, located_words, ngrams, normal_words, plain_words
from evalloom.functions.wordhash import pieces, run_hashes, words_of
from evalloom.operators.runs import dealt_runs, sampled, spelled
from evalloom.operators.scale import BROADCAST_ROWS, fits_broadcast, semi_join_sized
from evalloom.session import cut_lineage

NGRAM = 13
BUCKETS = 500
MAX_DOCUMENTS = 10
WINDOW_TO_REMOVE = 200
MINIMUM_SLICE = 200
TOO_DIRTY = 10
# rows of two 64-bit keys that may be broadcast (about 60 bytes each)
KEY_ROWS = 4_000_000
HELD = 1 << 20  # n-grams that a task combines before it deals them
TASK_BYTES = 96 << 20  # of text whose n-grams a task deals; larger partitions are dealt anew, or the shuffle would spill
PACKED_BYTES = 4 * TASK_BYTES  # the same where runs are dealt packed: they are as large as the text
TEXT_BYTES = 6 << 20  # of text whose n-grams are counted in one partition
FILTER_BITS = 22  # of the table that most n-grams without a hit are turned away by


def ngram_postings(docs: DataFrame, n: int = NGRAM, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """One row per n-gram occurrence: ``keys..., pos, ngram`` (``pos`` counts words from 0)."""
    keys = keys or ["doc_id"]
    return docs.select(*keys, F.posexplode(ngrams(normal_words(text), n)).alias("pos", "ngram"))


def distinct_postings(docs: DataFrame, n: int = NGRAM, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """One row per distinct n-gram of each document. Duplicates inside a document go before any shuffle."""
    keys = keys or ["doc_id"]
    return docs.select(*keys, F.explode(F.array_distinct(ngrams(normal_words(text), n))).alias("ngram"))


def with_bucket(postings: DataFrame, buckets: int = BUCKETS, hashed: Column | None = None) -> DataFrame:
    """Add the hash bucket of the n-gram; the hash does not depend on the process. ``hashed`` replaces the 64-bit default."""
    value = F.xxhash64("ngram") if hashed is None else hashed
    return postings.withColumn("bucket", F.pmod(value, F.lit(buckets)).cast("int"))


def sorted_buckets(postings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a bucket together and sorted by n-gram, ready for a bucketed write.

    The bucket is range-partitioned with the n-gram, so a bucket dominated by one n-gram spans several tasks.
    """
    bucketed = with_bucket(postings, buckets)
    return bucketed.repartitionByRange("bucket", "ngram", "doc_id").sortWithinPartitions("bucket", "ngram", "doc_id")


def sorted_run_buckets(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id",
                       text_bytes: int = TEXT_BYTES) -> DataFrame:
    """``key, bucket, ngram`` per n-gram occurrence, as :func:`sorted_buckets` has it, with buckets by the mark of :mod:`runs`.

    Runs of words are dealt, packed, and spelled out where they are sorted, in partitions of about ``text_bytes`` of text, so that an n-gram
    is not moved word by word and the sort fits in memory. Rows of a bucket are together, and sorted by n-gram inside a partition; a bucket
    that spans several is cut by mark, and a mark that does by run.
    """
    source = docs.select(key, text)
    docs, parts, total = sized(source, text, key, text_bytes, PACKED_BYTES)
    runs = dealt_runs(docs, n, buckets, parts, sampled(source, total), text, key)
    # a sort compares the first eight bytes of its first column at once: digits of the bucket and the head of the n-gram, which are in the same order
    digits = len(np.base_repr(max(buckets - 1, 0), 36))
    rows = spelled(runs.withColumn("_digits", F.lpad(F.conv(F.col("bucket").cast("string"), 10, 36), digits, "0")), n)
    head = F.concat("_digits", F.substring("ngram", 1, max(8 - digits, 1)))
    ordered = rows.select(key, "bucket", "ngram", head.alias("_head")).sortWithinPartitions("_head", "bucket", "ngram", key)
    return ordered.drop("_head")


def hashed_postings(docs: DataFrame, n: int = NGRAM, text: str = "text", key: str = "doc_id",
                    distinct: bool = True) -> DataFrame:
    """``k1, k2`` per n-gram (once per document with ``distinct``): two 64-bit hashes, made from word hashes in one vectorised pass.

    No n-gram is spelled out; what leaves the pass is 16 bytes per n-gram.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in hashed_pieces(batches, n, distinct):
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["k1", "k2"])

    return docs.select(plain_words(text).alias("text")).mapInArrow(run, "k1 long, k2 long")


def hashed_pieces(batches: Iterator[pa.RecordBatch], n: int, distinct: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two hashes per n-gram of some texts at a time."""
    for batch in batches:
        for _, piece in pieces(batch.column(0)):
            words = words_of(piece)
            one, inside = run_hashes(words, n)
            two, _ = run_hashes(words, n, salt=1)
            at = np.flatnonzero(inside)
            if distinct and len(at):
                doc = words.doc[at]
                order = np.lexsort([one[at], doc])
                at, doc = at[order], doc[order]
                at = at[np.concatenate([[True], (one[at[1:]] != one[at[:-1]]) | (doc[1:] != doc[:-1])])]
            yield one[at], two[at]


def combined(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """``k1, k2, copies`` of some n-grams, equal ones in one row."""
    order = np.lexsort([two, one])
    one, two = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    copies = np.diff(np.append(first, len(one)))
    columns = [pa.array(c) for c in (one[first].view(np.int64), two[first].view(np.int64), copies)]
    return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "copies"])


def sized(docs: DataFrame, text: str, key: str, text_bytes: int, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, int, int]:
    """``docs`` in partitions of bounded text, partitions enough for ``text_bytes`` of it in each, and the bytes of the text, which are counted first."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // text_bytes))
    if docs.rdd.getNumPartitions() * task_bytes < total:
        docs = docs.repartition(-(-total // task_bytes), key)
    return docs, parts, total


def counted_hashes(docs: DataFrame, n: int, text: str = "text", key: str = "doc_id", distinct: bool = True, held: int = HELD,
                   text_bytes: int = TEXT_BYTES, second: bool = True) -> DataFrame:
    """``k1, k2, copies``: the hashes of :func:`hashed_postings`, each once, with the number of its rows; by ``k1`` alone without ``second``.

    A task combines ``held`` n-grams at a time, so its memory does not grow with its input and a hash that is everywhere is dealt few
    times. Hashes are dealt before they are counted, to one partition per ``text_bytes`` of text, so that counting fits in memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos, size = [], [], 0
        for one, two in hashed_pieces(batches, n, distinct):
            ones.append(one)
            twos.append(two if second else np.zeros_like(one))
            size += len(one)
            if size >= held:
                yield combined(np.concatenate(ones), np.concatenate(twos))
                ones, twos, size = [], [], 0
        if size:
            yield combined(np.concatenate(ones), np.concatenate(twos))

    keys = ["k1", "k2"] if second else ["k1"]
    docs, parts, _ = sized(docs.select(key, text), text, key, text_bytes)
    rows = docs.select(plain_words(text).alias("text")).mapInArrow(run, "k1 long, k2 long, copies long").select(*keys, "copies")
    return rows.repartition(parts, *keys).groupBy(*keys).agg(F.sum("copies").alias("copies"))


def gram_keys(grams: DataFrame, n: int) -> DataFrame:
    """``k1`` of each n-gram of ``ngram``, as :func:`hashed_postings` gives it; text that is not ``n`` words has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, piece in pieces(batch.column(0)):
                words = words_of(piece)
                value, _ = run_hashes(words, n)
                at = words.first[:-1][np.diff(words.first) == n]
                yield pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64))], ["k1"])

    return grams.select("ngram").mapInArrow(run, "k1 long").distinct()


class Listed:
    """Hashes that are known one by one; a small table of their low bits turns most others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.may = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.may[self.keys & np.uint64((1 << FILTER_BITS) - 1)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        out = self.may[values & np.uint64((1 << FILTER_BITS) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
            out[at] = self.keys[place] == values[at]
        return out


def hash_filter(keys: DataFrame, max_keys: int = KEY_ROWS) -> Listed | Bloom:
    """What tasks test the hashes ``k1`` with: the hashes themselves up to ``max_keys``, a Bloom filter of bounded size beyond.

    Only hashes reach the driver, never n-grams.
    """
    keys = cut_lineage(keys)  # counted, then read once more
    count = keys.count()
    if count <= max_keys:
        return Listed(keys.toArrow()["k1"].to_numpy().view(np.uint64))
    return bloom_of(keys, "k1", count)


def spelled_hits(docs: DataFrame, known: Listed | Bloom, n: int, text: str, keys: list[str]) -> DataFrame:
    """Distinct n-grams of each document whose hash ``known`` lets pass: ``keys..., ngram``.

    One pass over the words; only n-grams that pass are spelled out. The filter goes to every task and has a bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low, piece in pieces(batch.column(len(keys))):
                words = words_of(piece)
                value, inside = run_hashes(words, n)
                at = np.flatnonzero(inside)
                at = at[known.has(value[at])]
                found = {}
                for i in at.tolist():
                    gram = b" ".join(words.data[words.start[i] : words.end[i + n - 1]].tobytes().split())
                    found[(int(words.doc[i]), gram)] = None
                rows = pa.array([low + doc for doc, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(j).take(rows) for j in range(len(keys))], pa.array([g.decode() for _, g in found], pa.string())],
                    [*keys, "ngram"],
                )

    return docs.select(*keys, plain_words(text).alias("_text")).mapInArrow(run, f"{fields}, ngram string")


def frequent_ngrams(docs: DataFrame, n: int = NGRAM, more_than: int = MAX_DOCUMENTS, text: str = "text",
                    key: str = "doc_id", max_keys: int = KEY_ROWS) -> DataFrame:
    """N-grams found in more than ``more_than`` documents, with the count.

    The first pass counts hashes (combined in the tasks) and keeps the frequent ones; the second spells out just those
    and counts them exactly.
    """
    likely = counted_hashes(docs, n, text, key, second=False).where(F.col("copies") > more_than)
    # the filter keeps the hashes as a table, so the first pass over the corpus runs once
    candidates = spelled_hits(docs, hash_filter(likely.select("k1"), max_keys), n, text, [key])
    return candidates.groupBy("ngram").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > more_than)


def eval_lookup(evals: DataFrame, n: int = NGRAM, text: str = "text",
                keys: tuple[str, ...] = ("task", "set", "item_id")) -> DataFrame:
    """Inverted lookup of the evaluation side: distinct ``(ngram, task, set, item)``."""
    return distinct_postings(evals, n, text, list(keys))


def matched_postings(docs: DataFrame, ngram_set: DataFrame, n: int = NGRAM, text: str = "text",
                     keys: list[str] | None = None, max_rows: int = BROADCAST_ROWS, max_keys: int = KEY_ROWS) -> DataFrame:
    """Distinct n-grams of each document that are in ``ngram_set``: ``keys..., ngram``.

    One vectorised pass tests hashes; what passes is spelled out and compared word by word with the set. No other n-gram is spelled out
    or shuffled, however large the set. n-grams of the set must have ``n`` words.
    """
    keys = keys or ["doc_id"]
    hits = spelled_hits(docs, hash_filter(gram_keys(ngram_set, n), max_keys), n, text, keys)
    return semi_join_sized(hits, ngram_set, "ngram", F.struct(*keys), max_rows).select(*keys, "ngram")


def train_overlap(train: DataFrame, evals: DataFrame, n: int = NGRAM, keys: tuple[str, ...] = ("task", "set", "item_id"),
                  max_documents: int | None = None, key: str = "doc_id") -> DataFrame:
    """Contaminated evaluation items with the number of their distinct n-grams seen in training.

    One pass over the training text: only n-grams of the evaluation side survive it, counted by document. With
    ``max_documents``, n-grams of more training documents are too frequent to be evidence.
    """
    lookup = eval_lookup(evals, n, keys=keys)
    seen = matched_postings(train, lookup, n, keys=[key]).groupBy("ngram").agg(F.count("*").alias("n_docs"))
    if max_documents is not None:
        seen = seen.where(F.col("n_docs") <= max_documents)
    return lookup.join(seen, "ngram", "left_semi").groupBy(*keys).agg(F.count("*").alias("n_matched"))


def overlap_statistics(train: DataFrame, evals: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row: total, unique, unique matching and unique non-matching n-grams of the training side."""
    lookup = hashed_postings(evals, n, key=evals.columns[0]).distinct().withColumn("hit", F.lit(True))
    if fits_broadcast(lookup, KEY_ROWS):
        lookup = F.broadcast(lookup)
    unique = counted_hashes(train, n, distinct=False)
    marked = unique.join(lookup, ["k1", "k2"], "left")
    return marked.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_ngrams"),
        F.count("*").alias("unique_ngrams"),
        F.count_if(F.col("hit").isNotNull()).alias("matching_unique"),
        F.count_if(F.col("hit").isNull()).alias("non_matching_unique"),
    )


def ngram_spans(docs: DataFrame, n: int = NGRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """N-grams with the character range they cover in the original text: ``key, pos, ngram, start, stop``."""
    parts = docs.select(key, located_words(text).alias("w"))

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - n)
        spans = F.transform(starts, lambda i: F.struct(
            F.concat_ws(" ", *[F.get(w, i + k)["word"] for k in range(n)]).alias("ngram"),
            F.get(w, i)["start"].alias("start"), F.get(w, i + (n - 1))["stop"].alias("stop"),
        ))
        return F.when(F.size(w) >= n, spans)

    spans = parts.select(key, F.posexplode(let(F.col("w"), runs)).alias("pos", "g"))
    return spans.select(key, "pos", "g.ngram", "g.start", "g.stop")


def span_totals(docs: DataFrame, n: int = NGRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_ngrams, sum_start, sum_stop, first_ngram`` over :func:`ngram_spans`; keys without n-grams have no row.

    A text is added up where it is read, so what is sorted and shuffled is a row per text, not a row per n-gram. Only n-grams that
    begin with the smallest first word are spelled out.
    """
    def added(words: Column, field: str) -> Column:
        return F.aggregate(words, F.lit(0).cast("long"), lambda total, s: total + s[field])

    def totals(w: Column) -> Column:
        count = F.size(w) - (n - 1)
        heads = F.slice(w, F.lit(1), count)
        # a blank ends the word, as in the n-gram: it stands before letters but after control characters
        head = lambda word: F.concat(word, F.lit(" ")) if n > 1 else word

        def smallest(least: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), count - 1), lambda i: head(F.get(w, i)["word"]) == least)
            return F.array_min(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + k)["word"] for k in range(n)])))

        return F.when(count > 0, F.struct(
            count.cast("long").alias("n_ngrams"), added(heads, "start").alias("sum_start"),
            added(F.slice(w, F.lit(n), count), "stop").alias("sum_stop"),
            let(F.array_min(F.transform(heads, lambda s: head(s["word"]))), smallest).alias("first_ngram"),
        ))

    rows = docs.select(key, let(located_words(text), totals).alias("s"))
    summed = rows.groupBy(key).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("n_ngrams", "sum_start", "sum_stop")], F.min("s.first_ngram").alias("first_ngram")
    )
    return summed.where("n_ngrams > 0")


def dirty_ranges(docs: DataFrame, ngram_set: DataFrame, n: int = NGRAM, window: int = WINDOW_TO_REMOVE,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Merged character ranges ``[start, stop)`` to remove from each matched document.

    Only documents with a match are given offsets; the overlapping widened ranges are merged by gaps and islands.
    """
    # kept as a table of keys, so that the pass over all n-grams runs once
    hit_docs = cut_lineage(matched_postings(docs, ngram_set, n, text, [key]).select(key).distinct())
    texts = semi_join_sized(docs.select(key, text), hit_docs, key, F.col(key))
    spans = semi_join_sized(ngram_spans(texts, n, text, key), ngram_set, "ngram", F.struct(key, "pos"))
    wide = spans.join(texts.select(key, F.length(text).alias("len")), key).select(
        key,
        F.greatest(F.lit(0), F.col("start") - window).alias("start"),
        F.least(F.col("len"), F.col("stop") + window).alias("stop"),
    )
    by_start = W.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    islands = wide.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn(
        "island", F.sum("new").over(by_start.rowsBetween(W.unboundedPreceding, 0))
    )
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def clean_documents(docs: DataFrame, ngram_set: DataFrame, n: int = NGRAM, window: int = WINDOW_TO_REMOVE,
                    minimum: int = MINIMUM_SLICE, too_dirty: int = TOO_DIRTY, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Training text without contamination: ``key, slice_no, start, text``.

    Untouched documents pass through whole as one slice. In a touched document the dirty ranges cut slices; documents cut into
    more than ``too_dirty`` slices are dropped, and of the others the slices shorter than ``minimum`` are.
    """
    ranges = dirty_ranges(docs, ngram_set, n, window, key, text)
    cuts = cut_lineage(ranges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts")))
    # the corpus is shuffled only when the matched documents are too many to broadcast
    body = docs.select(key, text).join(F.broadcast(cuts) if fits_broadcast(cuts) else cuts, key, "left")
    begins = F.concat(F.array(F.lit(0)), F.col("cuts.stop"))
    ends = F.concat(F.col("cuts.start"), F.array(F.length(text)))
    gaps = F.filter(
        F.arrays_zip(begins.alias("start"), ends.alias("stop")), lambda s: s["stop"] > s["start"]
    )
    untouched = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("stop")))
    sliced = body.withColumn("slices", F.when(F.col("cuts").isNull(), untouched).otherwise(gaps))
    return (
        sliced.where(F.col("cuts").isNull() | (F.size("slices") <= too_dirty))
        .select(key, text, F.col("cuts").isNull().alias("_whole"), F.posexplode("slices").alias("slice_no", "s"))
        .where(F.col("_whole") | (F.col("s.stop") - F.col("s.start") >= minimum))
        .select(
            key,
            "slice_no",
            F.col("s.start").alias("start"),
            F.substring(F.col(text), F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias(text),
        )
    )


def clean_subset_metric(samples: DataFrame, contaminated: DataFrame, keys: list[str], group: list[str],
                        value: str) -> DataFrame:
    """Mean of ``value`` over all rows and, with suffix ``decontaminate``, over rows whose keys are not contaminated."""
    flags = contaminated.select(*keys).distinct().withColumn("_dirty", F.lit(True))
    clean = F.when(F.col("_dirty").isNull(), F.col(value))
    return samples.join(flags, keys, "left").groupBy(*group).agg(
        F.avg(value).alias("mean"),
        F.count(value).alias("n"),
        F.avg(clean).alias("mean_decontaminate"),
        F.count(clean).alias("n_decontaminate"),
    )
