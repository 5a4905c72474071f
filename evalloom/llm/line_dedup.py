"""Line dedup by overlapping three-line windows.

Consecutive lines are hashed, windows that occur more than once anywhere are found globally, and every occurrence but the first
is removed by merging the line positions that such windows cover. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import column, fresh, table, text_key

WINDOW = 3


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per window of consecutive lines: ``doc_id, text_key, pos, w1, w2`` with a 128-bit hash of the lines.

    Lines end at a line feed. Documents of fewer lines than ``window``, and null texts, have no window.
    """
    body = column(text)
    lines = docs.select(
        column(doc_id).alias("doc_id"), text_key(body).alias("text_key"), F.split(body, "\n", -1).alias("lines")
    ).where(F.size("lines") >= window)
    hashed = lines.select(
        "doc_id", "text_key",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("b"),
    )

    def joined(array: str) -> Column:
        starts = F.sequence(F.lit(0), F.size(array) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(array, i + k) for k in range(window)]))

    pairs = F.arrays_zip(joined("a").alias("w1"), joined("b").alias("w2"))
    return hashed.select("doc_id", "text_key", F.posexplode(pairs).alias("pos", "w")).select(
        "doc_id", "text_key", "pos", "w.w1", "w.w2"
    )


def later_occurrences(windows: DataFrame) -> DataFrame:
    """Windows whose lines occurred before, in the order of id (null last), text key and position.

    The repeated hashes are found by a combining aggregate, so a window held by a third of the rows costs one row per task;
    the join back has one row per hash on one side, and Spark splits its hot partitions.
    """
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "pos")
    repeated = (
        windows.groupBy("w1", "w2")
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("w1", "w2", "_first")
    )
    return windows.join(repeated, ["w1", "w2"]).where(place > F.col("_first")).select("doc_id", "text_key", "pos")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages of ``window`` or more lines cut from ``text``, and ``n_lines``, ``n_removed_lines`` added.

    A line goes if any window covering it occurred before: in a document of smaller id (null ids come last), or earlier in
    its own. Rows with the same id and text count as one document and are treated alike, so a repeated row loses nothing to
    its twin. Null texts stay null with 0 lines; a text whose lines all go becomes empty. The work is linear in the lines of a
    text. Columns of the two added names are replaced; all others are kept, whatever their names.
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed_lines")]
    mine, key, other, other_key, starts, lines, begins, ends = fresh(
        docs.columns, "id", "key", "other_id", "other_key", "starts", "lines", "begins", "ends"
    )
    covered = (
        later_occurrences(line_windows(docs, doc_id, text, window))
        .groupBy(F.col("doc_id").alias(other), F.col("text_key").alias(other_key))
        .agg(F.sort_array(F.collect_set("pos")).alias(starts))
    )
    whole = [column(c) for c in columns]
    keyed = docs.select(*whole, column(doc_id).alias(mine), text_key(column(text)).alias(key))
    same = F.col(mine).eqNullSafe(F.col(other)) & (F.col(key) == F.col(other_key))
    at = F.col(starts)
    # covered ranges: from a start that no earlier window reaches to the end of the last window before a gap
    first = F.filter(at, lambda p, i: (i == 0) | (p > F.get(at, i - 1) + window))
    last = F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1) > p + window, F.lit(True)))
    split = F.split(column(text), "\n", -1)
    cut = keyed.join(covered, same, "left").select(
        *whole, split.alias(lines), first.alias(begins), F.transform(last, lambda p: p + window).alias(ends)
    )
    total = F.size(lines)
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.col(ends)).alias("a"), F.concat(F.col(begins), F.array(total)).alias("b")
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col(lines), g["a"] + 1, g["b"] - g["a"])))
    removed = F.aggregate(
        F.zip_with(ends, begins, lambda e, b: (e - b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
    )
    return cut.select(
        *[F.when(F.col(begins).isNull(), c).otherwise(F.array_join(kept, "\n")).alias(name) if name == text else c
          for c, name in zip(whole, columns)],
        F.when(column(text).isNull(), 0).otherwise(total).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed_lines"),
    )


SQL = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, unnest(range(0, greatest(len(l) - 2, 0))) AS pos, l FROM lines),
texts AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w FROM windows),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn FROM texts),
covered AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE rn > 1),
numbered AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM lines),
kept AS (
  SELECT n.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed_lines,
         string_agg(CASE WHEN c.pos IS NULL THEN n.line END, chr(10) ORDER BY n.pos) AS text
  FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.pos = c.pos GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed_lines, 0) AS n_removed_lines,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op3_line_dedup(spark, sf_dir):
    """Per document: its lines, the removed lines and the SHA-256 of what is left."""
    cut = dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.col("text"), 256).alias("kept_sha256"))
