"""Packing of token streams into fixed blocks, shard assignment and document splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import stable_hash
from evalloom.operators.scale import running_start


def flat_pieces(docs: DataFrame, tokens: str | Column, length: Column, block_size: int, key: str = "doc_id") -> DataFrame:
    """What each document gives to each block of the concatenation in key order: ``block_id, at, piece``.

    Offsets are two-level running sums of lengths; then each document is cut locally. ``tokens`` given as an expression over ``docs`` are made
    after the documents got their offsets, so that only what they are made of is shuffled.
    """
    placed = running_start(docs.withColumn("_len", length.cast("long")), key, F.col("_len"), "_at")
    placed = placed.select("_at", "_len", (F.col(tokens) if isinstance(tokens, str) else tokens).alias("_tokens"))
    first = F.floor(F.col("_at") / block_size)
    last = F.floor((F.col("_at") + F.col("_len") - 1) / block_size)
    pieces = placed.where("_len > 0").withColumn("block_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("block_id") * block_size - F.col("_at"))
    stop = F.least(F.col("_len"), (F.col("block_id") + 1) * block_size - F.col("_at"))
    piece = F.slice(F.col("_tokens"), (begin + 1).cast("int"), (stop - begin).cast("int"))
    return pieces.select("block_id", (F.col("_at") + begin).alias("at"), piece.alias("piece"))


def pack_flat(docs: DataFrame, tokens: str | Column, length: Column, block_size: int, key: str = "doc_id") -> DataFrame:
    """Concatenate documents in key order and cut every ``block_size`` tokens: ``block_id, tokens``. Only the pieces of one block meet."""
    return joined_pieces(flat_pieces(docs, tokens, length, block_size, key), ["block_id"])


def joined_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks from the pieces of :func:`flat_pieces`: ``keys..., tokens``."""
    return (
        pieces.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
        .select(*keys, F.flatten("pieces.piece").alias("tokens"))
    )


def pack_shards(docs: DataFrame, tokens: str | Column, length: Column, block_size: int, blocks_per_shard: int, val_blocks: int,
                key: str = "doc_id") -> DataFrame:
    """Blocks of :func:`pack_flat` with the names of :func:`assign_shards`: ``split, shard, block_id, tokens``.

    Pieces are dealt by shard, a bounded run of blocks, so blocks are put together where their shard is written.
    """
    pieces = assign_shards(flat_pieces(docs, tokens, length, block_size, key), blocks_per_shard, val_blocks)
    return joined_pieces(pieces.repartition("split", "shard"), ["split", "shard", "block_id"])


FRAGMENTS = "shard long, doc_id long, block_no long, at int, start int, length int"


def fit_or_cut(docs: DataFrame, length: Column, block_size: int, threshold: int, shard_width: int = 1024,
               key: str = "doc_id") -> DataFrame:
    """Place documents into blocks shard by shard: ``shard, doc_id, block_no, at, start, length``.

    A document that overflows its block is cut there, unless the part that fits or the part left over is shorter than
    ``threshold``: then the block stays padded and the document opens the next one. The rule is sequential, so a
    shard (``shard_width`` consecutive keys, hence bounded) is walked by one task; only lengths travel, never text.
    """
    lengths = docs.select(
        F.floor(F.col(key) / shard_width).cast("long").alias("shard"),
        F.col(key).cast("long").alias("doc_id"),
        length.cast("long").alias("n"),
    )

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        block, used, out = 0, 0, []
        for shard, doc, n in rows.itertuples(index=False):
            room = block_size - used
            if used and n > room and min(room, n - room) < threshold:
                block, used = block + 1, 0
            done = 0
            while done < n:
                part = min(block_size - used, n - done)
                out.append((shard, doc, block, used, done, part))
                done, used = done + part, used + part
                if used == block_size:
                    block, used = block + 1, 0
        return pd.DataFrame(out, columns=["shard", "doc_id", "block_no", "at", "start", "length"])

    return lengths.groupBy("shard").applyInPandas(place, FRAGMENTS)


def cut_fragments(docs: DataFrame, fragments: DataFrame, tokens: str, block_size: int, pad_token: int,
                  key: str = "doc_id") -> DataFrame:
    """Blocks of exactly ``block_size`` tokens from a fragment plan: ``shard, block_no, tokens``."""
    pieces = fragments.join(docs.select(F.col(key).alias("doc_id"), tokens), "doc_id").select(
        "shard", "block_no", F.struct("at", F.slice(F.col(tokens), F.col("start") + 1, F.col("length")).alias("p")).alias("f")
    )
    joined = pieces.groupBy("shard", "block_no").agg(F.flatten(F.array_sort(F.collect_list("f"))["p"]).alias("tokens"))
    short = F.lit(block_size) - F.size("tokens")
    return joined.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(pad_token), short)))


def split_documents(docs: DataFrame, key: str = "doc_id", parts: int = 2000, held_out: int = 1, seed: int = 1337) -> DataFrame:
    """Add ``split``: validation for ``held_out`` of ``parts`` hash classes of the key, else train."""
    drawn = F.pmod(stable_hash(F.lit(seed), key), F.lit(parts)) < held_out
    return docs.withColumn("split", F.when(drawn, "val").otherwise("train"))


def assign_shards(blocks: DataFrame, blocks_per_shard: int, val_blocks: int) -> DataFrame:
    """Name shards over the block sequence: the first ``val_blocks`` are ``val_000000``, then ``train_000001`` on."""
    number = F.floor((F.col("block_id") - val_blocks) / blocks_per_shard) + 1
    is_val = F.col("block_id") < val_blocks
    return blocks.withColumn("split", F.when(is_val, "val").otherwise("train")).withColumn(
        "shard", F.concat_ws("_", "split", F.when(is_val, "000000").otherwise(F.lpad(number.cast("string"), 6, "0")))
    )


def held_out_lengths(lengths_csv: Column, longest_train: Column) -> Column:
    """Distinct sorted held-out lengths; each must exceed the longest training length."""
    parsed = F.array_sort(F.array_distinct(F.transform(F.split(lengths_csv, ","), lambda x: F.trim(x).cast("int"))))
    ok = F.assert_true(F.forall(parsed, lambda n: n > longest_train), "held-out length inside the training range")
    return F.when(ok.isNull(), parsed)
