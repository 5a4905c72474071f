"""Byte tokens, special tokens, loss masks and padding."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import col, let

# The published range of special ids, and the names this package gives to the three it needs.
FIRST_SPECIAL = 199998
LAST_SPECIAL = 200018
N_BYTES = 256
SPECIAL_IDS = {"<|startoftext|>": 199998, "<|endoftext|>": 199999, "<|return|>": 200002}
COMPACT_VOCABULARY = N_BYTES + LAST_SPECIAL - FIRST_SPECIAL + 1


@F.arrow_udf(T.ArrayType(T.ByteType()))
def signed_bytes(payload: pa.Array) -> pa.Array:
    """Bytes of each value as signed bytes: the same buffer, so that a batch takes no more memory than its text."""
    payload = payload.cast(pa.large_binary())
    nulls = payload.is_null() if payload.null_count else None
    bounds = np.frombuffer(payload.buffers()[1], dtype=np.int64)[payload.offset : payload.offset + len(payload) + 1]
    body = payload.buffers()[2]
    raw = np.frombuffer(body, dtype=np.int8)[bounds[0] : bounds[-1]] if body is not None else np.empty(0, np.int8)
    offsets = pa.array((bounds - bounds[0]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(raw), mask=nulls)


def byte_tokens(text: Column | str) -> Column:
    """UTF-8 bytes of the text as token ids 0..255."""
    return F.transform(signed_bytes(F.encode(col(text), "UTF-8")), lambda x: x.cast("int").bitwiseAND(255))


def parsed_tokens(text: Column | str) -> Column:
    """Like ``byte_tokens``, but special-token strings inside the text become their ids; null stays null.

    The text is split at the names, so whatever else it holds is kept byte by byte.
    """
    names = "|".join(name.replace("|", "\\|") for name in SPECIAL_IDS)
    ids = F.create_map(*[F.lit(v) for pair in SPECIAL_IDS.items() for v in pair])

    special = lambda f: F.coalesce(F.lpad(F.hex(F.try_element_at(ids, f)), 6, "0"), F.lit(""))
    plain = lambda p: F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "0000$1")
    between = F.split(col(text), names, -1)
    found = F.regexp_extract_all(col(text), F.lit(f"({names})"), F.lit(1))
    # the piece after the last name has none; zip_with fills in a null there
    hexed = F.zip_with(between, found, lambda p, f: F.concat(plain(p), special(f)))
    return wide_ids(F.unhex(F.array_join(hexed, "")))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def wide_ids(payload: pa.Array) -> pa.Array:
    """Three-byte big-endian codes of each value as integers."""
    payload = payload.cast(pa.large_binary())
    nulls = payload.is_null() if payload.null_count else None
    bounds = np.frombuffer(payload.buffers()[1], dtype=np.int64)[payload.offset : payload.offset + len(payload) + 1]
    body = payload.buffers()[2]
    raw = np.frombuffer(body, dtype=np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.empty(0, np.uint8)
    wide = raw.reshape(-1, 3).astype(np.int32)
    ids = (wide[:, 0] << 16) | (wide[:, 1] << 8) | wide[:, 2]
    return pa.ListArray.from_arrays(pa.array(((bounds - bounds[0]) // 3).astype(np.int32)), pa.array(ids), mask=nulls)


def wrap(tokens: Column, first: str = "<|startoftext|>", last: str = "<|return|>") -> Column:
    """Document tokens between its begin and end ids."""
    return F.concat(F.array(F.lit(SPECIAL_IDS[first])), tokens, F.array(F.lit(SPECIAL_IDS[last])))


def compact(tokens: Column) -> Column:
    """Move the special ids next to the bytes, so that the vocabulary has 277 entries."""
    return F.transform(
        tokens, lambda x: F.when(x >= FIRST_SPECIAL, x - (FIRST_SPECIAL - N_BYTES)).otherwise(x)
    )


def wrapped_length(text: Column | str) -> Column:
    """Token count of the wrapped document, without building the tokens."""
    return (F.octet_length(col(text)) + 2).cast("long")


def pad(tokens: Column, length: int, token: int = SPECIAL_IDS["<|endoftext|>"]) -> Column:
    """Fill up to ``length``; longer rows are an error, never cut."""
    short = F.greatest(F.lit(0), F.lit(length) - F.size(tokens))
    fits = F.assert_true(F.size(tokens) <= length, f"row longer than {length} tokens")
    return F.when(fits.isNull(), F.concat(tokens, F.array_repeat(F.lit(token), short)))


def context_mask(tokens: Column, real_length: Column, marker: int = ord("=")) -> Column:
    """1 up to and including the first ``marker`` and on the padding, 0 on the answer."""
    return let(
        F.struct(tokens.alias("t"), F.array_position(tokens, F.lit(marker)).alias("p"), real_length.alias("n")),
        lambda s: F.transform(
            s["t"], lambda _, i: F.when((i < s["p"]) | (i >= s["n"]), 1).otherwise(0).cast("tinyint")
        ),
    )
