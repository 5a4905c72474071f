"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample and labels every byte position; a document's
probabilities are the means over all its positions. Texts are cut into segments of fixed length, so the work per byte does not
depend on the length of a text and every byte is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.wordhash import pieces
from evalloom.llm.common import LOOKUP_ROWS, column, held_out, join_lookup, table, uniform
from evalloom.session import cut_lineage

HIDDEN = 8  # units of each direction
SEGMENT = 64  # bytes
PAD = 256  # symbol after the end of a text
DOCUMENTS = 400  # sampled of each language at most
SEGMENTS = 6  # drawn from each sampled document, anywhere in it
STEPS = 160
BATCH = 192
RATE = 0.01
LANES = 4096  # segments read side by side
UNKNOWN = "und"
SEED = 5


class Network(NamedTuple):
    """First axis of the weights: forward and backward direction."""

    table: np.ndarray  # (2, 257, 3 * hidden): input weights and biases of update, reset and candidate
    state: np.ndarray  # (2, hidden, 3 * hidden)
    out: np.ndarray  # (2 * hidden, languages)
    bias: np.ndarray  # (languages,)


def initial(languages: int, hidden: int, rng: np.random.Generator) -> Network:
    return Network(
        rng.normal(0, 0.3, (2, 257, 3 * hidden)),
        rng.normal(0, 0.5 / np.sqrt(hidden), (2, hidden, 3 * hidden)),
        rng.normal(0, 0.3, (2 * hidden, languages)),
        np.zeros(languages),
    )


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def loss_and_slopes(net: Network, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, Network]:
    """Mean log loss of all positions that are no padding, and its derivatives; ``symbols``: (sequences, length)."""
    n, length = symbols.shape
    hidden = net.state.shape[1]
    both = np.stack([symbols, symbols[:, ::-1]])  # (2, n, length), each in reading order
    states = np.zeros((length + 1, 2, n, hidden))
    saved = []
    which = np.arange(2)[:, None]
    for t in range(length):
        given = net.table[which, both[:, :, t]]
        carried = states[t] @ net.state
        gates = logistic(given[..., : 2 * hidden] + carried[..., : 2 * hidden])
        z, r = gates[..., :hidden], gates[..., hidden:]
        inner = carried[..., 2 * hidden :]
        c = np.tanh(given[..., 2 * hidden :] + r * inner)
        states[t + 1] = c + z * (states[t] - c)
        saved.append((z, r, c, inner))
    # at position p the forward state has read p + 1 symbols, the backward state length - p
    features = np.concatenate([states[1:, 0], states[:0:-1, 1]], axis=-1)  # (length, n, 2 * hidden)
    logits = features @ net.out + net.bias
    logits -= logits.max(axis=-1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=-1, keepdims=True)
    real = (symbols.T != PAD).astype(float)
    total = max(real.sum(), 1.0)
    picked = np.take_along_axis(prob, np.broadcast_to(labels[None, :, None], (length, n, 1)), axis=-1)[..., 0]
    loss = float(-(np.log(picked + 1e-12) * real).sum() / total)
    slope = prob
    slope[np.arange(length)[:, None], np.arange(n)[None, :], labels[None, :]] -= 1.0
    slope *= (real / total)[..., None]
    flat = slope.reshape(-1, slope.shape[-1])
    d_out = features.reshape(-1, 2 * hidden).T @ flat
    d_features = slope @ net.out.T
    into = np.stack([d_features[..., :hidden], d_features[::-1, :, hidden:]], axis=1)  # (length, 2, n, hidden) in reading order
    d_state = np.zeros_like(net.state)
    d_given = np.zeros((length, 2, n, 3 * hidden))
    back = np.zeros((2, n, hidden))
    for t in range(length - 1, -1, -1):
        z, r, c, inner = saved[t]
        before = states[t]
        dh = back + into[t]
        dc = dh * (1 - z) * (1 - c * c)
        d_z = dh * (before - c) * z * (1 - z)
        d_r = dc * inner * r * (1 - r)
        d_given[t] = np.concatenate([d_z, d_r, dc], axis=-1)
        d_carried = np.concatenate([d_z, d_r, dc * r], axis=-1)
        d_state += before.transpose(0, 2, 1) @ d_carried
        back = dh * z + d_carried @ net.state.transpose(0, 2, 1)
    d_table = np.zeros_like(net.table)
    for d in range(2):
        seen = np.zeros((257, n * length), dtype=np.float32)
        seen[both[d].T.reshape(-1), np.arange(n * length)] = 1.0
        d_table[d] = seen @ d_given[:, d].reshape(-1, 3 * hidden).astype(np.float32)
    return loss, Network(d_table, d_state, d_out, flat.sum(axis=0))


def train(segments: np.ndarray, labels: np.ndarray, languages: int, hidden: int = HIDDEN, steps: int = STEPS,
          seed: int = SEED) -> Network:
    """Adam over batches with equally many segments of each language."""
    rng = np.random.default_rng(seed)
    net = initial(languages, hidden, rng)
    if languages < 2:
        return net
    groups = [np.flatnonzero(labels == k) for k in range(languages)]
    first = [np.zeros_like(p) for p in net]
    second = [np.zeros_like(p) for p in net]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(g, max(1, BATCH // languages)) for g in groups])
        _, slopes = loss_and_slopes(net, segments[chosen], labels[chosen])
        size = np.sqrt(sum(float((s * s).sum()) for s in slopes))
        updated = []
        for i, (p, s) in enumerate(zip(net, slopes)):
            s = s * min(1.0, 1.0 / (size + 1e-12))
            first[i] = 0.9 * first[i] + 0.1 * s
            second[i] = 0.99 * second[i] + 0.01 * s * s
            rate = RATE * (1 - 0.9 * step / steps)
            updated.append(p - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8))
        net = Network(*updated)
    return net


def position_sums(net: Network, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums over the positions of each segment of the language probabilities; ``symbols``: (SEGMENT, lanes) in float32 speed."""
    span, lanes = symbols.shape
    hidden = net.state.shape[1]
    given = [np.ascontiguousarray(t.T, dtype=np.float32) for t in net.table]  # (3 * hidden, 257)
    weights = [np.ascontiguousarray(s.T, dtype=np.float32) for s in net.state]
    states = np.empty((2, span, hidden, lanes), dtype=np.float32)
    x, carried = np.empty((3 * hidden, lanes), np.float32), np.empty((3 * hidden, lanes), np.float32)
    for d in range(2):
        h = np.zeros((hidden, lanes), dtype=np.float32)
        for t in range(span) if d == 0 else range(span - 1, -1, -1):
            np.take(given[d], symbols[t], axis=1, out=x, mode="clip")
            np.matmul(weights[d], h, out=carried)
            gates = x[: 2 * hidden]
            gates += carried[: 2 * hidden]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1.0
            np.reciprocal(gates, out=gates)
            c = carried[2 * hidden :]
            c *= gates[hidden:]
            c += x[2 * hidden :]
            c *= 2.0  # tanh(c) = 1 - 2 / (exp(2 c) + 1)
            np.exp(c, out=c)
            c += 1.0
            np.divide(-2.0, c, out=c)
            c += 1.0
            h -= c
            h *= gates[:hidden]
            h += c
            states[d, t] = h
    out = np.ascontiguousarray(net.out.T, dtype=np.float32)
    bias = net.bias.astype(np.float32)[:, None]
    sums = np.zeros((len(bias), lanes))
    for t in range(span):
        logits = out[:, :hidden] @ states[0, t] + out[:, hidden:] @ states[1, t] + bias
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        logits *= t < length
        sums += logits
    return sums.T


def segments_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments of the texts in ``data``: document, first byte and length of each."""
    count = -(-np.diff(bounds) // SEGMENT)
    doc = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[doc] + number * SEGMENT
    return doc, start, np.minimum(SEGMENT, bounds[doc + 1] - start)


def symbols_at(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(SEGMENT, segments) symbols, padded."""
    steps = np.arange(SEGMENT)[:, None]
    at = np.minimum(start[None, :] + steps, max(0, len(data) - 1))
    return np.where(steps < length[None, :], data[at].astype(np.int16), np.int16(PAD)) if len(data) else np.full(
        (SEGMENT, len(start)), PAD, np.int16
    )


def raw_bytes(piece: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a slice from :func:`pieces`."""
    offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
    buffer = piece.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def with_letters(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, letters, text``: lower-cased text, and whether it has a letter."""
    return docs.select(
        column(doc_id).cast("long").alias("doc_id"),
        F.coalesce(column(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        F.lower(column(text)).alias("text"),
    )


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = DOCUMENTS,
          steps: int = STEPS) -> tuple[Network | None, list[str]]:
    """A network from at most ``documents`` documents of each language that are not held out, and its languages.

    Of a document at most ``SEGMENTS`` segments are drawn, so what reaches the driver is bounded whatever the texts.
    """
    keys = docs.select(
        column(doc_id).cast("long").alias("_id"), column(lang).cast("string").alias("_lang"),
        column(text).rlike(r"\p{L}").alias("_letters"),
    ).where("_id is not null and _lang is not null and _letters").drop("_letters").where(~held_out("_id"))
    keys = cut_lineage(keys)  # small rows, read twice
    # a draw below this leaves some more than `documents` rows of a language, so that its window is small however many there are
    enough = documents + 8 * documents**0.5 + 64
    counts = cut_lineage(keys.groupBy("_lang").agg(F.count("*").alias("_rows")))
    near = join_lookup(keys, counts, "_lang", F.col("_id")).where(uniform("_id", SEED) * F.col("_rows") <= enough)
    by_draw = W.partitionBy("_lang").orderBy(uniform("_id", SEED), "_id")
    drawn = near.withColumn("_n", F.row_number().over(by_draw)).where(F.col("_n") <= documents).select("_id", "_lang")
    drawn = cut_lineage(drawn.groupBy("_id").agg(F.min("_lang").alias("_lang")))  # of several labels of an id the smallest
    drawn = F.broadcast(drawn) if drawn.count() <= LOOKUP_ROWS else drawn
    bodies = docs.select(column(doc_id).cast("long").alias("doc_id"), F.lower(column(text)).alias("text"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, piece in pieces(batch.column(2)):
                data, bounds = raw_bytes(piece)
                doc, start, length = segments_of(data, bounds)
                for row in range(len(piece)):
                    mine = np.flatnonzero(doc == row)
                    key = batch.column(0)[low + row].as_py()
                    picked = np.sort(np.random.default_rng([SEED, key % 2**32]).permutation(mine)[:SEGMENTS])
                    text = symbols_at(data, start[picked], length[picked]).T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(picked), pa.int64()),
                         pa.array([batch.column(1)[low + row].as_py()] * len(picked), pa.string()),
                         pa.array([t.tobytes() for t in text], pa.binary())],
                        ["doc_id", "lang", "symbols"],
                    )

    sample = (
        bodies.join(drawn, bodies["doc_id"] == drawn["_id"])
        .where("text is not null")
        .select("doc_id", "_lang", "text")
        .mapInArrow(draw, "doc_id long, lang string, symbols binary")
    )
    rows = sorted((r["lang"], r["doc_id"], bytes(r["symbols"])) for r in sample.collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None, []
    labels = np.array([languages.index(r[0]) for r in rows])
    segments = np.stack([np.frombuffer(r[2], np.int16) for r in rows]).astype(np.int64)
    return train(segments, labels, len(languages), steps=steps), languages


def predict(docs: DataFrame, net: Network | None, languages: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row over whole texts, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((net, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = shared.value
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if net is None:
                letters[:] = False
            for low, piece in pieces(batch.column(2)):
                data, bounds = raw_bytes(piece)
                pooled = np.zeros((len(piece), max(1, len(languages))))
                if net is not None:
                    doc, start, length = segments_of(data, bounds)
                    wanted = letters[low + doc] if len(doc) else np.empty(0, bool)
                    doc, start, length = doc[wanted], start[wanted], length[wanted]
                    for a in range(0, len(doc), LANES):
                        part = slice(a, a + LANES)
                        sums = position_sums(net, symbols_at(data, start[part], length[part]), length[part])
                        np.add.at(pooled, doc[part], sums)
                share = pooled / np.maximum(np.diff(bounds), 1)[:, None]
                top, known = share.argmax(axis=1), letters[low : low + len(piece)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(piece)),
                     pa.array([languages[t] if k else UNKNOWN for t, k in zip(top, known)], pa.string()),
                     pa.array(np.where(known, np.round(np.clip(share.max(axis=1), 0, 1), 6), 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    return with_letters(docs, doc_id, text).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; the score is the mean probability of the predicted language.

    One row per input row, repeated rows included. Texts that are null or have no letter are ``und`` with score 0, and so is every
    text when no language can be learned. Rows with a null id or language are predicted, not learned from. Languages that tie
    go to the first by name. Only the named columns are read, so other columns may have any name.
    """
    net, languages = learn(docs, doc_id, text, lang, **options)
    found = predict(docs, net, languages, doc_id, text)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
