"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned vectors of its hash and of its hashed character n-grams; a document's vector is
the mean over its words, and over one marker for each word that repeats the word before it. A softmax over the two
classes follows. Vectors and weights are learned by STEPS steps of numpy stochastic gradient descent, whatever the number
of rows, on at most TRAIN_ROWS labelled rows of at most TRAIN_BYTES each (a documented sample, picked by a hash of the
id); n-grams are made for one step's rows at a time. Scoring covers every row and whole texts.

As the output is linear in the mean, each hash bucket's share of the log-odds is one number, and that is all the
executors get (BUCKETS floats).

Defined cases: null and empty texts get the bias alone; repeated rows get equal scores; a score of exactly 0.5 counts as
1; an id with several labels counts with the least; a table without labelled rows gives the constant score 0.5; columns
of the input other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, held_out, mix, slices, words_of
from .pretokens import expand

TRAIN_ROWS, TRAIN_BYTES = 4096, 1 << 16
BUCKETS, DIM, STEPS, RATE, BATCH, SEED = 1 << 17, 8, 384, 2.0, 16, 7
NGRAMS = (3, 4, 5)


@dataclass(frozen=True)
class Model:
    """Log-odds of class 1 by bucket (the last one is the marker of a repeated word), and the bias."""

    weights: np.ndarray
    bias: float


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(buckets - 1)).astype(np.int32)


def subwords(distinct: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) pairs: for each word its own hash and those of the n-grams of ``<word>``."""
    n = len(distinct)
    if n == 0:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    framed = pc.binary_join_element_wise(pa.scalar(b"<", pa.large_binary()), distinct.cast(pa.large_binary()), pa.scalar(b">", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    lengths = np.asarray(pc.binary_length(framed)).astype(np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(framed.to_pylist()), dtype=np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(n, dtype=np.int32), lengths)
    left = (np.repeat(ends, lengths) - np.arange(len(raw))).astype(np.int32)
    base = np.uint64(0x100000001B3)
    # a word's own hash: the sum of its bytes, each mixed with its place
    place = (lengths.repeat(lengths) - left).astype(np.uint64)
    own = np.add.reduceat(mix(raw + place * np.uint64(257) + np.uint64(1)), ends - lengths)
    del place
    index, out = [np.arange(n, dtype=np.int32)], [_bucket(own, buckets)]
    for size in NGRAMS:
        if len(raw) < size:
            continue
        h = np.full(len(raw) - size + 1, np.uint64(size))
        for k in range(size):
            h = h * base + raw[k : len(raw) - size + 1 + k]
        fits = left[: len(h)] >= size
        index.append(word[: len(h)][fits])
        out.append(_bucket(h[fits], buckets))
    return np.concatenate(index), np.concatenate(out)


def _repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row, the words that equal the word before them."""
    same = np.zeros(len(codes) + 1, dtype=np.int64)
    if len(codes) > 1:
        same[1:-1] = codes[1:] == codes[:-1]
    same[offsets[:-1][offsets[:-1] < len(codes)]] = 0
    total = np.concatenate([[0], np.cumsum(same[:-1])])
    return total[offsets[1:]] - total[offsets[:-1]]


def shares(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, share) of every feature of the texts; a row's shares add up to 1, unless it has no words."""
    codes, offsets, distinct = words_of(pa.array(texts, pa.string()))
    index, bucket = subwords(distinct, buckets)
    order = np.argsort(index, kind="stable")
    bucket, starts = bucket[order], np.searchsorted(index[order], np.arange(len(distinct) + 1, dtype=np.int32))
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    used, times = np.unique(row * max(1, len(distinct)) + codes, return_counts=True)
    row, word = np.divmod(used, max(1, len(distinct)))
    repeats = _repeats(codes, offsets)
    total = np.maximum(np.diff(offsets) + repeats, 1)
    n = np.diff(starts)[word]
    at, _ = expand(word, starts[:-1], np.diff(starts))
    marked = np.flatnonzero(repeats)
    rows = np.concatenate([np.repeat(row, n), marked])
    return rows, np.concatenate([bucket[at], np.full(len(marked), buckets - 1)]), np.concatenate([np.repeat(times / n, n), repeats[marked]]) / total[rows]


@dataclass
class Weights:
    """What is learned: vectors of the buckets, and the difference of the two classes' softmax rows."""

    vectors: np.ndarray
    out: np.ndarray
    bias: float = 0.0


def loss_and_gradient(w: Weights, rows: np.ndarray, ids: np.ndarray, where: np.ndarray, share: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Mean cross-entropy of a batch, and its derivatives by the vectors of ``ids``, by ``out`` and by the bias."""
    local = w.vectors[ids]
    docs = np.stack([np.bincount(rows, weights=share * local[where, d], minlength=len(y)) for d in range(local.shape[1])], axis=1)
    logit = docs @ w.out + w.bias
    error = (1 / (1 + np.exp(-logit)) - y) / len(y)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    return loss, np.outer(np.bincount(where, weights=share * error[rows], minlength=len(ids)), w.out), docs.T @ error, float(error.sum())


def train(texts: list[str | None], labels: list[int], buckets: int = BUCKETS, steps: int = STEPS) -> Model:
    """Gradient descent over shuffled batches, with a rate that falls to zero."""
    if not texts:
        return Model(np.zeros(buckets), 0.0)
    y = np.asarray(labels, dtype=np.float64)
    rng = np.random.default_rng(SEED)
    w = Weights((rng.random((buckets, DIM)) - 0.5) / DIM, rng.standard_normal(DIM) * 1e-3)
    shuffled: np.ndarray = rng.permutation(len(y))
    for step in range(steps):
        if len(shuffled) < min(BATCH, len(y)):
            shuffled = np.concatenate([shuffled, rng.permutation(len(y))])
        chosen, shuffled = shuffled[:BATCH], shuffled[BATCH:]
        row, bucket, share = shares([texts[i] for i in chosen], buckets)
        ids, where = np.unique(bucket, return_inverse=True)
        _, by_vectors, by_out, by_bias = loss_and_gradient(w, row, ids, where, share, y[chosen])
        rate = RATE * (1 - step / steps)
        w.vectors[ids] -= rate * len(chosen) * by_vectors
        w.out -= rate * 4 * by_out
        w.bias -= rate * 0.2 * by_bias
    return Model((w.vectors @ w.out).astype(np.float32), float(w.bias))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.empty(len(texts))
    for start, stop in slices(texts):
        codes, offsets, distinct = words_of(texts.slice(start, stop - start))
        index, bucket = subwords(distinct, len(model.weights))
        n = np.bincount(index, minlength=len(distinct))
        word = np.bincount(index, weights=model.weights[bucket], minlength=len(distinct)) / np.maximum(n, 1)
        total = np.concatenate([[0.0], np.cumsum(word[codes])])
        repeats = _repeats(codes, offsets)
        tokens = np.diff(offsets) + repeats
        logit = (total[offsets[1:]] - total[offsets[:-1]] + repeats * model.weights[-1]) / np.maximum(tokens, 1) + model.bias
        out[start:stop] = np.round(1 / (1 + np.exp(-np.clip(logit, -500, 500))), 9)
    return out


def score_column(text: Column, model: Model) -> Column:
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts, model), pa.float64())

    return F.arrow_udf(scored, "double")(text)


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model learned from at most ``rows`` labelled rows, of at most TRAIN_BYTES each, that are not held out."""
    bounded_batches(documents.sparkSession)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min(label_col).alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` rows are broadcast and collected
    short = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    got = short.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "__label").toArrow()
    model = train(got.column(0).to_pylist(), got.column(1).to_pylist())
    give_back()
    return model


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
