"""Language ID by prediction with partial matching.

Each language has a tree of byte contexts up to ORDER bytes long, frozen after training: how often each byte followed
each context. A byte is coded by its longest known context; where the byte is new there, an escape (weighted by the
number of different bytes seen, "method C") is paid and the next shorter context is tried, down to a uniform byte. A
text is coded in lower case, with one space before each word and ORDER spaces more before the first; contexts reach
across words. The code length of a text is the exact sum over its bytes, and the language with the shortest code wins.
A word's bytes from the ORDER-th on depend on the word alone and are coded once for each distinct word of a batch; the
bytes before, once for each distinct pair of what precedes a word and how it begins.

Trained on at most TRAIN_ROWS documents of at most TRAIN_BYTES of each of the LANGUAGES most frequent languages (a
documented sample, picked by a hash of the id) that are not held out; scoring covers every row and whole texts. The trees'
size is bounded by the sample.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language first in order;
repeated rows get equal results; without training rows every text is ``und``; columns of the input other than id, text and
lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, held_out, slices, words_of
from .pretokens import expand

TRAIN_ROWS, TRAIN_BYTES, LANGUAGES, ORDER = 500, 1 << 16, 256, 4
UNKNOWN = "und"


@dataclass(frozen=True)
class Trees:
    """Of each order: coded (context, byte) keys with their bits by language, and contexts with their escape bits."""

    languages: tuple[str, ...]
    keys: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]


def _framed(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words, each after a space; where each begins, and the end)."""
    raw = distinct.cast(pa.large_binary()).to_pylist()
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in raw), np.int64, len(raw)))
    return np.frombuffer(b"".join(b" %b" % w for w in raw), np.uint8), np.concatenate([[0], ends]).astype(np.int64)


def _stream(codes: np.ndarray, offsets: np.ndarray, framed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the texts one after the other, each after ORDER spaces; where each word's space stands)."""
    framed = np.concatenate([framed, np.full(ORDER, 32, np.uint8)])
    starts, sizes = np.append(bounds[:-1], bounds[-1]), np.append(np.diff(bounds), ORDER)
    at, ends = expand(np.insert(codes, offsets[:-1], len(bounds) - 1), starts, sizes)
    heads = np.arange(len(codes)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    return framed[at], ends[heads]


def _keys(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For the bytes at ``at``: the byte and the k bytes before it, for each order k."""
    keys, key = [], np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        key = key | raw[at - k].astype(np.uint64) << np.uint64(8 * k)
        keys.append(key)
    return keys


def _rows(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each wanted key, whether it is there)."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def train(texts_by_language: dict[str, list[str]]) -> Trees:
    languages = tuple(sorted(texts_by_language))
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for name in languages:
        codes, offsets, distinct = words_of(pc.utf8_lower(pa.array(texts_by_language[name], pa.large_string())))
        framed, bounds = _framed(distinct)
        raw, heads = _stream(codes, offsets, framed, bounds)
        sizes = np.diff(bounds)[codes]
        coded = np.repeat(heads - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())  # all but the spaces before texts
        counted.append([np.unique(key, return_counts=True) for key in _keys(raw, coded)])
    all_keys, all_bits, all_contexts, all_escapes = [], [], [], []
    n = len(languages)
    for k in range(ORDER + 1):
        per = [c[k] for c in counted]
        keys = np.unique(np.concatenate([p[0] for p in per] or [np.empty(0, np.uint64)]))
        contexts = np.unique(keys >> np.uint64(8)) if k else np.zeros(min(1, len(keys)), np.uint64)
        of_key, _ = _rows(contexts, keys >> np.uint64(8) if k else np.zeros(len(keys), np.uint64))
        counts = np.zeros((len(keys), n))
        for i, (found, c) in enumerate(per):
            counts[np.searchsorted(keys, found), i] = c
        totals, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
        np.add.at(totals, of_key, counts)
        np.add.at(kinds, of_key, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(totals > 0, np.log2((totals + kinds) / kinds), 0.0)
            seen = np.log2((totals + kinds)[of_key] / counts)
        if k:
            shorter, _ = _rows(all_keys[-1], keys & np.uint64((1 << 8 * k) - 1))
            lower = all_bits[-1][shorter] if len(keys) else np.zeros((0, n))
        else:
            lower = np.full((len(keys), n), 8.0)
        all_bits.append(np.where(counts > 0, seen, escapes[of_key] + lower))
        all_keys.append(keys)
        all_contexts.append(contexts)
        all_escapes.append(escapes)
    small = [tuple(x.astype(np.float32) for x in xs) for xs in (all_bits, all_escapes)]
    return Trees(languages, tuple(all_keys), small[0], tuple(all_contexts), small[1])


def coded_bits(keys: list[np.ndarray], trees: Trees) -> np.ndarray:
    """Code length in each language of bytes given by their keys of every order."""
    bits = np.zeros((len(keys[0]), len(trees.languages)))
    open_ = np.arange(len(keys[0]))
    for k in range(ORDER, -1, -1):
        at, there = _rows(trees.keys[k], keys[k][open_])
        bits[open_[there]] += trees.bits[k][at[there]]
        open_ = open_[~there]
        context = keys[k][open_] >> np.uint64(8) if k else np.zeros(len(open_), np.uint64)
        at, there = _rows(trees.contexts[k], context)
        bits[open_[there]] += trees.escapes[k][at[there]]
    bits[open_] += 8.0
    return bits


def text_bits(codes: np.ndarray, offsets: np.ndarray, distinct: pa.Array, trees: Trees) -> np.ndarray:
    """Code length of each text in each language."""
    n = len(trees.languages)
    if not len(codes):
        return np.zeros((len(offsets) - 1, n))
    framed, bounds = _framed(distinct)
    raw, heads = _stream(codes, offsets, framed, bounds)
    # bytes of a word from the ORDER-th on
    sizes = np.diff(bounds)
    inner = np.maximum(sizes - ORDER, 0)
    word, at = np.repeat(np.arange(len(sizes)), inner), np.repeat(bounds[:-1] + ORDER - np.cumsum(inner) + inner, inner) + np.arange(inner.sum())
    bits = coded_bits(_keys(framed, at), trees)
    tails = np.stack([np.bincount(word, weights=bits[:, i], minlength=len(sizes)) for i in range(n)], axis=1)
    # the bytes before: what precedes a word and how it begins, packed into one number
    size = sizes[codes]
    packed, raw = np.zeros(len(codes), np.uint64), np.concatenate([raw, np.zeros(ORDER, np.uint8)])
    for k in range(2 * ORDER):
        byte = raw[heads - ORDER + k].astype(np.uint64)
        packed |= (byte if k <= ORDER else np.where(size > k - ORDER, byte, np.uint64(0))) << np.uint64(8 * (2 * ORDER - 1 - k))
    beginnings, which, of = np.unique(packed, return_index=True, return_inverse=True)
    starts = np.zeros((len(beginnings), n))
    for k in range(ORDER):
        has = np.flatnonzero(size[which] > k)
        starts[has] += coded_bits(_keys(raw, heads[which[has]] + k), trees)
    total = tails[codes] + starts[of]
    return np.stack([np.diff(np.concatenate([[0.0], np.cumsum(total[:, i])])[offsets]) for i in range(n)], axis=1)


def predict(texts: pa.Array, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, its share of the probability) of each text."""
    best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for start, stop in slices(texts):
        sums = text_bits(*words_of(pc.utf8_lower(pc.fill_null(texts.slice(start, stop - start).cast(pa.large_string()), ""))), trees)
        low = sums.argmin(axis=1)
        least = sums[np.arange(len(low)), low]
        best[start:stop] = low
        share[start:stop] = 1 / np.exp2(-np.minimum(sums - least[:, None], 1000)).sum(axis=1)
    return best, share


def language_column(text: Column, trees: Trees) -> Column:
    """Struct (lang_pred, score)."""
    schema = "lang_pred string, score double"
    if not trees.languages:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = pa.array(trees.languages, pa.string())

    def found(texts: pa.Array) -> pa.Array:
        best, share = predict(texts, trees)
        return pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(np.round(share, 6))], names=["lang_pred", "score"])

    got, lettered = F.arrow_udf(found, schema)(text), F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.struct(F.when(lettered, got["lang_pred"]).otherwise(UNKNOWN).alias("lang_pred"), F.when(lettered, got["score"]).otherwise(0.0).alias("score"))


def fit(documents: DataFrame, rows: int = TRAIN_ROWS, languages: int = LANGUAGES) -> Trees:
    """Trees from at most ``rows`` documents of each language that are not held out.

    Ids are thinned by their hashes to about twice that number before any window, and texts are fetched for those chosen.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select("doc_id", "lang", F.col("text").cast("string").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("__of")).orderBy(F.desc("__of"), "lang").limit(languages)
    thinned = usable.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(2.0 * rows * (1 << 40)) / F.col("__of"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = thinned.select("doc_id", "lang").distinct().withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= rows).select("doc_id", "lang")
    # at most rows x languages ids are broadcast, and as many texts collected
    got = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", F.xxhash64("doc_id"), "doc_id").select("lang", "text").toArrow()
    texts: dict[str, list[str]] = {}
    for lang, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    del got
    trees = train(texts)
    del texts
    give_back()
    return trees


def identify(documents: DataFrame, trees: Trees) -> DataFrame:
    got = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_column(F.col("text"), trees).alias("__l"))
    return got.select("doc_id", "held_out", "__l.lang_pred", "__l.score")
