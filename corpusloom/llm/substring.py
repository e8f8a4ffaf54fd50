"""Substring dedup by recompression: words of passages that an earlier document already has are removed.

A passage is a window of ``width`` consecutive words. Rounds of naming, inside each task, turn a document's words into ever longer symbols:
a symbol's hash says whether it is a left or a right one, and each left symbol that stands before a right one is joined
with it under a name that is a hash of the two; runs of one symbol are named by symbol and length. Names are the same in
every document, so no round needs a shuffle. With each symbol goes the stretch of words that its forming depended on:
inside that stretch, equal words give equal symbols. A window's anchor is the longest symbol (of three words or more;
then the greatest name) whose stretch lies inside the window; a window without one is its own anchor. Equal windows
therefore have equal anchors.

1. Whole texts that occur again are found by digest and settled at once (only digests and ids are shuffled).
2. The distinct anchors of the other documents are counted by document; those in two documents or more go into a
   blocked Bloom filter of at most 32 MB.
3. Windows whose anchor may be shared are verified by a 96-bit hash of their words: the least document of each window,
   joined back. Both sides are aggregated before the shuffle, and the join can split frequent windows.
4. Words covered by a window that an earlier document has are taken out.

If more symbols are shared than the filter holds, it lets more windows through to the verification; the result stays the
same.

Defined cases: null text has no words; documents of fewer words than a window lose nothing; rows that repeat an id do
not count as earlier or later than one another, and each loses words by its own text; a row without id neither loses
words nor makes others lose any; other columns are kept, but for input columns named n_words and n_removed, which the
result replaces; names that start with ``__`` are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import bounded_batches, cut, cut_counted, mix, slices, windows_hash, word_hashes, words_of

WIDTH, ROUNDS, LEAST_SPAN = 13, 4, 3
_ALL = (1 << 64) - 1
_FAR = 1 << 20
SLICE = 700_000


def symbols(words: np.ndarray, row: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(name, first word, word after the last, start and end of the stretch it depends on) of all symbols formed."""
    name, first, lo, r = words, np.arange(len(words)), np.arange(len(words)), row
    last, hi = first + 1, lo + 1
    pool: list[tuple[np.ndarray, ...]] = []
    for k in range(rounds):
        n = len(name)
        if n < 2:
            break
        next_in = np.append(r[1:] == r[:-1], False)  # the next symbol is in the same document
        before_in = np.append(False, next_in[:-1])
        after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        # runs of one symbol
        same = next_in & (name == name[after])
        if same.any():
            heads = np.flatnonzero(same & ~(before_in & (name == name[before])))
            tails = np.flatnonzero(~same & before_in & (name == name[before]))
            times = (tails - heads + 1).astype(np.uint64)
            start = np.where(before_in[heads], lo[before[heads]], lo[heads] - _FAR)
            end = np.where(next_in[tails], hi[after[tails]], hi[tails] + _FAR)
            pool.append((mix(name[heads] + times * np.uint64(0xD6E8FEB86659FD93)), first[heads], last[tails], np.minimum(start, lo[heads]), np.maximum(end, hi[tails])))
        # left and right symbols
        left = (mix(name + np.uint64(k * 0x9E3779B97F4A7C15 + 1 & _ALL)) >> np.uint64(63)).astype(bool)
        pair = left & next_in & ~left[after]
        second = np.append(False, pair[:-1])
        alone = ~pair & ~second
        # a left symbol stays alone because of what follows it, a right one because of what stands before it
        lone_left, lone_right = alone & left, alone & ~left
        new_lo, new_hi = lo.copy(), hi.copy()
        new_hi[lone_left] = np.where(next_in, np.maximum(hi, hi[after]), hi + _FAR)[lone_left]
        new_lo[lone_left] = np.where(next_in, np.minimum(lo, lo[after]), lo)[lone_left]
        new_lo[lone_right] = np.where(before_in, np.minimum(lo, lo[before]), lo - _FAR)[lone_right]
        new_hi[lone_right] = np.where(before_in, np.maximum(hi, hi[before]), hi)[lone_right]
        at = np.flatnonzero(pair)
        new_lo[at], new_hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        new_name, new_last = name.copy(), last.copy()
        new_name[at], new_last[at] = mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + mix(name[at + 1])), last[at + 1]
        pool.append((new_name[at], first[at], new_last[at], new_lo[at], new_hi[at]))
        keep = ~second
        name, first, last, lo, hi, r = new_name[keep], first[keep], new_last[keep], new_lo[keep], new_hi[keep], r[keep]
    if not pool:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*pool, strict=True))


def anchors(words: np.ndarray, row: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of every window, its anchor, its hash): windows of ``width`` words within one document."""
    n = len(words)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    starts = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    own = windows_hash(words, width)[starts]
    name, first, last, lo, hi = symbols(words, row)
    span = last - first
    use = (span >= LEAST_SPAN) & (hi - lo <= width)
    rank = span[use].astype(np.uint64) << np.uint64(58) | name[use] >> np.uint64(6)
    lo, hi = lo[use], hi[use]
    best = np.zeros(n, np.uint64)
    for back in range(width):  # the windows that begin ``back`` words before the stretch
        start = lo - back
        fits = (start >= 0) & (start + width >= hi)
        np.maximum.at(best, start[fits], rank[fits])
    best = best[starts]
    return starts, np.where(best > 0, mix(best), own), own


def _docs(batch: pa.RecordBatch, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, offsets, distinct = words_of(batch.column("text").slice(start, stop - start))
    words = word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    return words, np.repeat(np.arange(stop - start), np.diff(offsets)), offsets


def shared_anchors(docs: DataFrame, width: int) -> DataFrame:
    """(anchor) of windows in documents of two ids or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE):
                words, row, _ = _docs(batch, start, stop)
                first, anchor, _ = anchors(words, row, width)
                doc = np.asarray(batch.column("doc_id").slice(start, stop - start))[row[first]] if len(first) else first
                new = np.ones(len(first), bool)  # windows side by side mostly share their anchor
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(doc[new])], names=["anchor", "doc_id"])

    found = docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")
    counted = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return counted.filter("low < high").select("anchor")


def candidate_windows(docs: DataFrame, blocks: np.ndarray, width: int) -> DataFrame:
    """(k1, k2, doc_id, variant, start) of windows whose anchor may be shared."""
    held = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE):
                words, row, offsets = _docs(batch, start, stop)
                first, anchor, own = anchors(words, row, width)
                maybe = bloom.may_hold(held.value, anchor)
                first, own = first[maybe], own[maybe]
                more = windows_hash(words, width, seed=1)[first] if len(first) else own
                doc = row[first] if len(first) else first
                ids, variants = (batch.column(c).slice(start, stop - start).take(pa.array(doc)) for c in ("doc_id", "variant"))
                arrays = [pa.array(own.view(np.int64)), pa.array((more >> np.uint64(32)).astype(np.uint32).view(np.int32)), ids, variants, pa.array((first - offsets[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "doc_id", "variant", "start"])

    return docs.select("doc_id", "variant", "text").mapInArrow(run, "k1 long, k2 int, doc_id long, variant long, start int")


def _kept(text: Column, starts: Column, width: int) -> Column:
    """Struct (n_words, n_removed, kept): the words not covered by a window that begins at one of ``starts``."""

    def run(texts: pa.Array, covered: pa.Array) -> pa.Array:
        total, removed, out = [], [], []
        for raw, at in zip(texts.cast(pa.large_binary()), covered, strict=True):
            words = (raw.as_py() or b"").split()
            total.append(len(words))
            if at.is_valid and len(at.values):
                change = np.zeros(len(words) + 1, np.int64)
                begin = np.asarray(at.values).astype(np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            removed.append(total[-1] - len(words))
            out.append(b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["n_words", "n_removed", "kept"])

    return F.arrow_udf(run, "n_words long, n_removed long, kept string")(text, starts)


def remove_repeats(documents: DataFrame, width: int = WIDTH, keep_layout: bool = False) -> DataFrame:
    """``documents`` (doc_id, text and others) with text cut down to the kept words, n_words and n_removed.

    Kept words are joined by single spaces; with ``keep_layout`` a text that loses no word stays as it is.
    """
    bounded_batches(documents.sparkSession)
    own = ("n_words", "n_removed")
    docs = documents.drop(*own).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    columns = docs.columns
    docs = docs.withColumn("__variant", F.xxhash64("text")).withColumn("__key", F.concat_ws(":", "doc_id", F.md5("text")))
    # 1. whole texts
    digests = docs.filter("doc_id IS NOT NULL").select(F.md5("text").alias("digest"), "doc_id")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    copies, n_copies = cut_counted(digests.join(firsts, "digest").filter("doc_id > low").select(F.concat_ws(":", "doc_id", "digest").alias("__key")).distinct())
    log2 = bloom.log2_blocks(n_copies)
    probed = bloom.probe(docs, "__key", bloom.build(copies, "__key", log2), log2, "__maybe")
    judged = cut(probed.filter("__maybe").drop("__maybe").join(copies.withColumn("__copy", F.lit(True)), "__key", "left"))
    whole = judged.filter("__copy").drop("__copy")
    rest = probed.filter("NOT __maybe").drop("__maybe").unionByName(judged.filter("__copy IS NULL").drop("__copy"))
    # 2. anchors
    usable = rest.filter("doc_id IS NOT NULL")
    shared, n_shared = cut_counted(shared_anchors(usable, width))
    blocks = bloom.collect_hashed(shared, "anchor", n_shared)
    # 3. windows
    windows = cut(candidate_windows(usable.select("doc_id", "text", F.col("__variant").alias("variant")), blocks, width))
    least = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high")
    later = windows.join(least, ["k1", "k2"]).filter("doc_id > low")
    starts, n_starts = cut_counted(later.groupBy("doc_id", F.col("variant").alias("__variant")).agg(F.collect_set("start").alias("__starts")))
    # 4. words
    listed = starts.select(F.col("doc_id").alias("__doc")).distinct()
    log2 = bloom.log2_blocks(n_starts)
    touched = bloom.probe(rest.drop("__key"), "doc_id", bloom.build(listed, "__doc", log2), log2, "__maybe")
    nothing = F.lit(None).cast("array<int>")
    cut_down = touched.filter("__maybe").drop("__maybe").join(starts, ["doc_id", "__variant"], "left")
    done = cut_down.unionByName(touched.filter("NOT __maybe").drop("__maybe").withColumn("__starts", nothing)).withColumn("__k", _kept(F.col("text"), F.col("__starts"), width))
    gone = whole.drop("__key").withColumn("__k", _kept(F.col("text"), nothing, width))
    all_gone = F.col("__k.n_words") >= width
    gone = gone.withColumn("__k", F.when(all_gone, F.struct(F.col("__k.n_words").alias("n_words"), F.col("__k.n_words").alias("n_removed"), F.lit("").alias("kept"))).otherwise(F.col("__k")))
    both = done.drop("__starts", "__variant").unionByName(gone.drop("__variant"))
    text = F.when(F.col("__k.n_removed") == 0, F.col("text")).otherwise(F.col("__k.kept")) if keep_layout else F.col("__k.kept")
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns], "__k.n_words", "__k.n_removed")
