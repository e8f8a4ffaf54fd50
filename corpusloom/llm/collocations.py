"""Phrase collocations of two and three words, mined for each language by Rabin-Karp fingerprints.

Words are hashed, and numpy prefix polynomials over a text's word hashes give the fingerprint of every run of words at
once. Runs are aggregated inside a task first and then by a shuffle of (language, fingerprint) with their number, an occurrence
pointer (the hash of one document that holds them) and the least and greatest hash of their parts. The algebra of
polynomials gives the fingerprints of a run's other parts from these, so that no text is shuffled.

1. Words are counted, then pairs of frequent words, then triples of two frequent pairs: a run is frequent only if its parts
   are. Blocked Bloom filters of at most 32 MB hold the frequent ones; a fuller filter lets more runs be counted, and
   the result stays the same.
2. Collisions are verified: where the least and the greatest hash of the parts differ, different runs share a fingerprint,
   and these fingerprints are counted again by all their parts. Words whose hashes collide (by a second hash) are
   hashed by another seed, and counting starts again.
3. Cuts are scored by joins of frequent runs with their parts; pairs that a frequent triple contains are dropped.
4. Only phrases that may be among a language's best are materialised: their fingerprints go to the documents that the
   pointers name, and are found in those texts by all their parts.

Defined cases: null text is empty; a null language counts as ``und``; a null id is an id like any other; repeated rows count
each time; texts without words give nothing; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bloom
from .common import bounded_batches, byte_table, cut, mapped_words, slices, word_hashes

LEAST, PERCENT, TOP, UNKNOWN = 10, 50, 2000, "und"
#: Punctuation and line ends stand between parts of a text; spaces and tabs between words.
TABLE = byte_table(True, b" \t", b".,;:!?\n\x0b\x0c\r")
BASE = 0x9E3779B97F4A7C15
SLICE = 3_000_000
#: More colliding words than this are not expected of any table.
MOST_COLLISIONS = 1_000_000
_ALL = (1 << 64) - 1


class Hashing:
    """Word hashes and prefix polynomials; ``taken`` lists hashes that different words share, one array a seed."""

    def __init__(self, base: int = BASE, bits: int = 64, taken: tuple[np.ndarray, ...] = ()) -> None:
        self.base, self.bits, self.taken = base | 1, bits, taken

    def words(self, distinct: pa.Array) -> np.ndarray:
        hashes = word_hashes(distinct) & np.uint64((1 << self.bits) - 1)
        for seed, listed in enumerate(self.taken, 1):
            shared = np.flatnonzero(np.isin(hashes, listed))
            if len(shared):
                hashes[shared] = word_hashes(distinct.take(pa.array(shared)), seed)
        return hashes

    def check(self, distinct: pa.Array) -> np.ndarray:
        return word_hashes(distinct, 0xC0FFEE)

    def runs(self, hashes: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """Of each size, the fingerprints of all runs of so many hashes: h[i] * base^(size-1) + ... + h[i+size-1]."""
        n = len(hashes)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base & _ALL, np.uint64)]))
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(self.base, -1, 1 << 64), np.uint64)]))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(hashes * inverse[:n])])
        return [(prefix[k:] - prefix[: n + 1 - k]) * power[k - 1 : n] if n >= k else np.empty(0, np.uint64) for k in sizes]

    def rest(self, whole: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
        """Fingerprint of the last ``size`` words of runs, from those of the whole and of the words before."""
        return whole - first * np.uint64(pow(self.base, size, 1 << 64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _grouped(lang: np.ndarray, keys: list[np.ndarray], pointer: np.ndarray, ranges: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(index of one row, number, least pointer, least and greatest of each of ``ranges``) of rows alike in lang and keys.

    Rows are brought together by the first key; rows that are alike may make two groups, which the shuffle joins.
    """
    if not len(lang):
        none = np.empty(0, np.int64)
        return (none, none, none, *[none] * (2 * len(ranges)))
    order = np.argsort(keys[0] ^ (lang.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in (lang, *keys):
        new[1:] |= x[order[1:]] != x[order[:-1]]
    heads = np.flatnonzero(new)
    out = [order[heads], np.diff(np.append(heads, len(order))), np.minimum.reduceat(pointer[order], heads)]
    for x in ranges:
        held = _signed(x)[order]
        out += [np.minimum.reduceat(held, heads), np.maximum.reduceat(held, heads)]
    return tuple(out)


def _read(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, pointer, text); the pointer is a hash of the row."""
    read = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return read.select("lang", F.xxhash64("lang", "__id", "text").alias("pointer"), "text")


def _slices(batches: Iterator[pa.RecordBatch], hashing: Hashing):
    """(languages, language and pointer of each word, part of each word, codes, distinct words, hashes) of each slice."""
    for batch in batches:
        for start, stop in slices(batch.column(2), SLICE):
            coded = batch.column(0).slice(start, stop - start).dictionary_encode()
            codes, offsets, distinct, part = mapped_words(batch.column(2).slice(start, stop - start), TABLE)
            row = np.repeat(np.arange(stop - start), np.diff(offsets))
            lang = np.asarray(coded.indices).astype(np.int64)[row]
            yield coded.dictionary, lang, np.asarray(batch.column(1).slice(start, stop - start))[row], part, codes, distinct, hashing.words(distinct)


def count_words(read: DataFrame, hashing: Hashing, least: int) -> DataFrame:
    """(lang, fp, n, pointer, lo, hi) of frequent words; a row with null fp has the number of all words of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, lang, pointer, _, codes, distinct, hashes in _slices(batches, hashing):
            check = hashing.check(distinct)
            at, n, first, lo, hi = _grouped(lang, [hashes[codes]], pointer, [check[codes]])
            total = np.bincount(lang, minlength=len(names))
            fps = pa.concat_arrays([pa.array(_signed(hashes[codes][at])), pa.nulls(len(names), pa.int64())])
            where = np.concatenate([lang[at], np.arange(len(names))])
            more = [np.concatenate([x, y]) for x, y in ((n, total), (first, 0 * total), (lo, 0 * total), (hi, 0 * total))]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(where)), fps, *map(pa.array, more)], names=["lang", "fp", "n", "pointer", "lo", "hi"])

    found = read.mapInArrow(run, "lang string, fp long, n long, pointer long, lo long, hi long")
    counted = found.groupBy("lang", "fp").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return cut(counted.filter((F.col("n") >= least) | F.col("fp").isNull()))


def _runs_of(size: int, lang: np.ndarray, part: np.ndarray, words: np.ndarray, hashing: Hashing, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first word, fingerprint, first word's hash, fingerprint of all but the last word) of runs whose parts may be frequent."""
    fp = hashing.runs(words, (size, size - 1))
    whole, shorter = fp
    inside = part[: len(whole)] == part[size - 1 :][: len(whole)]
    may = bloom.may_hold(known, shorter)
    at = np.flatnonzero(inside & may[: len(whole)] & may[1 : len(whole) + 1])
    return at, whole[at], words[at], shorter[at]


def count_runs(read: DataFrame, size: int, hashing: Hashing, frequent: DataFrame, least: int, n_frequent: int) -> DataFrame:
    """(lang, fp, n, pointer, h1, before) of frequent runs of 2 or 3 words, exactly; ``frequent`` has the shorter ones' fp.

    ``h1`` is the hash of the first word, ``before`` the fingerprint of all but the last (for two words the same).
    """
    held = read.sparkSession.sparkContext.broadcast(bloom.collect_hashed(frequent, "fp", n_frequent))
    wide = size > 2
    kinds = "lang string, fp long, n long, pointer long, " + ("lo long, hi long, lo2 long, hi2 long" if wide else "lo long, hi long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, lang, pointer, part, codes, _, hashes in _slices(batches, hashing):
            at, fp, h1, before = _runs_of(size, lang, part, hashes[codes], hashing, held.value)
            rows, *more = _grouped(lang[at], [fp], pointer[at], [h1, before][: 1 + wide])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[at][rows])), pa.array(_signed(fp[rows])), *map(pa.array, more)], names=[x.split()[0] for x in kinds.split(", ")])

    ranges = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), *([F.min("lo2").alias("lo2"), F.max("hi2").alias("hi2")] if wide else [])]
    counted = read.mapInArrow(run, kinds).groupBy("lang", "fp").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"), *ranges)
    counted = cut(counted.filter(F.col("n") >= least))
    differ = (F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2")) if wide else F.col("lo") != F.col("hi")
    alike = counted.filter(~differ).select("lang", "fp", "n", "pointer", F.col("lo").alias("h1"), F.col("lo2" if wide else "lo").alias("before"))
    shared = counted.filter(differ).select("lang", "fp")
    n_shared = shared.count()
    if not n_shared:
        return alike
    # different runs with one fingerprint: these are counted by all their parts
    some = read.sparkSession.sparkContext.broadcast(bloom.collect_hashed(shared, "fp", n_shared))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, lang, pointer, part, codes, _, hashes in _slices(batches, hashing):
            at, fp, h1, before = _runs_of(size, lang, part, hashes[codes], hashing, held.value)
            maybe = bloom.may_hold(some.value, fp)
            at, fp, h1, before = at[maybe], fp[maybe], h1[maybe], before[maybe]
            rows, n, first = _grouped(lang[at], [fp, h1, before], pointer[at], [])
            arrays = [names.take(pa.array(lang[at][rows])), *(pa.array(_signed(x[rows])) for x in (fp, h1, before)), pa.array(n), pa.array(first)]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "fp", "h1", "before", "n", "pointer"])

    found = read.mapInArrow(again, "lang string, fp long, h1 long, before long, n long, pointer long").groupBy("lang", "fp", "h1", "before").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"))
    exact = cut(found.join(shared, ["lang", "fp"], "left_semi").filter(F.col("n") >= least).select(*alike.columns))
    return alike.unionByName(exact)


def _with_parts(runs: DataFrame, size: int, hashing: Hashing) -> DataFrame:
    """``runs`` with last (the last word's hash), behind (fingerprint of all but the first word) and second (word's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, h1, before = (np.asarray(b.column(c)).view(np.uint64) for c in ("fp", "h1", "before"))
            last = hashing.rest(fp, before, 1)
            behind = hashing.rest(fp, h1, size - 1)
            second = hashing.rest(before, h1, 1) if size > 2 else last
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(_signed(x)) for x in (last, behind, second))], names=[*b.schema.names, "last", "behind", "second"])

    columns = "lang string, fp long, n long, pointer long, h1 long, before long"
    return runs.select("lang", "fp", "n", "pointer", "h1", "before").mapInArrow(run, columns + ", last long, behind long, second long")


def _scored(runs: DataFrame, left: str, right: str) -> DataFrame:
    """``runs`` with score: floor(1000000 n n / (left right)), in whole numbers of up to 38 digits."""
    big = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    return runs.withColumn("score", F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * {big('n')} * {big('n')} div ({big(left)} * {big(right)})"))


def candidates(words: DataFrame, pairs: DataFrame, triples: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, size, fp, h1, before, pointer, a, l, r, score) of frequent runs that no frequent longer one makes needless."""
    word = lambda key, name: words.select("lang", F.col("fp").alias(key), F.col("n").alias(name))
    pair = lambda key, first, name: pairs.select("lang", F.col("fp").alias(key), F.col("h1").alias(first), F.col("n").alias(name))
    two = _scored(pairs.join(word("h1", "l"), ["lang", "h1"]).join(word("last", "r"), ["lang", "last"]), "l", "r")
    three = triples.join(word("h1", "l1"), ["lang", "h1"]).join(word("last", "r2"), ["lang", "last"]).join(pair("before", "h1", "l2"), ["lang", "before", "h1"]).join(pair("behind", "second", "r1"), ["lang", "behind", "second"])
    both = _scored(_scored(three, "l1", "r1").withColumnRenamed("score", "s1"), "l2", "r2").withColumnRenamed("score", "s2")
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    three = both.withColumns({"l": pick("l1", "l2"), "r": pick("r1", "r2"), "score": pick("s1", "s2")})
    inner = [triples.select("lang", F.col(x).alias("fp"), F.col(y).alias("h1"), F.col("n").alias("longer")) for x, y in (("before", "h1"), ("behind", "second"))]
    longest = inner[0].unionByName(inner[1]).groupBy("lang", "fp", "h1").agg(F.max("longer").alias("longer"))
    two = two.join(longest, ["lang", "fp", "h1"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n")))
    columns = ["fp", "h1", "before", "pointer", F.col("n").alias("a"), "l", "r", "score"]
    return two.select("lang", F.lit(2).alias("size"), *columns).unionByName(three.select("lang", F.lit(3).alias("size"), *columns))


def phrases(read: DataFrame, wanted: DataFrame, n_wanted: int, hashing: Hashing) -> DataFrame:
    """(lang, size, fp, h1, before, phrase) of ``wanted`` runs, found in the documents that their pointers name."""
    identity = ["lang", "size", "fp", "h1", "before"]
    by_document = wanted.groupBy("pointer").agg(F.collect_list(F.struct(*identity)).alias("wanted"))
    log2 = bloom.log2_blocks(n_wanted)
    probed = bloom.probe(read, "pointer", bloom.build(wanted, "pointer", log2), log2, "__maybe").filter("__maybe").drop("__maybe")
    named = probed.join(by_document, "pointer").select("lang", "wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2), SLICE):
                codes, offsets, distinct, part = mapped_words(batch.column(2).slice(start, stop - start), TABLE)
                words, out = hashing.words(distinct)[codes], []
                for i, (lang, asked) in enumerate(zip(batch.column(0).slice(start, stop - start).to_pylist(), batch.column(1).slice(start, stop - start).to_pylist(), strict=True)):
                    begin, end = offsets[i : i + 2]
                    own, where = words[begin:end], part[begin:end]
                    one, two, three = hashing.runs(own, (1, 2, 3))
                    for size, whole, shorter in ((2, two, one), (3, three, two)):
                        left = {(w["fp"], w["h1"], w["before"]) for w in asked if w["size"] == size and w["lang"] == lang}
                        fp = _signed(whole)
                        for at in np.flatnonzero(np.isin(fp, np.asarray([k[0] for k in left], np.int64)) & (where[: len(fp)] == where[size - 1 :][: len(fp)])).tolist():
                            key = (int(fp[at]), int(_signed(own)[at]), int(_signed(shorter)[at]))
                            if key in left:
                                left.discard(key)
                                out.append((lang, size, *key, " ".join(distinct.take(pa.array(codes[begin + at : begin + at + size])).to_pylist())))
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[*identity, "phrase"])

    found = named.mapInArrow(run, "lang string, size int, fp long, h1 long, before long, phrase string")
    return found.groupBy(*identity).agg(F.min("phrase").alias("phrase"))


def collocations(documents: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hashing: Hashing | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words."""
    bounded_batches(documents.sparkSession)
    read, hashing = _read(documents, id_col, text_col, lang_col), hashing or Hashing()
    while True:
        counted = count_words(read, hashing, least)
        colliding = counted.filter("fp IS NOT NULL AND lo <> hi").select("fp").distinct().limit(MOST_COLLISIONS).toArrow().column("fp")
        if not len(colliding):
            break
        hashing = Hashing(hashing.base, hashing.bits, (*hashing.taken, np.asarray(colliding).view(np.uint64)))
    words, totals = counted.filter("fp IS NOT NULL"), counted.filter("fp IS NULL").select("lang", "n")
    pairs = cut(_with_parts(count_runs(read, 2, hashing, words.select("fp"), least, words.count()), 2, hashing))
    triples = cut(_with_parts(count_runs(read, 3, hashing, pairs.select("fp"), least, pairs.count()), 3, hashing))
    found = cut(candidates(words, pairs, triples, percent))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    edge = found.select("lang", "score", "a").withColumn("__nth", nth).filter(F.col("__nth") <= top).filter(F.col("__nth") == top).select("lang", F.col("score").alias("__score"), F.col("a").alias("__a"))
    better = F.col("__score").isNull() | (F.col("score") > F.col("__score")) | ((F.col("score") == F.col("__score")) & (F.col("a") >= F.col("__a")))
    best = cut(found.join(edge, "lang", "left").filter(better).drop("__score", "__a"))
    named = best.join(phrases(read, best, best.count(), hashing), ["lang", "size", "fp", "h1", "before"])
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
