"""Target-distribution importance resampling: documents drawn towards the word distribution of a target table.

1. Every text becomes an array of feature buckets (runs of 1 to ``longest`` words, by the CRC-32 of their bytes); the
   arrays are written once. Both tables' bucket counts are summed by task, then over all tasks.
2. A document's weight is the floored mean of its buckets' gains, taken from one array of gains (a fixed number of buckets).
   Its score adds noise that is a function of its id alone, so a draw can be repeated.
3. The cutoff of the draw is found without sorting the table: a quantile sketch brackets it, the exact numbers of scores
   above and inside the bracket say whether it holds the cutoff, and the bracket is widened until it does. Only the
   bracket's scores are sorted.
4. Ranks: the number of drawn documents with a higher score (scores are whole numbers within a fixed range, so these
   numbers are a bounded table) and the place among those of the same score, by id.

Defined cases: null text has no words, and a document without words has weight 0; documents of fewer than ``least_words``
words are scored but neither counted nor drawn; a null id takes the noise of the bare seed and comes after all others
of its score; rows that repeat an id are drawn each for itself, in order of n_features and weight; equal rows take
ranks side by side; an empty table gives no rows; an empty target makes all buckets equally likely; columns other than
the id and the text are not read. A long text is one array.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, byte_table, cut, mapped_words, slices

BUCKETS, PERCENT, LEAST_WORDS, LONGEST, SEED = 10_000, 10, 20, 1, "2024"
#: A word has digits, letters a-z (after lower-casing) and all characters beyond ASCII.
TABLE = byte_table(True, bytes(b for b in range(128) if not chr(b).isalnum()))
#: First half-width of the bracket as a share of all documents, and how much wider the next one is.
MARGIN, WIDER, ACCURACY = 0.002, 8, 10_000


def _feature_buckets(codes: np.ndarray, offsets: np.ndarray, distinct: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all runs of 1 to ``longest`` words, those of a row in order of length."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    raw = distinct.cast(pa.large_binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
    gram, found = codes, [(crc[codes] % buckets, row)]
    for n in range(2, longest + 1):
        inside = row[: len(row) - n + 1] == row[n - 1 :]
        last = codes[n - 1 :]
        pairs, gram = np.unique(gram[: len(last)] * max(1, len(raw)) + last, return_inverse=True)
        # the CRC of a run goes on from that of its first words
        crc = np.fromiter((zlib.crc32(b" " + raw[w], int(crc[g])) for g, w in zip((pairs // max(1, len(raw))).tolist(), (pairs % max(1, len(raw))).tolist(), strict=True)), np.int64, len(pairs))
        found.append((crc[gram][inside] % buckets, row[: len(last)][inside]))
    bucket, where = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(where, kind="stable")
    return bucket[order], where[order]


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): each text's feature buckets as little-endian 32-bit integers."""
    kind = documents.select(id_col).schema[0].dataType.simpleString() if id_col else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                codes, offsets, distinct, _ = mapped_words(batch.column(1).slice(start, stop - start), TABLE)
                bucket, row = _feature_buckets(codes, offsets, distinct, longest, buckets)
                sizes = np.bincount(row, minlength=stop - start)
                ends = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int64)
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - start, [None, pa.py_buffer(ends), pa.py_buffer(bucket.astype("<u4"))])
                arrays = [batch.column(0).slice(start, stop - start), pa.array(np.diff(offsets)), pa.array(sizes), held.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "buckets"])

    read = documents.select((F.col(id_col) if id_col else F.lit(None).cast("long")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<u4")


def bucket_counts(held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: one partial array a task, a fixed number of sums to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                total += np.bincount(_flat(batch.column(0).slice(start, stop - start)), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    rows = held.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares, target over source."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.asarray([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's buckets."""
    kind = dict(held.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(3)):
                n = np.asarray(batch.column(2).slice(start, stop - start))
                before = np.concatenate([[0], np.cumsum(gain[_flat(batch.column(3).slice(start, stop - start))])])
                ends = np.concatenate([[0], np.cumsum(n)])
                total = before[ends[1:]] - before[ends[:-1]]
                kept = [batch.column(i).slice(start, stop - start) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return held.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Floored thousandths of Gumbel noise that is a function of the id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def cutoff(eligible: DataFrame, n: int, wanted: int, margin: float = MARGIN) -> int:
    """The score of the ``wanted``-th highest of the ``n`` rows of ``eligible`` (score), 1 <= wanted <= n."""
    share = 1 - wanted / n
    while True:
        low, high = max(0.0, share - margin), min(1.0, share + margin)
        least, most = eligible.agg(F.percentile_approx("score", [low, high], ACCURACY)).first()[0]
        score = F.col("score")
        inside = (score >= least) & (score <= most)
        above, within = eligible.agg(F.count(F.when(score > most, 1)), F.count(F.when(inside, 1))).first()
        if above < wanted <= above + within:
            break
        margin = max(margin * WIDER, 1e-6)
    # scores are whole numbers, so that the bracket's distinct ones are few
    for r in eligible.filter(inside).groupBy("score").count().orderBy(F.desc("score")).collect():
        above += r["count"]
        if above >= wanted:
            return r["score"]
    raise AssertionError("the bracket holds the cutoff")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, margin: float = MARGIN) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with ``rank``: 1, 2, ... for the drawn rows, else null."""
    may = F.col("n_words") >= least_words
    eligible = scored.filter(may)
    n = eligible.count()
    wanted = percent * n // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    undrawn = scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return undrawn
    least = cutoff(eligible.select("score"), n, wanted, margin)
    # equal rows are one row with their number, so that a row that is repeated very often is no hot key
    same = eligible.filter(F.col("score") >= least).groupBy(*columns).agg(F.count("*").alias("__n"))
    higher = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)  # over distinct scores: a bounded number
    bases = same.groupBy("score").agg(F.sum("__n").alias("__all")).select("score", F.coalesce(F.sum("__all").over(higher), F.lit(0)).alias("__base"))
    before = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words").rowsBetween(W.unboundedPreceding, -1)
    placed = same.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(bases, "score")
    each = placed.select(*columns, (F.col("__base") + F.col("__before")).alias("__at"), F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"))
    rank = F.col("__at") + F.col("__i")
    drawn = each.select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return undrawn.filter(~F.coalesce(may & (F.col("score") >= least), F.lit(False))).unionByName(drawn)


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn."""
    bounded_batches(documents.sparkSession)
    held = cut(features(documents, id_col, text_col, longest, buckets))
    gain = gains(bucket_counts(held, buckets), bucket_counts(features(target, "", target_col, longest, buckets), buckets))
    scored = cut(weights(held, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return draw(scored, percent, least_words)
