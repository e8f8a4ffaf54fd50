"""Document fingerprints: one-permutation MinHash of five-word shingles, densified, packed to four bits a bin.

Built-in functions only. Each shingle is hashed once; the top bits of the hash name one of 128 bins and the rest is its
rank there, the least rank of a bin being kept. An empty bin takes the value of a bin that is not empty, chosen by a
hash of the pair (empty bin, full bin) alone - the walk of optimal densification through a random order of bins, ended
at its first full bin. The low four bits of each value are packed, sixteen bins to a long. Two unequal values agree in
four bits once in sixteen, and the likeness is corrected for that.

Defined cases: null text counts as empty; a text of fewer than five words is one shingle; without words there is no
fingerprint ('' in text form), like another empty one (1.0) and unlike all others (0.0); rows that repeat an id stand
next to one another in order of a hash of their texts; a row without id has an empty next document; ids may be any
longs; columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let

BIN_BITS, LOW_BITS, SHINGLE, LONGS = 7, 4, 5, 8
BINS = 1 << BIN_BITS
#: Rows of a range of ids, and the most ranges (their bounds are one literal array of longs).
ROWS_PER_BUCKET, MAX_BUCKETS = 1000, 1 << 17


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS)


def shingle_hashes(text: Column) -> Column:
    words = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, runs).when(F.size(h) > 0, F.array(F.xxhash64(h)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def fingerprint(text: Column) -> Column:
    """Array of eight longs, or null for a text without words."""

    def lowest(values: Column) -> Column:
        return F.filter(values, lambda v, i: (i == 0) | (_bin(v) != _bin(F.get(values, i - 1))))

    def dense(full: Column) -> Column:
        def value(b: Column, at: Column) -> Column:
            walk = F.array_min(F.transform(full, lambda v: F.struct(F.xxhash64(b, _bin(v)).alias("h"), v.alias("v"))))
            return F.when(at > 0, F.get(full, (at - 1).cast("int"))).otherwise(walk["v"])

        bins = F.transform(full, _bin)
        every = F.array(*[F.lit(b).cast("long") for b in range(BINS)])
        return let(bins, lambda taken: F.when(taken.isNotNull(), F.transform(every, lambda b: value(b, F.array_position(taken, b)))))

    def pack(values: Column) -> Column:
        per = BINS // LONGS
        return F.array(*[F.aggregate(F.slice(values, per * k + 1, per), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, LOW_BITS).bitwiseOR(v.bitwiseAND((1 << LOW_BITS) - 1))) for k in range(LONGS)])

    hashes = shingle_hashes(text)
    return let(let(let(F.sort_array(hashes), lowest), dense), lambda v: F.when(v.isNotNull(), pack(v)))


def as_text(packed: Column) -> Column:
    """128 hexadecimal digits, one a bin; '' without a fingerprint."""
    return F.coalesce(F.concat(*[F.lpad(F.hex(F.get(packed, k)), 16, "0") for k in range(LONGS)]), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of the shingle sets, 0 to 1, corrected for values that agree in the low bits by chance."""
    ones = 0x1111111111111111
    differ = F.lit(0)
    for k in range(LONGS):
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(y.bitwiseAND(F.lit(ones)))
    chance = 1.0 / (1 << LOW_BITS)
    corrected = ((F.lit(1.0) - differ / F.lit(float(BINS))) - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), corrected))


def _range(key: Column, spread: Column, bounds: Column, width: int) -> Column:
    """Number of the range that ``key`` falls into; an id that is several bounds has its rows dealt over those ranges.

    ``bounds`` has ``all`` bounds and ``every`` one in ``width``; ``spread`` is a number from 0 to below 1 that rises with
    what orders rows of one id.
    """
    all_, every = bounds["all"], bounds["every"]

    def count(below: Callable[[Column], Column]) -> Column:
        within = lambda top: F.size(F.filter(F.slice(all_, (top - 1) * width + 1, F.lit(width)), below))
        return let(F.size(F.filter(every, below)), lambda top: F.when(top > 0, (top - 1) * width + within(top)).otherwise(F.lit(0)))

    low, high = count(lambda b: b < key), count(lambda b: b <= key)
    return let(low, lambda x: x + F.floor(spread * (high - x + 1)))


def range_bounds(df: DataFrame, id_col: str) -> list[int]:
    """Sampled quantiles of the ids, one for about ROWS_PER_BUCKET rows."""
    n = df.agg(F.count(id_col)).first()[0]
    cuts = min(MAX_BUCKETS, n // ROWS_PER_BUCKET)
    return sorted(df.agg(F.percentile_approx(id_col, [k / (cuts + 1) for k in range(1, cuts + 1)], max(10_000, 8 * cuts))).first()[0]) if cuts else []


def with_next(df: DataFrame, id_col: str, columns: list[str], bounds: list[int], tie: str) -> DataFrame:
    """``df`` with ``next_<c>`` of the row that follows in ascending id (after the last: the first); ``tie`` orders rows of one id.

    Each range of ids between ``bounds`` is sorted by itself, and only the first row of each range is sent on, to the range
    before it. What is sorted in one task is the ranges' numbers.
    """
    key, hashed, width = F.col(id_col), F.col(tie), max(1, int(len(bounds) ** 0.5))
    held = F.struct(F.lit(np.asarray(bounds, np.int64)).alias("all"), F.lit(np.asarray(bounds[::width], np.int64)).alias("every"))  # two literals
    spread = F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(1 << 63))), 12) / F.lit(2.0**52)
    nowhere = -1 - F.pmod(F.xxhash64(*columns), F.lit(1024))
    bucket = let(held, lambda b: _range(key, spread, b, width)) if bounds else F.lit(0)
    placed = df.withColumn("__bucket", F.when(key.isNull(), nowhere).otherwise(bucket).cast("long"))
    order = W.partitionBy("__bucket").orderBy(id_col, tie)
    ranked = placed.select("*", F.row_number().over(order).alias("__rn"), *[F.lead(F.struct(c)).over(order).alias(f"__lead_{c}") for c in columns])
    one = W.orderBy("__bucket")  # over at most MAX_BUCKETS + 1 numbers
    numbers = placed.filter("__bucket >= 0").select("__bucket").distinct()
    top = F.max("__bucket").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = numbers.select("__bucket", F.coalesce(F.lag("__bucket").over(one), top).alias("__before"))
    firsts = ranked.filter((F.col("__rn") == 1) & (F.col("__bucket") >= 0)).select("__bucket", *[F.col(c).alias(f"__first_{c}") for c in columns])
    firsts = firsts.join(F.broadcast(before), "__bucket").drop("__bucket")
    joined = ranked.join(firsts, ranked["__bucket"] == firsts["__before"], "left")
    following = [F.when(key.isNotNull(), F.coalesce(F.col(f"__lead_{c}")[c], F.when(F.col(f"__lead_{c}").isNull(), F.col(f"__first_{c}")))).alias(f"next_{c}") for c in columns]
    return joined.select(*df.columns, *following)


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is replaced by the start of the next document.

    Every text and every edited text is fingerprinted once; next fingerprints are found among the written, short rows.
    """
    base = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, bounds = base.withColumn("tie", F.xxhash64("text")), range_bounds(base, "doc_id")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    moved = with_next(base, "doc_id", ["text"], bounds, "tie").withColumn("next_text", F.coalesce("next_text", F.lit("")))
    edited = moved.select("doc_id", "tie", "text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    made = edited.select("doc_id", "tie", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("edited_fp"))
    done = with_next(cut(made), "doc_id", ["fp"], bounds, "tie")
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
