"""Flags of doubtful chunks and statistics of a chunked corpus."""

from __future__ import annotations

from corpusloom.functions.text import DIGIT, let, split_lines, strip
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SHORT, LONG_SHARE, TABLE_LINES, TABLE_LINE_CHARS, TABLE_SHARE, DIGIT_SHARE = 60, 1.2, 6, 6, 0.5, 0.25


def flags(text: Column, chunk_size: int = 950) -> Column:
    """Array of ``short``, ``long`` and ``table`` (many short lines, or many digits)."""
    lines = F.filter(F.transform(split_lines(text), strip), lambda s: s != "")

    def broken(ls: Column) -> Column:
        few = F.size(F.filter(ls, lambda s: F.length(s) <= TABLE_LINE_CHARS))
        many_lines = (F.size(ls) >= TABLE_LINES) & (few > F.size(ls) * TABLE_SHARE)
        digits = F.regexp_count(text, F.lit(DIGIT)) > F.length(text) * DIGIT_SHARE
        return (F.size(ls) > 0) & (many_lines | digits)

    return let(lines, lambda ls: F.array_compact(F.array(F.when(F.length(text) < SHORT, "short"), F.when(F.length(text) > chunk_size * LONG_SHARE, "long"), F.when(broken(ls), "table"))))


def corpus_stats(chunks: DataFrame, chunk_size: int = 950) -> DataFrame:
    """One row: documents, chunks, least, floored mean and greatest length, flagged chunks; zeros for an empty corpus."""
    n = F.length("text")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return chunks.agg(
        F.count_distinct("source").alias("documents"),
        F.count("*").alias("chunks"),
        zero(F.min(n)).alias("min_chars"),
        zero(F.floor(F.sum(n) / F.count("*"))).alias("mean_chars"),
        zero(F.max(n)).alias("max_chars"),
        F.count_if(F.size(flags(F.col("text"), chunk_size)) > 0).alias("flagged"),
    )


def chunks_per_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"))


def rebuild_stats(encoded: DataFrame) -> DataFrame:
    """One row for a rebuild over ``encode_cached``'s chunks: doc_files, chunks, reused, to_encode."""
    return encoded.agg(F.count_distinct("source").alias("doc_files"), F.count("*").alias("chunks"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("to_encode"))
