"""Hybrid retrieval for a table of queries: fusion, reranking, neighbour windows and expansion of short hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from corpusloom.functions.text import let, tokens
from corpusloom.operators import bm25, vectors
from corpusloom.sources.tables import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K, DIGITS = 60, 9
LEAST_OVERLAP, MOST_OVERLAP = 6, 200
#: Ids of neighbouring chunks that are gathered together.
SPAN = 32


@dataclass(frozen=True)
class Settings:
    top_k: int = 4
    vector_k: int = 20
    bm25_k: int = 20
    rrf_k: int = RRF_K
    hybrid: bool = True
    rerank: bool = True
    rerank_candidates: int = 20
    expand_short: bool = True
    expand_min_chars: int = 300
    expand_target_chars: int = 600
    expand_max_neighbors: int = 4


def rrf_fuse(first: DataFrame, second: DataFrame, rrf_k: int = RRF_K, keys: list[str] | None = None) -> DataFrame:
    """(keys, chunk_id, rrf, rank) of two ranked lists: sums of 1 / (rrf_k + rank), ties by first, then second list."""
    keys = keys or ["query_id"]
    one = first.select(*keys, "chunk_id", F.col("rank").alias("a"), F.lit(None).cast("int").alias("b"))
    two = second.select(*keys, "chunk_id", F.lit(None).cast("int").alias("a"), F.col("rank").alias("b"))
    both = one.unionByName(two).groupBy(*keys, "chunk_id").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(share("a") + share("b"), 12))
    order = W.partitionBy(*keys).orderBy(F.desc("rrf"), F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).select(*keys, "chunk_id", "rrf", "rank")


def lexical_overlap(question: Column, text: Column) -> Column:
    """Default scorer: the share of the question's distinct tokens that the text has."""
    asked = F.array_distinct(tokens(question))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, tokens(text))) / F.size(asked))


def rerank(hits: DataFrame, top_k: int, scorer: Callable[[Column, Column], Column] | Callable[[pd.Series, pd.Series], pd.Series] | None = lexical_overlap, batch: bool = False) -> DataFrame:
    """``hits`` (query_id, question, text, rank) ordered anew by score, earlier rank first among equals; top_k stay.

    ``scorer`` takes columns, or with ``batch`` two pandas series; None leaves the order as it is.
    """
    if scorer is None:
        return hits.filter(F.col("rank") <= top_k).withColumn("rerank_score", F.lit(None).cast("double"))
    score = F.pandas_udf(lambda q, t: scorer(q, t), "double") if batch else scorer
    scored = hits.withColumn("rerank_score", F.round(score(F.col("question"), F.col("text")), DIGITS))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def context_window(wanted: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """``wanted`` (source, idx and others) with ``window``: the chunks idx - radius to idx + radius of its source, in order.

    The range becomes an equi-join: chunks are gathered by spans of ``SPAN`` ids and what lies ``radius`` around them, so that
    of the asked sources each is shuffled little more than once, and a wanted row meets its one span.
    """
    at = lambda i: F.floor(i / SPAN)
    asked = wanted.withColumn("__span", at(F.col("idx")))
    spans = F.sequence(at(F.col("idx") - radius), at(F.col("idx") + radius))
    each = chunks.select(F.col("source").alias("__source"), F.explode(spans).alias("__at"), F.struct("idx", "text", "chapter", "section").alias("__chunk"))
    needed = asked.select(F.col("source").alias("__source"), F.col("__span").alias("__at")).distinct()
    near = each.join(needed, ["__source", "__at"], "left_semi").groupBy("__source", "__at").agg(F.array_sort(F.collect_list("__chunk")).alias("__chunks"))
    joined = asked.join(near, (asked["source"] == near["__source"]) & (asked["__span"] == near["__at"]), "left")
    held = F.coalesce("__chunks", F.array().cast(near.schema["__chunks"].dataType))
    window = F.filter(held, lambda c: c["idx"].between(F.greatest(F.lit(0), F.col("idx") - radius), F.col("idx") + radius))
    return joined.select(*wanted.columns, window.alias("window"))


def stitch(before: Column, after: Column) -> Column:
    """The two texts joined over their longest overlap of 6 to 200 characters, else with a blank line."""
    ends = F.struct(F.right(before, F.lit(MOST_OVERLAP)).alias("tail"), F.left(after, F.lit(MOST_OVERLAP)).alias("head"))

    def overlap(e: Column) -> Column:
        """Of the lengths in question; there is none unless the end holds the start's first characters."""
        longest = F.least(F.length(e["tail"]), F.length(e["head"]))
        may = (longest >= LEAST_OVERLAP) & e["tail"].contains(F.left(e["head"], F.lit(LEAST_OVERLAP)))
        return F.when(may, F.array_max(F.filter(F.sequence(F.lit(LEAST_OVERLAP), longest), lambda n: F.right(e["tail"], n) == F.left(e["head"], n))))

    return let(let(ends, overlap), lambda n: F.when(n.isNull(), F.concat(before, F.lit("\n\n"), after)).otherwise(F.concat(before, F.substring(after, n + 1, F.length(after)))))


def expand(row_text: str, idx: int, window: list, least: int, target: int, most: int) -> tuple[int, int] | None:
    """First and last idx of the neighbours that a short hit grows to, or None.

    Neighbours of the same chapter are taken in turn from both sides, above first unless the text opens with a heading
    or a chapter name, until the lengths add up to ``target`` or ``most`` neighbours a side are used.
    """
    near = {w["idx"]: w for w in window}
    if len(row_text) >= least or idx not in near:
        return None
    base = near[idx]
    edges = {-1: idx, 1: idx}
    sides = (1, -1) if base["text"].lstrip().startswith(("#", "【")) else (-1, 1)
    size = len(base["text"])
    moved = True
    while moved and size < target:
        moved = False
        for side in sides:
            at = edges[side] + side
            if size < target and abs(at - idx) <= most and at in near and near[at]["chapter"] == base["chapter"]:
                edges[side], moved = at, True
                size += len(near[at]["text"])
    return (edges[-1], edges[1]) if edges[-1] < edges[1] else None


def expand_short_hits(hits: DataFrame, chunks: DataFrame, min_chars: int = 300, target: int = 600, max_neighbors: int = 4) -> DataFrame:
    """``hits`` with ``expanded`` and ``expanded_span``; texts shorter than ``min_chars`` grow by their neighbours.

    Only short hits ask for neighbours; windows hold at most 2 max_neighbors + 1 chunks.
    """
    long = hits.filter(F.length("text") >= min_chars).withColumns({"expanded": F.lit(False), "expanded_span": F.lit(None).cast("array<int>")})
    short = context_window(hits.filter(F.length("text") < min_chars), chunks, max_neighbors)

    def spans(texts: pd.Series, idxs: pd.Series, found: pd.Series) -> pd.Series:
        out = [expand(t, int(i), list(w) if w is not None else [], min_chars, target, max_neighbors) for t, i, w in zip(texts, idxs, found, strict=True)]
        return pd.Series([list(o) if o else None for o in out])

    grown = short.withColumn("expanded_span", F.pandas_udf(spans, "array<int>")("text", "idx", "window"))
    span = F.col("expanded_span")
    inside = F.transform(F.filter("window", lambda w: w["idx"].between(F.get(span, F.lit(0)), F.get(span, F.lit(1)))), lambda w: w["text"])
    text = F.aggregate(F.slice(inside, F.lit(2), F.greatest(F.size(inside) - 1, F.lit(0))), F.get(inside, F.lit(0)), stitch)
    grown = grown.withColumn("text", F.when(span.isNotNull(), text).otherwise(F.col("text"))).withColumn("expanded", span.isNotNull()).drop("window")
    return long.unionByName(grown.select(*long.columns))


def retrieve(queries: DataFrame, chunks: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], embeddings: DataFrame, settings: Settings = Settings(), scorer=lexical_overlap) -> DataFrame:
    """Hits of every query (query_id, question, embedding): vector and BM25 lists fused, reranked, short hits expanded.

    Chunk texts are joined to the few candidates only, and always carry chapter and section.
    """
    near = vectors.vector_topk(queries, embeddings, settings.vector_k)
    if settings.hybrid:
        ranked = rrf_fuse(near, bm25.search(queries, index, settings.bm25_k, store=chunks.select("chunk_id", F.struct("source", "idx").alias("store_order"))), settings.rrf_k)
    else:
        ranked = near
    pool = ranked.filter(F.col("rank") <= (settings.rerank_candidates if settings.rerank else settings.top_k)).select("query_id", "chunk_id", "rank")
    hits = pool.join(chunks, "chunk_id").join(queries.select("query_id", "question"), "query_id")
    best = materialize(rerank(hits, settings.top_k, scorer if settings.rerank else None))  # short and long hits take different ways
    if not settings.expand_short:
        return best.withColumns({"expanded": F.lit(False), "expanded_span": F.lit(None).cast("array<int>")})
    return expand_short_hits(best, chunks, settings.expand_min_chars, settings.expand_target_chars, settings.expand_max_neighbors)
