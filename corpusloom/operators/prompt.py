"""Prompts, ordered sources and retrieval payloads, one row a query."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from corpusloom.operators.models import Tokens, as_batch
from corpusloom.sources.tables import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template, what stands in for no hits, and the answer of an empty index.
TEMPLATE = """你是一个严谨的中文问答助手。请仅根据下面的【已知信息】回答【问题】。
如果已知信息中没有答案,请直接说"知识库中没有相关内容",不要编造。

【已知信息】
{context}

【问题】
{question}

请用简洁的中文回答:"""
NO_HITS, EMPTY_INDEX = "(无)", "知识库为空,请先导入文档并重建索引。"


def fill(template: str, **values: Column) -> Column:
    """The template with columns in place of ``{name}``; a value is never searched for names."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at, name = min(((rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest), default=(len(rest), ""))
        pieces.append(F.lit(rest[:at]))
        if name:
            pieces.append(values[name])
        rest = rest[at + len(name) + 2 :] if name else ""
    return F.concat(*pieces)


def in_rank_order(hits: DataFrame, *fields: str) -> DataFrame:
    """(query_id, hits): an array of the fields in order of rank (a query has at most top_k hits)."""
    kept = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("hits"))
    return kept


def build_prompts(queries: DataFrame, hits: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``queries`` with ``prompt``, ``sources`` (distinct, in order of first hit) and ``retrieved_sources`` (one a hit)."""
    ordered = in_rank_order(hits, "source", "text")
    joined = queries.join(ordered, "query_id", "left")
    found = F.coalesce(F.col("hits"), F.array().cast(ordered.schema["hits"].dataType))
    context = F.array_join(F.transform(found, lambda h: F.concat(F.lit("[来源:"), h["source"], F.lit("] "), h["text"])), "\n\n")
    sources = F.transform(found, lambda h: h["source"])
    out = joined.withColumn("prompt", fill(template, context=F.when(F.size(found) == 0, NO_HITS).otherwise(context), question=F.col("question")))
    return out.withColumn("sources", F.array_distinct(sources)).withColumn("retrieved_sources", sources).drop("hits")


def payload(hits: DataFrame) -> DataFrame:
    """(query_id, retrieval): source, text, chapter, section and expanded of each hit, in order of rank."""
    kept = in_rank_order(hits.withColumn("expanded", F.coalesce("expanded", F.lit(False))) if "expanded" in hits.columns else hits.withColumn("expanded", F.lit(False)), "source", "text", "chapter", "section", "expanded")
    return kept.select("query_id", F.transform("hits", lambda h: h.dropFields("rank")).alias("retrieval"))


def answers(prompts: DataFrame, generate: Callable[[pd.Series], pd.Series] | Tokens, n_chunks: int) -> DataFrame:
    """``prompts`` with ``answer``, each made once; over an empty index a fixed message without sources."""
    if not n_chunks:
        return prompts.withColumn("answer", F.lit(EMPTY_INDEX)).withColumn("sources", F.array().cast("array<string>"))
    return materialize(prompts.withColumn("answer", F.pandas_udf(as_batch(generate), "string")("prompt")))
