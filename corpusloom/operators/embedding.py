"""Embeddings by pluggable batch models, each distinct text encoded once and cached by content key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from corpusloom.functions.text import text_key
from corpusloom.operators import _count
from corpusloom.sources.tables import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64
#: Texts that are one Arrow array at a time.
TEXTS = 1024
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Default model: signed feature hashing of the default tokenizer's tokens, deterministic on every machine."""
    out = np.empty((len(texts), dim), dtype=np.float64)
    for at in range(0, len(texts), TEXTS):
        out[at : at + TEXTS] = _count.hashed(pa.array(texts[at : at + TEXTS], pa.string()), dim)
    return out


def normalized(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length == 0, 1, length)).astype(np.float32)


def encode(text: Column, encoder: Encoder = hashing_encoder, normalize: bool = True) -> Column:
    """``text`` as ARRAY<FLOAT>; ``encoder`` is called once a batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = np.asarray(encoder(texts.fillna("").tolist())).reshape(len(texts), -1)
            yield pd.Series(list(normalized(vectors) if normalize else vectors.astype(np.float32)), index=texts.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def encode_query(question: Column, prefix: str = "", encoder: Encoder = hashing_encoder) -> Column:
    """A question's vector; the prefix goes before questions only, never before chunks."""
    return encode(F.concat(F.lit(prefix), question), encoder)


def cache_misses(keyed: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """One row for each text_key of ``keyed`` that the cache lacks for ``model``; a bucketed cache is not shuffled."""
    known = cache.filter(F.col("model") == model).select("text_key")
    return keyed.dropDuplicates(["text_key"]).join(known, "text_key", "left_anti")


def prune_cache(cache: DataFrame, keyed: DataFrame, model: str) -> DataFrame:
    """The cache's rows of ``model`` whose key is used; rows of other models do not carry over."""
    return cache.filter(F.col("model") == model).join(keyed.select("text_key").distinct(), "text_key", "left_semi")


def encode_cached(chunks: DataFrame, cache: DataFrame | None, model: str, encoder: Encoder = hashing_encoder, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks with ``embedding`` and ``reused``; the cache for the next run). Only distinct misses are encoded."""
    keyed = chunks.withColumn("text_key", text_key(F.col("text")))
    schema = "model string, text_key string, embedding array<float>"
    cache = cache.select("model", "text_key", "embedding") if cache is not None else chunks.sparkSession.createDataFrame([], schema)
    missing = cache_misses(keyed.select("text_key", "text"), cache, model)
    new = materialize(missing.select(F.lit(model).alias("model"), "text_key", encode(F.col("text"), encoder, normalize).alias("embedding")))
    known = prune_cache(cache, keyed, model).dropDuplicates(["text_key"]).select("model", "text_key", "embedding")
    after = known.unionByName(new)
    flagged = known.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False))).drop("model")
    return keyed.join(flagged, "text_key", "left").drop("text_key"), after
