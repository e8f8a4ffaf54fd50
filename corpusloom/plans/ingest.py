"""From documents to a published index."""

from __future__ import annotations

from corpusloom.operators import augment, bm25, chunk_quality, chunking, embedding
from corpusloom.sources.segments import SegmentedIndex
from corpusloom.sources.tables import materialize, publish_index
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_tables(documents: DataFrame, cache: DataFrame | None = None, model: str = "hashing", encoder: embedding.Encoder = embedding.hashing_encoder, chunk_size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP, linearize: bool = True) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(index tables, next cache, one row of statistics) of documents (source, text)."""
    chunks = chunked(documents, chunk_size, overlap, linearize)
    encoded, after = embedding.encode_cached(chunks, cache, model, encoder)
    encoded = materialize(encoded)
    posted, terms, stats = bm25.build_index(chunks)
    tables = {"chunks": chunks, "embeddings": encoded.select("chunk_id", "embedding"), "postings": posted, "term_stats": terms, "corpus_stats": stats}
    return tables, after, chunk_quality.rebuild_stats(encoded)


def chunked(documents: DataFrame, chunk_size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP, linearize: bool = True) -> DataFrame:
    """Chunks of documents (source, text), with their tables as sentences if ``linearize``."""
    chunks = chunking.chunk_documents(documents, chunk_size=chunk_size, overlap=overlap)
    return materialize(chunks.withColumn("text", augment.augment_tables(F.col("text"))) if linearize else chunks)


def update(index: SegmentedIndex, documents: DataFrame | None = None, deleted: DataFrame | None = None, **settings) -> bool:
    """New and changed ``documents`` (source, text) into a growing index, and ``deleted`` sources out of it.

    A document without chunks any more counts as deleted. True if the index changed.
    """
    if documents is None:
        return index.commit(None, deleted)
    chunks = chunked(documents, **settings)
    gone = documents.select("source").join(chunks.select("source"), "source", "left_anti")
    return index.commit(chunks, gone if deleted is None else gone.unionByName(deleted.select("source")))


def rebuild(documents: DataFrame, root: str, **settings) -> DataFrame:
    """Builds all tables first and publishes them together; returns the statistics."""
    tables, _, stats = build_tables(documents, **settings)
    publish_index(tables, root)
    return stats
