"""Incremental ingest: new document rows are chunked, and only texts that the cache lacks are encoded."""

from __future__ import annotations

from corpusloom.functions.text import text_key
from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.embedding import Encoder, cache_misses, encode, hashing_encoder
from corpusloom.sources.tables import materialize, read_cache
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CACHE = "model string, text_key string, embedding array<float>, batch long"


def ingest_batch(rows: DataFrame, number: int, chunks_path: str, cache_path: str, model: str, encoder: Encoder = hashing_encoder, chunk_size: int = 950, overlap: int = 100) -> None:
    """Chunks one batch and encodes what the other batches' caches lack.

    A batch writes folders of its own and does not read them, so a replay writes the same rows again.
    """
    spark = rows.sparkSession
    chunks = materialize(chunk_documents(rows, chunk_size=chunk_size, overlap=overlap).withColumn("text_key", text_key(F.col("text"))))
    others = read_cache(spark, cache_path, CACHE).filter(F.col("batch") != number)
    missing = cache_misses(chunks.select("text_key", "text"), others, model)
    fresh = materialize(missing.select(F.lit(model).alias("model"), "text_key", encode(F.col("text"), encoder).alias("embedding")))
    fresh.write.mode("overwrite").parquet(f"{cache_path}/batch={number}")
    chunks.write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")


def ingest_stream(spark: SparkSession, folder: str, chunks_path: str, cache_path: str, checkpoint: str, model: str, encoder: Encoder = hashing_encoder, schema: str = "source string, text string", chunk_size: int = 950, overlap: int = 100) -> StreamingQuery:
    """Starts a query over Parquet files arriving in ``folder``; it ends when it has read what is there.

    Deletions and BM25 statistics come from the batch rebuild.
    """

    def batch(rows: DataFrame, number: int) -> None:
        ingest_batch(rows, number, chunks_path, cache_path, model, encoder, chunk_size, overlap)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
