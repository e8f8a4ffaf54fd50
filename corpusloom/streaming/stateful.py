"""Incremental ingest with keyed state: every text is encoded the first time its content key is seen, in whatever batch.

Two queries read the arriving files. One chunks documents and appends the chunks; the other keys the chunks by content, and
keyed state lets only the first one through to the encoder. No batch reads what earlier ones wrote: what was seen is in the
state store, in shards by key. Keys that are kept for good are Spark's own streaming deduplication, without a call to Python
for a key; only keys that are to be forgotten need ``FirstSeen``. Both queries write through the file sink, whose log makes a
replayed batch count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from corpusloom.functions.text import text_key
from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.embedding import Encoder, encode, hashing_encoder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Of each key, the text of its first row ever; the state holds how many rows there were.

    A key is forgotten ``keep_ms`` after its last row.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.seen.get()[0] if self.seen.exists() else 0
        n, text = 0, None
        for pdf in rows:
            text = pdf["text"].iloc[0] if not n else text
            n += len(pdf)
        self.seen.update((before + n,))
        if not before:
            yield pd.DataFrame({"text_key": [key[0]], "text": [text]})

    def close(self) -> None:
        pass


def first_texts(chunks: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(text_key, text) of streamed ``chunks`` (text_key, text): each key once."""
    keyed = chunks.select("text_key", "text")
    if not keep_ms:
        return keyed.dropDuplicates(["text_key"])
    return keyed.groupBy("text_key").transformWithStateInPandas(FirstSeen(keep_ms), "text_key string, text string", "append", "ProcessingTime")


def ingest_with_state(spark: SparkSession, folder: str, chunks_path: str, cache_path: str, checkpoint: str, model: str, encoder: Encoder = hashing_encoder, schema: str = "source string, text string", chunk_size: int = 950, overlap: int = 100, keep_ms: int | None = None, files_per_batch: int | None = None) -> list[StreamingQuery]:
    """Starts both queries over Parquet files arriving in ``folder``; they end when they have read what is there."""
    stream = spark.readStream.schema(schema)
    documents = (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(folder)
    chunks = chunk_documents(documents, chunk_size=chunk_size, overlap=overlap).withColumn("text_key", text_key(F.col("text")))
    fresh = first_texts(chunks, keep_ms).select(F.lit(model).alias("model"), "text_key", encode(F.col("text"), encoder).alias("embedding"))

    def start(df: DataFrame, name: str, path: str) -> StreamingQuery:
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append").trigger(availableNow=True).start()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # keyed state lives there; a started query keeps the setting
    try:
        return [start(chunks, "chunks", chunks_path), start(fresh, "cache", cache_path)]
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
