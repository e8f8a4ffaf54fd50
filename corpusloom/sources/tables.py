"""Index tables behind a version pointer, caches, and results that must not be computed twice."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_TABLES = ("chunks", "embeddings", "postings", "term_stats", "corpus_stats")
POINTER = "version string, published long, by_chunk boolean"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; where that is unset, only one machine may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet, so that no model runs twice and lost executors cost nothing."""
    path = scratch_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exploded(forward: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, chunk_id, tf, dl, and the columns of ``keep``) of a forward index."""
    return forward.select("chunk_id", "dl", *keep, F.explode("terms").alias("x")).select("x.term", "chunk_id", "x.tf", "dl", *keep)


def publish_index(tables: dict[str, DataFrame], root: str) -> str:
    """Writes every table under a new version, then adds a pointer to it; older versions and pointers stay as they are.

    An empty corpus publishes empty tables. In place of ``postings`` may stand ``forward``, the same a row a chunk, which is
    written so and read as postings. Returns the version.
    """
    version, by_chunk = uuid.uuid4().hex, "forward" in tables
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, time.time_ns(), by_chunk)], POINTER).coalesce(1).write.mode("append").json(f"{root}/current")
    return version


def read_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version published last."""
    last = spark.read.schema(POINTER).json(f"{root}/current").orderBy(F.desc("published"), F.desc("version")).first()
    table = lambda name: spark.read.parquet(f"{root}/{last['version']}/{name}")
    return {name: exploded(table("forward")) if name == "postings" and last["by_chunk"] else table(name) for name in INDEX_TABLES}


def count_chunks(index: dict[str, DataFrame]) -> int:
    return index["chunks"].count()


def fetch_chunks(index: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """The chunks whose chunk_id is among ``ids`` (chunk_id); unknown ids give no row.

    The ids are written first: by their size Spark sends few of them to the chunks instead of shuffling all texts.
    """
    return index["chunks"].join(materialize(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")


def write_cache(cache: DataFrame, path: str, partition: str = "model") -> None:
    """A cache table by model or generator, as a new folder: never the one that is being read."""
    cache.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_bucketed_cache(cache: DataFrame, path: str, buckets: int, key: str = "text_key") -> None:
    """A cache as a new folder of files bucketed and sorted by ``key``, so that a run joins it without shuffling it."""
    cache.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(_named())


def read_bucketed_cache(spark: SparkSession, path: str, schema: str, buckets: int, key: str = "text_key") -> DataFrame:
    """What ``write_bucketed_cache`` wrote, in this session or another; empty where there is nothing."""
    name = _named()
    try:
        spark.read.schema(schema).parquet(path)
    except PySparkException:
        return spark.createDataFrame([], schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _named() -> str:
    return f"bucketed_{uuid.uuid4().hex}"


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache table; what is not there or cannot be read counts as empty. Every file's footer is read to know that."""
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.option("mergeSchema", True).parquet(path)
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema])
    except (PySparkException, Py4JJavaError):
        return empty
