"""A BM25 index that grows by segments: documents are added, changed and deleted without a rebuild.

A commit writes one segment: the chunks of new and changed sources with their postings, the sources that it takes away from
older segments (tombstones), and what it changes in document frequencies and lengths. Postings are kept a row a chunk. Nothing
older is touched; the commit counts once a manifest file names its segment, so a reader sees the state before or after it.
Statistics are sums of the segments' changes, and equal those of a rebuild. ``merge`` writes what is left as one segment.

Defined cases: a source that comes again with the same chunks is left alone; one that is both given and deleted is
deleted; deleting an unknown source does nothing; an empty commit makes no segment; null texts are empty; rows without
source are refused by the filter and not indexed.
"""

from __future__ import annotations

import time
import uuid

from corpusloom.functions.text import tokens
from corpusloom.operators import bm25
from corpusloom.sources.tables import materialize
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "published long, last int, segments array<string>"
#: Postings lie in so many folders by a hash of their source, so that a commit reads those of the touched sources only.
BUCKETS = 64
SCHEMAS = {
    "sources": "source string, n long, d1 long, d2 long, seg int",
    "removed": "source string, seg int",
    "frequencies": "term string, df long",
    "totals": "n_docs long, n_tokens long",
}


def bucket(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


class SegmentedIndex:
    """``chunk_id`` is of the type ``id_type``; chunks are (chunk_id, source, text)."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "string", tokenizer: bm25.Tokenizer = tokens) -> None:
        self.spark, self.root, self.tokenizer = spark, root.rstrip("/"), tokenizer
        self.schemas = SCHEMAS | {
            "chunks": f"chunk_id {id_type}, source string, text string, seg int",
            "postings": f"chunk_id {id_type}, dl long, terms array<struct<term:string,tf:long>>, source string, seg int, bucket int",
        }

    # ------------------------------------------------------------------------------------------------------- reading

    def manifest(self) -> tuple[int, list[str]]:
        """(number of the last segment, paths of those in force)."""
        try:
            row = self.spark.read.schema(MANIFEST).json(f"{self.root}/current").orderBy(F.desc("published")).first()
        except Exception as e:  # the first commit finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return (row["last"], list(row["segments"])) if row else (0, [])

    def table(self, name: str, segments: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{s}/{name}" for s in (self.manifest()[1] if segments is None else segments)]
        schema = self.schemas[name]
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = None  # one read for each segment, as their partition folders have different roots
        for path in paths:
            part = self.spark.read.schema(schema).parquet(path)
            out = part if out is None else out.unionByName(part)
        return out

    def live(self, name: str, segments: list[str] | None = None) -> DataFrame:
        """Rows of ``name`` that no later segment took away."""
        segments = self.manifest()[1] if segments is None else segments
        newest = self.table(name, segments[-1:])  # tombstones are for older segments
        if len(segments) < 2:
            return newest
        gone = self.table("removed", segments).groupBy("source").agg(F.max("seg").alias("__gone"))
        rows = self.table(name, segments[:-1]).join(gone, "source", "left")
        return rows.filter(F.col("__gone").isNull() | (F.col("seg") >= F.col("__gone"))).drop("__gone").unionByName(newest)

    def index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings, term_stats, corpus_stats) as ``bm25.search`` takes them: by chunk, unless two sources share an id."""
        segments = self.manifest()[1]
        totals = self.table("totals", segments).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"))
        stats = materialize(totals.select("n_docs", F.when(F.col("n_docs") > 0, F.col("n") / F.col("n_docs")).alias("avgdl")))
        counted = self.table("frequencies", segments).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        rows = self.live("postings", segments).select("chunk_id", "dl", "terms")
        index = bm25.Index((bm25.exploded(rows), materialize(bm25.term_weights(counted, F.col("n_docs"), stats)), stats))
        index.forward = rows if bm25.distinct_ids(self.live("postings", segments).select("chunk_id")) else None
        return index

    # ------------------------------------------------------------------------------------------------------- writing

    def _publish(self, last: int, segments: list[str]) -> None:
        self.spark.createDataFrame([(time.time_ns(), last, segments)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/current")

    def _write(self, segment: str, name: str, df: DataFrame) -> None:
        columns = [c.split()[0] for c in self.schemas[name].split(", ")]
        writer = df.select(*columns).write
        (writer.partitionBy("bucket") if "bucket" in columns else writer).parquet(f"{self.root}/{segment}/{name}")

    @staticmethod
    def digests(chunks: DataFrame) -> DataFrame:
        """(source, n, d1, d2): number of chunks and two order-free hashes of them, summed up before any shuffle."""
        row = F.struct("chunk_id", "text")
        return chunks.groupBy("source").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(row)).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("d2"))

    def commit(self, given: DataFrame | None = None, deleted: DataFrame | None = None) -> bool:
        """Adds or replaces the sources of ``given`` (chunk_id, source, text), then takes those of ``deleted`` (source) away.

        True if there was anything to do.
        """
        last, segments = self.manifest()
        number = last + 1
        first = not segments and deleted is None
        none = self.spark.createDataFrame([], "source string")
        deleted = none if deleted is None else deleted.select(F.col("source").cast("string").alias("source")).filter("source IS NOT NULL").distinct()
        held = self.live("sources", segments).drop("seg")
        chunks = self.spark.createDataFrame([], self.schemas["chunks"]).drop("seg") if given is None else given.select("chunk_id", F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text")).filter("source IS NOT NULL")
        fresh = self.digests(chunks).join(deleted, "source", "left_anti")  # small rows, not texts
        changed = materialize(fresh.join(held, ["source", "n", "d1", "d2"], "left_anti"))
        removed = materialize(held.select("source").join(changed.select("source").unionByName(deleted), "source", "left_semi"))
        if not changed.limit(1).count() and not removed.limit(1).count():
            return False
        segment = f"{number:06d}-{uuid.uuid4().hex}"
        seg = F.lit(number)
        fresh_chunks = chunks if first else chunks.join(changed, "source", "left_semi")  # at first all are new: no shuffle of texts
        self._write(segment, "chunks", fresh_chunks.withColumn("seg", seg))
        added = self.table("chunks", [segment])
        self._write(segment, "sources", changed.withColumn("seg", seg))
        self._write(segment, "removed", removed.withColumn("seg", seg))
        self._write(segment, "postings", self._counted(added).withColumn("seg", seg).withColumn("bucket", bucket(F.col("source"))))
        terms = self.table("postings", [segment]).select("terms", F.lit(1).alias("by"))
        docs = added.select(F.lit(1).alias("by"))
        if segments:
            touched = [r["b"] for r in removed.select(bucket(F.col("source")).alias("b")).distinct().collect()]  # at most BUCKETS
            lost = self.live("postings", segments).filter(F.col("bucket").isin(touched)).join(removed, "source", "left_semi")
            terms = terms.unionByName(lost.select("terms", F.lit(-1).alias("by")))
            docs = docs.unionByName(self.live("chunks", segments).join(removed, "source", "left_semi").select(F.lit(-1).alias("by")))
        each = terms.select(F.explode("terms").alias("x"), "by").groupBy(F.col("x.term").alias("term"))
        change = materialize(each.agg(F.sum("by").cast("long").alias("df"), F.sum(F.col("x.tf") * F.col("by")).alias("n")))
        self._write(segment, "frequencies", change.filter("df <> 0"))
        n_docs, n_tokens = docs.agg(F.coalesce(F.sum("by"), F.lit(0)).alias("n_docs")), change.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
        self._write(segment, "totals", n_docs.join(F.broadcast(n_tokens), how="cross"))
        self._publish(number, [*segments, segment])
        return True

    def _counted(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, dl, terms, source) of chunks; rows of one source that share an id and a length are brought together."""
        rows = bm25.counted_rows(chunks, tokenizer=self.tokenizer, keep=("source",))
        if bm25.distinct_ids(chunks):
            return rows
        posted, _ = bm25.postings(materialize(rows), ("source",))
        return posted.groupBy("chunk_id", "dl", "source").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))

    def merge(self) -> None:
        """What is left, as one segment without tombstones; readers of the older ones are not disturbed."""
        last, segments = self.manifest()
        if len(segments) < 2:
            return
        number = last + 1
        segment, seg = f"{number:06d}-{uuid.uuid4().hex}", F.lit(number)
        for name in ("chunks", "sources", "postings"):
            self._write(segment, name, self.live(name, segments).withColumn("seg", seg))
        self._write(segment, "removed", self.spark.createDataFrame([], self.schemas["removed"]))
        self._write(segment, "frequencies", self.table("frequencies", segments).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"))
        self._write(segment, "totals", self.table("totals", segments).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_tokens")]))
        self._publish(number, [segment])
