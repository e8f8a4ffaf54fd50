"""Structure-aware chunking, and the same block structure as relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from corpusloom.functions.text import SPACE, WHITE, is_blank, let, strip
from corpusloom.operators import _pack
from corpusloom.sources.tables import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK_SIZE, OVERLAP = 950, 100
#: Chapters of giant documents that a task packs at a time.
PARTS = 64

# Patterns, as in the packing helper.
SENTENCE = r"[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+\z"
BLANK_LINES = rf"\n[{SPACE}]*\n"
HEADING = rf"^#{{1,6}}[{SPACE}]"
HEADING_MARK = rf"^#{{1,6}}[{SPACE}]*"
CHAPTER = r"^第[一二三四五六七八九十百零〇两]+章"
CAPTION, CAPTION_CHARS = rf"^表[{SPACE}]*\p{{Nd}}", 40


def split_sentences(text: Column) -> Column:
    """Array of sentences with their terminators; the ASCII full stop ends none."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")


def block_kind(block: Column) -> Column:
    left, line = F.ltrim(block, F.lit(WHITE)), strip(block)
    table = left.startswith("[表格]") | left.startswith("|")
    return F.when(table, "table").when(~line.contains("\n") & line.rlike(HEADING), "heading").otherwise("para")


def split_blocks(text: Column) -> Column:
    """Array of (kind, text) between blank lines."""
    pieces = F.filter(F.transform(F.split(text, BLANK_LINES), lambda b: F.btrim(b, F.lit("\n"))), lambda b: ~is_blank(b))
    return F.transform(pieces, lambda b: F.struct(block_kind(b).alias("kind"), b.alias("text")))


def merge_captions(blocks: Column) -> Column:
    """Blocks with each short caption moved into the table right after it."""

    def caption(b: Column) -> Column:
        line = strip(b["text"])
        return (b["kind"] == "para") & (F.length(line) < CAPTION_CHARS) & line.rlike(CAPTION)

    def moved(b: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        joined = F.when((b["kind"] == "table") & F.coalesce(caption(before), F.lit(False)), F.concat(strip(before["text"]), F.lit("\n\n"), b["text"])).otherwise(b["text"])
        gone = caption(b) & F.coalesce(after["kind"] == "table", F.lit(False))
        return F.when(~gone, F.struct(b["kind"].alias("kind"), joined.alias("text")))

    return F.filter(F.transform(blocks, moved), lambda b: b.isNotNull())


def heading_context(blocks: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos, kind, text) to body blocks with section_no, heading, chapter and section; one window a document."""
    order = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_heading = F.col("kind") == "heading"
    title = F.regexp_replace(strip(F.col("text")), HEADING_MARK, "")
    marked = blocks.withColumn("__title", F.when(is_heading, title)).withColumn("__chapter", F.coalesce(F.col("__title").rlike(CHAPTER), F.lit(False)))
    numbered = marked.withColumns({
        "section_no": F.sum(is_heading.cast("int")).over(order),
        "chapter_no": F.sum(F.col("__chapter").cast("int")).over(order),
        "heading": F.last(F.when(is_heading, strip(F.col("text"))), ignorenulls=True).over(order),
        "chapter": F.last(F.when(F.col("__chapter"), F.col("__title")), ignorenulls=True).over(order),
    })
    inside = W.partitionBy(key, "chapter_no").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    named = numbered.withColumn("section", F.last(F.when(is_heading & ~F.col("__chapter"), F.col("__title")), ignorenulls=True).over(inside))
    return named.filter("kind <> 'heading'").select(key, "pos", "kind", "text", "section_no", "heading", "chapter", "section")


def chunk_documents(documents: DataFrame, source_col: str = "source", text_col: str = "text", chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, source, idx, text, chapter, section): chunks of every document, numbered from 0. No shuffle."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(c.text, c.chapter, c.section) for c in _pack.chunks(t, chunk_size, overlap)])

    split = F.pandas_udf(run, "array<struct<text string, chapter string, section string>>")
    rows = documents.select(F.col(source_col).alias("source"), F.posexplode(split(F.col(text_col))).alias("idx", "c"))
    return rows.select(F.concat_ws("::", "source", "idx").alias("chunk_id"), "source", "idx", "c.*")


def chapter_parts(text: Column, chunk_size: int) -> Column:
    """Array of parts of a text, each an array of (kind, text) blocks: cut where a chapter of another name than the last one starts.

    Neither captions nor fragments are ever joined over such a start, so parts can be packed apart. A text of one short
    line is a single block of the kind ``plain``.
    """

    def starts(blocks: Column) -> Column:
        title = lambda b: F.regexp_replace(strip(b["text"]), HEADING_MARK, "")
        chapters = F.filter(F.transform(blocks, lambda b, i: F.when((b["kind"] == "heading") & title(b).rlike(CHAPTER), F.struct(i.alias("at"), title(b).alias("title")))), lambda c: c.isNotNull())
        return let(chapters, lambda cs: F.transform(F.filter(cs, lambda c, k: (k == 0) | (c["title"] != F.get(cs, k - 1)["title"])), lambda c: c["at"]))

    def cut(blocks: Column) -> Column:
        edges = F.concat(F.array(F.lit(0)), starts(blocks))
        parts = let(edges, lambda es: F.transform(es, lambda at, k: F.slice(blocks, at + 1, F.coalesce(F.get(es, k + 1), F.size(blocks)) - at)))
        return F.filter(parts, lambda p: F.size(p) > 0)

    def parts(t: Column) -> Column:
        plain = F.array(F.array(F.struct(F.lit("plain").alias("kind"), t.alias("text"))))
        return F.when(t == "", F.slice(plain, F.lit(1), F.lit(0))).when((F.length(t) <= chunk_size) & ~t.contains("\n"), plain).otherwise(let(merge_captions(split_blocks(t)), cut))

    return let(strip(F.coalesce(text, F.lit(""))), parts)


def chunk_giants(documents: DataFrame, source_col: str = "source", text_col: str = "text", chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The rows of ``chunk_documents``, for documents too long for one task each: their chapters are dealt over all tasks.

    Built-in functions cut a text into chapters; chapters are shuffled and packed apart, and chunks are numbered by sums of
    their numbers, of which a document has one a chapter. Sources are distinct.
    """

    rows = documents.select(F.col(source_col).alias("source"), F.posexplode(chapter_parts(F.col(text_col), chunk_size)).alias("part", "blocks"))
    made = f"source {dict(rows.dtypes)['source']}, part int, c array<struct<text string, chapter string, section string>>, n int"
    schema = to_arrow_schema(StructType.fromDDL(made))

    def one(blocks: list[dict]) -> list[dict]:
        found = [(b["kind"], b["text"]) for b in blocks]
        if found and found[0][0] == "plain":
            return [{"text": found[0][1], "chapter": None, "section": None}]
        return [vars(c) for c in _pack.chunks_of(found, chunk_size, overlap)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):  # so many chapters are Python's strings at a time, however many a batch has
                some = batch.slice(at, PARTS)
                chunks = [one(blocks) for blocks in some["blocks"].to_pylist()]
                columns = [some["source"], some["part"], pa.array(chunks, type=schema.field("c").type), pa.array([len(c) for c in chunks], type=pa.int32())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    packed = materialize(rows.repartition("source", "part").mapInArrow(run, made))
    before = F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = packed.select("source", "part", F.coalesce(before, F.lit(0)).alias("base"))
    each = packed.select("source", "part", F.posexplode("c").alias("at", "c")).join(bases, ["source", "part"])
    numbered = each.withColumn("idx", (F.col("base") + F.col("at")).cast("int"))
    return numbered.select(F.concat_ws("::", "source", "idx").alias("chunk_id"), "source", "idx", "c.*")


def parse_id(chunk_id: Column) -> Column:
    """Struct (source, idx) from ``source::idx``, split at the last ``::``; nulls where the number is none."""
    pattern = r"(?s)^(.*)::[\x{9}-\x{d}\x{20}]*([+-]?\d+)[\x{9}-\x{d}\x{20}]*\z"
    number = F.regexp_extract(chunk_id, pattern, 2).try_cast("int")
    return F.struct(F.when(number.isNotNull(), F.regexp_extract(chunk_id, pattern, 1)).alias("source"), number.alias("idx"))
