"""The registered queries of the retrieval jobs, each over its whole tables, and the SQL that says what they return.

The given documents have no pages, headings or tables, so the cleaning and structure queries first turn every document
into a small book, line by line, in Spark; the SQL builds the same book.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from corpusloom import sql
from corpusloom.functions.text import text_key
from corpusloom.operators import augment, bm25, chunk_quality, chunking, clean, embedding, evaluate, prompt, retrieve, vectors
from corpusloom.plans import ingest
from corpusloom.sources import files, tables
from corpusloom.sources.tables import materialize, scratch_folder
from corpusloom.streaming.ingest import ingest_stream
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUT, STEP, TOP = 950, 100, 10


def query(says: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if says:
            ORACLES[f.__name__] = says.strip()
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------------------------------------ shared inputs


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text): each line of a document is a page with header, heading, body, references and footer."""
    numeral = lambda n: F.get(F.array(*map(F.lit, "一二三")), (F.floor((n - 1) / 10) % 3).cast("int"))

    def page(line: Column, i: Column) -> Column:
        n = i + 1
        chapter = F.concat(F.lit("第"), numeral(n), F.lit("章"))
        opening = F.when(n % 10 == 1, F.concat(F.lit("\n# "), chapter, F.lit(" "), F.col("source"), F.lit("\n\n"))).otherwise("")
        references = F.when(n % 10 == 0, "## 参考文献\n[1] a\n[2] b\n").otherwise("")
        return F.concat(F.lit("===== 第 "), n, F.lit(" 页 =====\n"), n, chapter, F.lit("\n"), opening, F.lit("## "), F.substring(line, 1, 20), F.lit("\n\n"), line, F.lit("\n\n"), references, n)

    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.array_join(F.transform(F.split("text", "\n"), page), "\n").alias("text"))


BOOKS = """
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
pages AS (SELECT doc_id, source, n, line, '第' || substr('一二三', CAST(((n - 1) // 10) % 3 AS INT) + 1, 1) || '章' AS chapter FROM lines),
parts AS (SELECT *, CASE WHEN n % 10 = 1 THEN chr(10) || '# ' || chapter || ' ' || source || chr(10) || chr(10) ELSE '' END AS opening,
  CASE WHEN n % 10 = 0 THEN '## 参考文献' || chr(10) || '[1] a' || chr(10) || '[2] b' || chr(10) ELSE '' END AS refs FROM pages)
"""


def rules(spark: SparkSession) -> DataFrame:
    """Page ranges of the sources with an even number; the other sources have none."""
    return spark.range(0, 20, 2).select(F.concat(F.lit("src"), F.col("id")).alias("source"), F.lit(3).alias("body_start"), F.lit(25).alias("index_start"))


def cut_chunks(spark: SparkSession, sf_dir: str, size: int = CUT) -> DataFrame:
    """Chunks of ``size`` characters: (chunk_id, source, idx, text, chapter, section), a document being a source."""
    docs = read(spark, sf_dir, "documents").filter("text <> ''")
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))  # goes through a text once; a substring seeks its start
    source = F.concat_ws("/", "source", "doc_id")
    rows = docs.select(source.alias("source"), F.posexplode(pieces).alias("idx", "text"))
    none = F.lit(None).cast("string")
    return rows.select(F.concat_ws("::", "source", "idx").alias("chunk_id"), "source", "idx", "text", none.alias("chapter"), none.alias("section"))


CHUNKS = f"""
WITH numbered AS (SELECT source || '/' || doc_id AS source, text, unnest(range(0, (length(text) - 1) // {CUT} + 1)) AS i FROM documents WHERE text <> ''),
chunks AS (SELECT source || '::' || i AS chunk_id, source, CAST(i AS INT) AS idx, substr(text, CAST(i AS INT) * {CUT} + 1, {CUT}) AS text FROM numbered)
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, by number."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")


# ----------------------------------------------------------------------------------------------------------- cleaning


@query(BOOKS + "SELECT doc_id, n AS page_no, 1 + len(string_split(chapter || opening || substr(line, 1, 20) || line || refs, chr(10))) + 4 AS n_lines FROM parts")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = books(spark, sf_dir).select("doc_id", F.explode(clean.split_pages(F.col("text"))).alias("p"))
    return pages.select("doc_id", F.col("p.page_no").cast("long").alias("page_no"), F.size("p.lines").cast("long").alias("n_lines"))


BODY = r"regexp_replace(opening || '## ' || substr(line, 1, 20) || chr(10) || chr(10) || line || chr(10) || chr(10) || rtrim(refs, chr(10)), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@query(BOOKS + f"""SELECT doc_id, n AS page_no, NOT (CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 AND (n < 3 OR n >= 25)) AS in_range, true AS changed,
{BODY} AS body FROM parts""")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.clean_pages(books(spark, sf_dir), rules(spark))
    return cleaned.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.page_no").cast("long").alias("page_no"), "p.in_range", "p.changed", "p.body")


CLEANED_TEXTS = BOOKS + f""", kept AS (SELECT doc_id, n, {BODY.replace("rtrim(refs, chr(10))", "''")} AS body, refs <> '' AS ref FROM parts
  WHERE NOT (CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 AND (n < 3 OR n >= 25))),
joined AS (SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY n) AS text, count(*) FILTER (ref) AS ref_blocks FROM kept GROUP BY doc_id),
cleaned AS (SELECT d.doc_id, source, coalesce(regexp_replace(regexp_replace(j.text, chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '') || chr(10) AS cleaned, coalesce(ref_blocks, 0) AS ref_blocks
FROM documents d LEFT JOIN joined j USING (doc_id))
"""


@query(CLEANED_TEXTS + "SELECT doc_id, cleaned, ref_blocks FROM cleaned")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.clean_text(clean.clean_pages(books(spark, sf_dir), rules(spark)))
    return cleaned.select("doc_id", "cleaned", F.col("ref_blocks").cast("long").alias("ref_blocks"))


@query(CLEANED_TEXTS + """, ruled AS (SELECT *, CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 AS ruled FROM parts)
SELECT source, count(*) AS pages, count(*) FILTER (ruled AND n < 3) AS dropped_front, count(*) FILTER (ruled AND n >= 25) AS dropped_index,
count(*) FILTER (NOT (ruled AND (n < 3 OR n >= 25))) AS pages_changed, count(*) FILTER (refs <> '' AND NOT (ruled AND (n < 3 OR n >= 25))) AS ref_blocks, chars FROM ruled JOIN (SELECT source, sum(length(cleaned))::BIGINT AS chars FROM cleaned GROUP BY 1) USING (source) GROUP BY source, chars""")
def cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaning_stats(clean.clean_pages(books(spark, sf_dir), rules(spark)), ["source"])


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, string_agg(line || CASE WHEN n % 3 = 2 THEN chr(10) || n || '第二章，留下' ELSE '' END, chr(10) ORDER BY n) AS text FROM lines GROUP BY 1""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running header of either kind after a document's lines, its page number close by or apart; one with a comma is none."""
    n = lambda i: (i + 1).cast("string")
    added = lambda i: F.when(i % 3 == 0, F.concat(n(i % 100), F.when(i % 2 == 0, " \u3000").otherwise(""), F.lit("第一章绪论"), n(i % 100))).when(i % 3 == 1, F.concat(n(i), F.lit("第二章，留下"))).otherwise(F.lit(" 血液实验诊断与应用 "))
    lines = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.array(x, added(i))))
    said = read(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    return said.select("doc_id", F.array_join(clean.drop_running_headers(F.col("lines")), "\n").alias("text"))


@query(f"""SELECT page_id, {sql.strip("regexp_replace(regexp_replace(html, '</?(div|html|body|span|p|img|br|table|tr|td|th)[^>]*>', '', 'gi') || chr(10) || '[表格]' || chr(10) || '| page | ' || page_id || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a b | 3 |' || chr(10) || 'between <120' || chr(10) || '[表格]' || chr(10) || '| x |' || chr(10) || '| --- |', chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two tables after them: with a header cell, inner tags, an empty row, and an angle bracket that is no tag between them."""
    table = F.concat(F.lit("<TABLE border=1><tr><th>page</th><td>"), "page_id", F.lit("</td></tr>\n<tr><td> </td></tr><tr><td>a<br/>b</td><td><i>3</i></td></tr></TABLE>\nbetween <120<table><tr><td>x</td></tr></table>"))
    return read(spark, sf_dir, "pages").select("page_id", clean.html_to_text(F.concat("html", table)).alias("text"))


LINE_CELLS = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, rows): an order's lines as rows of cells (an order has few lines)."""
    cells = lambda x: F.array(*[x[c].cast("string") for c in LINE_CELLS])
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*LINE_CELLS))).alias("lines"))
    return lines.select("l_orderkey", F.transform("lines", cells).alias("rows"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, text): an order's lines as a captioned Markdown table."""
    header = F.array(F.array(*map(F.lit, ("line", "part", "supplier", "flag", "status"))))
    table = clean.table_to_markdown(F.concat(header, F.col("rows")))
    return order_rows(spark, sf_dir).select("l_orderkey", F.concat(F.lit("表1 "), F.col("l_orderkey"), F.lit("\n\n[表格]\n"), table).alias("text"))


ORDER_ROW = "CAST(l_linenumber AS VARCHAR) || ' | ' || l_partkey || ' | ' || l_suppkey || ' | ' || l_returnflag || ' | ' || l_linestatus"
TABLE_SQL = f"'| line | part | supplier | flag | status |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg('| ' || {ORDER_ROW} || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)"


@query(f"SELECT l_orderkey, '表1 ' || l_orderkey || chr(10) || chr(10) || '[表格]' || chr(10) || {TABLE_SQL} AS text FROM lineitem GROUP BY l_orderkey")
def table_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tables(spark, sf_dir)


@query("""SELECT l_orderkey, chr(10) || '[表格]' || chr(10) || '| ' || string_agg(CAST(l_linenumber AS VARCHAR) || ' | ' || l_partkey || ' |', chr(10) || '| ' ORDER BY l_linenumber, l_partkey)
  FILTER (rn = 1) || chr(10) || '| --- | --- |' || coalesce(string_agg(chr(10) || '| ' || l_linenumber || ' | ' || l_partkey || ' |', '' ORDER BY l_linenumber, l_partkey) FILTER (rn > 1), '') AS text
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) GROUP BY l_orderkey""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as an HTML table, read back as a Markdown table."""
    rows = F.transform("rows", lambda r: F.concat(F.lit("<tr><td>"), F.get(r, F.lit(0)), F.lit("</td><td><b>"), F.get(r, F.lit(1)), F.lit("</b></td></tr>")))
    html = order_rows(spark, sf_dir).withColumn("html", F.concat(F.lit("<table>"), F.array_join(rows, "\n"), F.lit("</table>")))
    return html.select("l_orderkey", clean.html_table_to_markdown(F.col("html")).alias("text"))


@query(f"""SELECT l_orderkey, '表1 ' || l_orderkey || chr(10) || chr(10) || '[表格]' || chr(10) || {TABLE_SQL} || chr(10) || chr(10) || '【表格说明】' || chr(10) || '表1 ' || l_orderkey || chr(10) ||
string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_partkey || '、' || l_suppkey || '、' || l_returnflag || '、' || l_linestatus, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS text
FROM lineitem GROUP BY l_orderkey""")
def augment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tables(spark, sf_dir).select("l_orderkey", augment.augment_tables(F.col("text")).alias("text"))


@query("""SELECT ceil(l_orderkey / 8.0)::BIGINT AS page_no, CASE WHEN count(*) >= 10 AND count(*) FILTER (l_partkey % 500 < 250 - 20 AND l_partkey % 500 + l_suppkey % 97 > 250 + 20) / count(*) < 0.06
  AND count(*) FILTER ((2 * (l_partkey % 500) + l_suppkey % 97) / 2.0 < 250) > count(*) * 0.25
  AND count(*) - count(*) FILTER ((2 * (l_partkey % 500) + l_suppkey % 97) / 2.0 < 250) > count(*) * 0.25 THEN 2 ELSE 1 END AS n_columns FROM lineitem GROUP BY 1""")
def detect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes made of order lines: eight orders are a page 500 wide."""
    x0 = (F.col("l_partkey") % 500).cast("double")
    words = read(spark, sf_dir, "lineitem").select(F.ceil(F.col("l_orderkey") / 8).alias("page_no"), x0.alias("x0"), (x0 + F.col("l_suppkey") % 97).alias("x1"), F.lit(500.0).alias("page_width"))
    return clean.detect_columns(words, ["page_no"], least_words=10)


# ----------------------------------------------------------------------------------------------------------- chunking


DOCUMENT_CHUNKS = "WITH RECURSIVE input AS (SELECT source || '/' || doc_id AS source, text AS t FROM documents)," + sql.chunked(950, 100)
CLEANED = ORACLES["clean_text"]


@query(DOCUMENT_CHUNKS + "SELECT chunk_id, source, idx, text, chapter, section FROM chunked")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("source"), "text")
    return chunking.chunk_documents(docs)


@query(f"WITH RECURSIVE input AS (SELECT d.source || '/' || doc_id AS source, c.cleaned AS t FROM documents d JOIN ({CLEANED}) c USING (doc_id))," + sql.chunked(500, 80) + "SELECT chunk_id, source, idx, text, chapter, section FROM chunked")
def chunk_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and sections of the cleaned books, with overlap."""
    cleaned = clean.clean_text(clean.clean_pages(books(spark, sf_dir), rules(spark)))
    return chunking.chunk_documents(cleaned.select(F.concat_ws("/", "source", "doc_id").alias("source"), F.col("cleaned").alias("text")), chunk_size=500, overlap=80)


TABLE_BOOKS = f"""SELECT CAST(l_orderkey // 4 AS VARCHAR) AS source, '# 第一章 orders' || chr(10) || chr(10) || 'first; more!' || chr(10) || chr(10) || '## lines' || chr(10) || chr(10) || '表1 of ' || l_orderkey // 4 || chr(10) || chr(10) || '[表格]' || chr(10) ||
  {TABLE_SQL.replace("ORDER BY l_linenumber", "ORDER BY l_orderkey, l_linenumber")} || chr(10) || chr(10) || 'a;b!' || chr(10) || chr(10) || '| no | rows |' AS t FROM lineitem GROUP BY l_orderkey // 4"""


@query(f"WITH RECURSIVE input AS ({TABLE_BOOKS})," + sql.chunked(260, 60) + "SELECT chunk_id, source, idx, text, chapter, section FROM chunked")
def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose one long table has the lines of four orders: its rows go into groups under caption and header."""
    cells = F.array(*[F.col(c).cast("string") for c in LINE_CELLS])
    lines = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("book"), F.struct("l_orderkey", *LINE_CELLS, cells.alias("cells")).alias("line"))
    rows = lines.groupBy("book").agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["cells"]).alias("rows"))
    header = F.array(F.array(*map(F.lit, ("line", "part", "supplier", "flag", "status"))))
    text = F.concat(F.lit("# 第一章 orders\n\nfirst; more!\n\n## lines\n\n表1 of "), "book", F.lit("\n\n[表格]\n"), clean.table_to_markdown(F.concat(header, "rows")), F.lit("\n\na;b!\n\n| no | rows |"))
    return chunking.chunk_documents(materialize(rows.select(F.col("book").cast("string").alias("source"), text.alias("text"))), chunk_size=260, overlap=60)


@query(r"""WITH found AS (SELECT doc_id, regexp_extract_all(text, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$') AS s FROM documents),
rows AS (SELECT doc_id, list_filter(list_transform(s, lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS s FROM found)
SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM rows""")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(BOOKS + r""", body AS (SELECT doc_id, source, n, line, chapter FROM parts),
text AS (SELECT doc_id, string_agg((CASE WHEN n % 10 = 1 THEN '# ' || chapter || ' ' || source || chr(10) || chr(10) ELSE '' END) || '## ' || substr(line, 1, 20) || chr(10) || chr(10) || line, chr(10) || chr(10) ORDER BY n) AS t FROM body GROUP BY doc_id),
pieces AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\n[\s\p{Z}]*\n'), lambda x: trim(x, chr(10))), lambda x: regexp_replace(x, '[\s\p{Z}]+', '', 'g') <> '') AS b FROM text),
blocks AS (SELECT doc_id, unnest(range(0, len(b))) AS pos, unnest(b) AS block FROM pieces),
kinds AS (SELECT *, regexp_replace(block, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line,
  CASE WHEN regexp_matches(block, '^[\s\p{Z}]*(\[表格\]|\|)') THEN 'table' WHEN regexp_matches(block, '^[\s\p{Z}]*#{1,6}[\s\p{Z}]') AND NOT contains(regexp_replace(block, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), chr(10)) THEN 'heading' ELSE 'para' END AS kind FROM blocks),
marked AS (SELECT *, CASE WHEN kind = 'heading' THEN regexp_replace(line, '^#{1,6}[\s\p{Z}]*', '') END AS title FROM kinds),
chaptered AS (SELECT *, title IS NOT NULL AND regexp_matches(title, '^第[一二三四五六七八九十百零〇两]+章') AS is_chapter FROM marked),
numbered AS (SELECT *, sum(CAST(kind = 'heading' AS INT)) OVER w AS section_no, sum(CAST(is_chapter AS INT)) OVER w AS chapter_no,
  last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) OVER w AS heading, last_value(CASE WHEN is_chapter THEN title END IGNORE NULLS) OVER w AS chapter
  FROM chaptered WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
named AS (SELECT *, last_value(CASE WHEN kind = 'heading' AND NOT is_chapter THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, chapter_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM numbered)
SELECT doc_id, pos, kind, block AS text, CAST(section_no AS BIGINT) AS section_no, heading, chapter, section FROM named WHERE kind <> 'heading'""")
def heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.transform("pages", lambda p: p["body"])
    cleaned = clean.clean_pages(books(spark, sf_dir)).select("doc_id", clean.strip_references(clean.join_bodies(pages))["text"].alias("text"))
    rows = cleaned.select("doc_id", F.posexplode(chunking.merge_captions(chunking.split_blocks(F.col("text")))).alias("pos", "b")).select("doc_id", F.col("pos").cast("long").alias("pos"), "b.*")
    return chunking.heading_context(materialize(rows), "doc_id")


@query(CHUNKS + "SELECT chunk_id, source, idx FROM chunks")
def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_chunks(spark, sf_dir).select("chunk_id", chunking.parse_id(F.col("chunk_id")).alias("p")).select("chunk_id", "p.source", "p.idx")


# ------------------------------------------------------------------------------------- augmentation, caches, statistics


@query(r"""WITH wrapped AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>' || text || '</think> ' || text WHEN turn % 3 = 1 THEN text || '<think>' || text ELSE '<think>a' || chr(10) || 'b</think>' || text || '<think></think>' END AS t FROM conversations),
closed AS (SELECT conv_id, turn, regexp_replace(t, '(?s)<think>.*?</think>', '', 'g') AS t FROM wrapped)
SELECT conv_id, turn, CASE WHEN contains(t, '<think>') THEN '' ELSE regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS text FROM closed""")
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns wrapped in closed, open and repeated thoughts."""
    text, turn = F.col("text"), F.col("turn") % 3
    wrapped = F.when(turn == 0, F.concat(F.lit("<think>"), text, F.lit("</think> "), text)).when(turn == 1, F.concat(text, F.lit("<think>"), text)).otherwise(F.concat(F.lit("<think>a\nb</think>"), text, F.lit("<think></think>")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", augment.strip_think(wrapped).alias("text"))


def first_words(prompts: pd.Series) -> pd.Series:
    """A stand-in for a language model: repeats the prompt's last words; fails on prompts with a question mark."""
    return prompts.map(lambda p: None if "?" in p else "<think>x</think>" + " ".join(p.split(" ")[-3:]))


@query(r"""SELECT doc_id, CASE WHEN contains(text, '?') THEN text ELSE text || chr(10) || chr(10) || '【检索增强】' || chr(10) ||
 regexp_replace(substr(regexp_replace(array_to_string((string_split('3 ' || text, ' '))[-3:], ' '), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 1, 400), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS text,
 NOT contains(text, '?') AS enriched, false AS reused FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE lang = 'fr')
UNION ALL SELECT doc_id, text || chr(10) || chr(10) || '【检索增强】' || chr(10) || 'held ' || length(text), true, true FROM documents WHERE sha1(text) IN (SELECT sha1(text) FROM documents WHERE lang = 'fr')""")
def enrich_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all documents with a cache that holds other words for the French ones, and words of another generator."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held = lambda name, lang: docs.filter(F.col("lang") == lang).select(F.lit(name).alias("generator"), text_key(F.col("text")).alias("text_key"), F.concat(F.lit("held "), F.length("text")).alias("generated"))
    return augment.enrich_cached(docs.drop("lang"), held("default", "fr").unionByName(held("other", "de")), first_words, "{n} {chunk}")[0]


@query("SELECT sha1(text) AS text_key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy(text_key(F.col("text")).alias("text_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT DISTINCT sha1(text) AS text_key FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE lang = 'en')""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache that holds the English texts lacks."""
    keyed = read(spark, sf_dir, "documents").select("lang", text_key(F.col("text")).alias("text_key"))
    cache = keyed.filter("lang = 'en'").select(F.lit("m").alias("model"), "text_key")
    return embedding.cache_misses(keyed.select("text_key"), cache, "m")


@query("""SELECT DISTINCT sha1(text) AS text_key FROM documents WHERE lang IN ('en', 'fr') AND sha1(text) IN (SELECT sha1(text) FROM documents WHERE lang IN ('fr', 'de'))""")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of the English and French texts after a run over the French and German ones; another model's rows go."""
    keyed = read(spark, sf_dir, "documents").select("lang", text_key(F.col("text")).alias("text_key"))
    held = keyed.filter("lang IN ('en', 'fr')").select(F.lit("m").alias("model"), "text_key").distinct()
    other = keyed.select(F.lit("other").alias("model"), "text_key")
    return embedding.prune_cache(held.unionByName(other), keyed.filter("lang IN ('fr', 'de')"), "m").select("text_key")


@query("""SELECT doc_id, length(text) AS chars, lang = 'en' OR sha1(text) IN (SELECT sha1(text) FROM documents WHERE lang = 'en') AS reused FROM documents""")
def encode_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all documents with a cache of the English ones, by an encoder that gives a text's length."""
    import numpy as np

    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    cache = docs.filter("lang = 'en'").select(F.lit("length").alias("model"), text_key(F.col("text")).alias("text_key"), F.array(F.length("text").cast("float")).alias("embedding")).dropDuplicates(["text_key"])
    encoded, _ = embedding.encode_cached(docs, cache, "length", lambda texts: np.array([[len(t)] for t in texts]), normalize=False)
    return encoded.select("doc_id", F.get("embedding", F.lit(0)).cast("long").alias("chars"), "reused")


def by_dimension(encoded: DataFrame, key: str) -> DataFrame:
    rows = encoded.select(key, F.posexplode("embedding").alias("dim", "x"))
    return rows.select(key, F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value"))


BY_DIMENSION = "SELECT key AS {}, generate_subscripts(e, 1) - 1 AS dim, round(CAST(unnest(e) AS DOUBLE), 6) AS value FROM vectors"


@query(f"WITH keys AS (SELECT doc_id AS key FROM documents), tokens AS (SELECT doc_id AS key, unnest({sql.tokens('text')}) AS token FROM documents)," + sql.encoded() + BY_DIMENSION.format("doc_id"))
def encode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return by_dimension(docs.select("doc_id", embedding.encode(F.col("text")).alias("embedding")), "doc_id")


PREFIX = "为这个句子生成表示："


@query(f"WITH keys AS (SELECT item_id AS key FROM benchmark), tokens AS (SELECT item_id AS key, unnest({sql.tokens(f"'{PREFIX}' || text")}) AS token FROM benchmark)," + sql.encoded() + BY_DIMENSION.format("query_id"))
def encode_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions, with the prefix that only questions get."""
    asked = questions(spark, sf_dir)
    return by_dimension(asked.select("query_id", embedding.encode_query(F.col("question"), PREFIX).alias("embedding")), "query_id")


FLAGS = r"""
WITH d AS (SELECT doc_id, source, text, length(text) AS n, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
f AS (SELECT doc_id, source, n, n < 60 AS short, n > 950 * 1.2 AS long, len(ls) > 0 AND ((len(ls) >= 6 AND len(list_filter(ls, lambda x: length(x) <= 6)) > len(ls) * 0.5)
  OR len(regexp_extract_all(text, '\p{Nd}')) > n * 0.25) AS tab FROM d)
"""


@query(FLAGS + "SELECT doc_id, array_to_string(list_filter([CASE WHEN short THEN 'short' END, CASE WHEN long THEN 'long' END, CASE WHEN tab THEN 'table' END], lambda x: x IS NOT NULL), ',') AS flags FROM f")
def chunk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(chunk_quality.flags(F.col("text")), ",").alias("flags"))


@query(FLAGS + "SELECT count(DISTINCT source) AS documents, count(*) AS chunks, min(n) AS min_chars, CAST(floor(sum(n) / count(*)) AS BIGINT) AS mean_chars, max(n) AS max_chars, count(*) FILTER (short OR long OR tab) AS flagged FROM f")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_quality.corpus_stats(read(spark, sf_dir, "documents"))


@query(CHUNKS + "SELECT source, count(*) AS chunks FROM chunks GROUP BY source")
def chunks_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_quality.chunks_per_source(cut_chunks(spark, sf_dir))


@query(CHUNKS + """, keyed AS (SELECT source, text, sha1(text) AS k FROM chunks), held AS (SELECT DISTINCT k FROM keyed WHERE k < '8')
SELECT count(DISTINCT source) AS doc_files, count(*) AS chunks, count(h.k) AS reused, count(*) - count(h.k) AS to_encode FROM keyed LEFT JOIN held h USING (k)""")
def rebuild_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild with the cache that a run over about half of the chunks left."""
    chunks = cut_chunks(spark, sf_dir)
    _, cache = embedding.encode_cached(chunks.filter(text_key(F.col("text")) < "8"), None, "hashing")
    return chunk_quality.rebuild_stats(embedding.encode_cached(chunks, cache, "hashing")[0])


# ---------------------------------------------------------------------------------------------------------- retrieval

TOKENS = sql.tokens("text")
BM25 = f"WITH d AS MATERIALIZED (SELECT doc_id AS chunk_id, {TOKENS} AS t FROM documents)," + sql.BM25
SCORES = BM25 + f", q AS (SELECT item_id AS query_id, {TOKENS} AS t FROM benchmark)" + sql.scored("q") + f""",
bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {TOP})
"""


@query(BM25 + "SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, terms, _ = bm25.build_index(doc_chunks(spark, sf_dir))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(questions(spark, sf_dir), bm25.build_index(doc_chunks(spark, sf_dir)), TOP)


@query(SCORES + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_hits(spark, sf_dir).withColumn("score", F.round("score", 6))


VECTORS = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS len FROM v),
scored AS (SELECT q.vec_id AS query_id, n.vec_id AS chunk_id, round(list_inner_product(q.e, n.e) / (q.len * n.len), 9) AS score FROM n, n q WHERE q.vec_id % {STEP} = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {TOP})
"""


def near_vectors(spark: SparkSession, sf_dir: str, half: bool = False) -> DataFrame:
    """Every vector whose id is divisible by STEP against all vectors; ``half``: by their first 32 numbers."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    if half:
        v = v.withColumn("embedding", F.slice("embedding", 1, 32))
    return vectors.vector_topk(v.filter(F.col("chunk_id") % STEP == 0).withColumnRenamed("chunk_id", "query_id"), v, TOP)


@query(VECTORS + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM near")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, sf_dir).withColumn("score", F.round("score", 6))


HALF = VECTORS.replace("WITH v AS", "WITH v2 AS").replace("embedding, lambda x: CAST(x AS DOUBLE)", "list_slice(embedding, 1, 32), lambda x: CAST(x AS DOUBLE)").replace("WITH ", ", ").replace("FROM v)", "FROM v2)").replace(" n AS", " n2 AS").replace("FROM n, n q", "FROM n2, n2 q").replace("n.vec_id AS chunk_id", "n2.vec_id AS chunk_id").replace("n.e)", "n2.e)").replace("n.len", "n2.len").replace("scored", "scored2").replace("near AS", "near2 AS")
FUSED = VECTORS + HALF + f""", fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS ra, b.rank AS rb,
  round(coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0), 12) AS rrf FROM near a FULL JOIN near2 b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
ranked AS (SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM fused)
"""


@query(FUSED + "SELECT query_id, chunk_id, round(rrf, 9) AS rrf, CAST(rank AS INT) AS rank FROM ranked")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by whole vectors and by their first halves, fused."""
    return retrieve.rrf_fuse(near_vectors(spark, sf_dir), near_vectors(spark, sf_dir, half=True)).withColumn("rrf", F.round("rrf", 9))


@query(CHUNKS + """SELECT c.source, c.idx, string_agg(n.idx || ':' || length(n.text), ',' ORDER BY n.idx) AS near FROM chunks c JOIN chunks n ON c.source = n.source AND n.idx BETWEEN c.idx - 2 AND c.idx + 2
WHERE length(c.text) < 300 GROUP BY 1, 2""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every short chunk."""
    chunks = cut_chunks(spark, sf_dir)
    short = chunks.filter(F.length("text") < 300).select("source", "idx")
    near = F.transform("window", lambda w: F.concat(w["idx"], F.lit(":"), F.length(w["text"])))
    return retrieve.context_window(short, chunks, 2).select("source", "idx", F.array_join(near, ",").alias("near"))


SHORT = 200


@query(CHUNKS.replace(str(CUT), str(SHORT)) + ", store AS (SELECT source, idx, text FROM chunks), hits AS (SELECT chunk_id AS h, source, idx, text FROM chunks)," + sql.expanded() + "SELECT source, idx, expanded, low || '-' || high AS span, grown_text AS text FROM grown")
def expand_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of 200 characters as a hit, grown by its neighbours."""
    chunks = cut_chunks(spark, sf_dir, SHORT)
    hits = chunks.withColumns({"query_id": F.col("chunk_id"), "rank": F.lit(1)})
    return retrieve.expand_short_hits(hits, chunks).select("source", "idx", "expanded", F.array_join("expanded_span", "-").alias("span"), "text")


HITS = SCORES + """, hits AS (SELECT b.query_id, b.rank, d.source, d.text FROM bm b JOIN documents d ON d.doc_id = b.chunk_id WHERE b.rank <= 4)
"""


def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    few = materialize(bm25_hits(spark, sf_dir).filter("rank <= 4"))  # of known size, so that texts need no shuffle
    return few.join(doc_chunks(spark, sf_dir), "chunk_id").withColumns({"chapter": none, "section": none})


@query(HITS + """SELECT q.item_id AS query_id, '请根据' || chr(10) || coalesce((SELECT string_agg('[来源:' || source || '] ' || text, chr(10) || chr(10) ORDER BY rank) FROM hits h WHERE h.query_id = q.item_id), '(无)') || chr(10) || q.text AS prompt,
coalesce((SELECT string_agg(source, ',' ORDER BY rank) FROM hits h WHERE h.query_id = q.item_id), '') AS retrieved_sources FROM benchmark q""")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prompt.build_prompts(questions(spark, sf_dir), top_hits(spark, sf_dir), "请根据\n{context}\n{question}")
    return made.select("query_id", "prompt", F.array_join("retrieved_sources", ",").alias("retrieved_sources"))


@query(HITS + """, firsts AS (SELECT query_id, source, min(rank) AS r FROM hits GROUP BY 1, 2)
SELECT q.item_id AS query_id, coalesce((SELECT string_agg(source, ',' ORDER BY r) FROM firsts f WHERE f.query_id = q.item_id), '') AS sources FROM benchmark q""")
def ordered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.build_prompts(questions(spark, sf_dir), top_hits(spark, sf_dir)).select("query_id", F.array_join("sources", ",").alias("sources"))


@query(HITS + "SELECT query_id, string_agg(source || ':' || length(text) || ':false', ',' ORDER BY rank) AS retrieval FROM hits GROUP BY 1")
def retrieval_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prompt.payload(top_hits(spark, sf_dir))
    return got.select("query_id", F.array_join(F.transform("retrieval", lambda h: F.concat_ws(":", h["source"], F.length(h["text"]), h["expanded"])), ",").alias("retrieval"))


@query(SCORES + f""", words AS (SELECT item_id, list_distinct({TOKENS}) AS w FROM benchmark),
r AS (SELECT b.query_id, b.chunk_id, b.rank AS before, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: list_contains(d.t, x))) / len(w) END, 9) AS s FROM bm b JOIN words ON item_id = b.query_id JOIN d ON d.chunk_id = b.chunk_id),
o AS (SELECT query_id, chunk_id, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, before) AS rank FROM r QUALIFY rank <= 4)
SELECT query_id, chunk_id, rerank_score, CAST(rank AS INT) AS rank FROM o""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25_hits(spark, sf_dir).join(doc_chunks(spark, sf_dir), "chunk_id").join(questions(spark, sf_dir), "query_id")
    return retrieve.rerank(hits, 4).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def hybrid(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("source"), "text")
    tables, _, _ = ingest.build_tables(docs, linearize=False)  # chunks as they are, tables too
    asked = questions(spark, sf_dir).withColumn("embedding", embedding.encode_query(F.col("question")))
    return retrieve.retrieve(materialize(asked), tables["chunks"], (tables["postings"], tables["term_stats"], tables["corpus_stats"]), tables["embeddings"], retrieve.Settings(**settings))


HYBRID = DOCUMENT_CHUNKS + f""", c AS MATERIALIZED (SELECT *, {TOKENS} AS t FROM chunked), d AS (SELECT chunk_id, t FROM c), q AS MATERIALIZED (SELECT item_id AS query_id, text AS question, {TOKENS} AS t FROM benchmark),
{sql.BM25} {sql.scored("q")},
filled AS (SELECT q.query_id, c.chunk_id, c.source, c.idx, coalesce(s.score, 0.0) AS score FROM q CROSS JOIN c LEFT JOIN scored s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id),
lexical AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, idx) AS rank FROM filled QUALIFY rank <= 20),
keys AS (SELECT 'q' || query_id AS key FROM q UNION ALL SELECT 'c' || chunk_id FROM c), tokens AS (SELECT 'q' || query_id AS key, unnest(t) AS token FROM q UNION ALL SELECT 'c' || chunk_id, unnest(t) FROM c),
{sql.encoded()},
qu AS MATERIALIZED (SELECT query_id, u FROM q JOIN directions ON key = 'q' || query_id), cu AS MATERIALIZED (SELECT chunk_id, u FROM c JOIN directions ON key = 'c' || chunk_id),
near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(qu.u, cu.u), 9) DESC, chunk_id) AS rank FROM qu CROSS JOIN cu QUALIFY rank <= 20),
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS ra, b.rank AS rb, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0), 12) AS rrf
  FROM near a FULL JOIN lexical b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, ra NULLS LAST, rb NULLS LAST) AS before FROM fused QUALIFY before <= 20),
again AS (SELECT p.query_id, p.chunk_id, c.source, c.idx, c.text, before, round(CASE WHEN len(q.t) = 0 THEN 0 ELSE len(list_filter(list_distinct(q.t), lambda x: list_contains(c.t, x))) / len(list_distinct(q.t)) END, 9) AS s FROM pool p JOIN q USING (query_id) JOIN c USING (chunk_id)),
hits AS (SELECT query_id || ' ' || row_number() OVER w AS h, query_id, row_number() OVER w AS rank, chunk_id, source, idx, text, s FROM again WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, before) QUALIFY rank <= 4),
store AS (SELECT source, idx, text FROM c),
{sql.expanded()}
"""


@query(HYBRID + "SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, source, round(s, 6) AS rerank_score, expanded, grown_text AS text FROM grown")
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of it: chunks, index, both searches, fusion, reranking and expansion for every benchmark passage."""
    return hybrid(spark, sf_dir).select("query_id", "rank", "chunk_id", "source", F.round("rerank_score", 6).alias("rerank_score"), "expanded", "text")


def _filled(context: str, question: str) -> str:
    """The default prompt as SQL."""
    before, rest = prompt.TEMPLATE.split("{context}")
    middle, after = rest.split("{question}")
    return " || ".join([f"'{before}'", context, f"'{middle}'", question, f"'{after}'"])


ANSWERS = HITS + f""", prompts AS (SELECT q.item_id AS query_id, q.text AS question, {_filled("coalesce((SELECT string_agg('[来源:' || source || '] ' || text, chr(10) || chr(10) ORDER BY rank) FROM hits h WHERE h.query_id = q.item_id), '(无)')", "q.text")} AS prompt FROM benchmark q),
answered AS (SELECT query_id, question, CASE WHEN NOT contains(prompt, '?') THEN '<think>x</think>' || array_to_string(string_split(prompt, ' ')[-3:], ' ') END AS answer, (SELECT list(source ORDER BY rank) FROM hits h WHERE h.query_id = p.query_id) AS sources FROM prompts p)
"""


@query(ANSWERS + "SELECT query_id, answer, '' AS no_answer FROM answered")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in generator's answers to the default prompt."""
    prompts = prompt.build_prompts(questions(spark, sf_dir), top_hits(spark, sf_dir))
    return prompt.answers(prompts, first_words, 1).select("query_id", "answer", F.lit("").alias("no_answer"))


@query("SELECT item_id AS query_id, '知识库为空,请先导入文档并重建索引。' AS answer, 0::BIGINT AS n_sources FROM benchmark")
def answers_of_an_empty_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = top_hits(spark, sf_dir).limit(0)
    made = prompt.answers(prompt.build_prompts(questions(spark, sf_dir), none), first_words, 0)
    return made.select("query_id", "answer", F.size("sources").cast("long").alias("n_sources"))


REPORT = ANSWERS + """, gold AS (SELECT b.item_id AS query_id, min_by(d.source, d.doc_id) AS gold_source FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)
SELECT a.query_id, a.question, '' AS reference, a.answer, g.gold_source, array_to_string(coalesce(a.sources, []), ',') AS retrieved_sources, coalesce(list_contains(a.sources, g.gold_source), false) AS source_hit FROM answered a JOIN gold g USING (query_id)"""


@query(REPORT)
def answers_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in generator's answers, and whether the gold document was among the sources."""
    prompts = prompt.build_prompts(questions(spark, sf_dir), top_hits(spark, sf_dir))
    answered = prompt.answers(prompts, first_words, 1)
    return evaluate.answers_report(gold(spark, sf_dir), answered).withColumn("retrieved_sources", F.array_join("retrieved_sources", ","))


@query(REPORT)
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as JSON lines and read back."""
    report, path = answers_report(spark, sf_dir), scratch_folder(spark, "report")
    files.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


# --------------------------------------------------------------------------------------------------------- evaluation


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with the least document that has them literally."""
    asked, docs = read(spark, sf_dir, "benchmark").select("item_id", "text"), read(spark, sf_dir, "documents")
    found = evaluate.literal_pairs(asked, docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("item_id").agg(F.min(F.struct("doc_id", "source")).alias("g"))
    out = asked.join(found, "item_id")
    return out.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("").alias("answer"), F.col("g.doc_id").alias("gold_id"), F.col("g.source").alias("gold_source"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists (query_id, stage, chunk_id, rank): BM25, and the same reranked."""
    first = materialize(bm25_hits(spark, sf_dir))
    again = retrieve.rerank(first.join(doc_chunks(spark, sf_dir), "chunk_id").join(questions(spark, sf_dir), "query_id"), TOP)
    return first.select("query_id", F.lit("bm25").alias("stage"), "chunk_id", "rank").unionByName(again.select("query_id", F.lit("reranked").alias("stage"), "chunk_id", "rank"))


GOLD = SCORES + f""", words AS (SELECT item_id, list_distinct({TOKENS}) AS w FROM benchmark),
re AS (SELECT b.query_id, b.chunk_id, row_number() OVER (PARTITION BY b.query_id ORDER BY round(len(list_filter(w, lambda x: list_contains(d.t, x))) / len(w), 9) DESC, b.rank) AS rank FROM bm b JOIN words ON item_id = b.query_id JOIN d ON d.chunk_id = b.chunk_id),
lists AS (SELECT 'bm25' AS stage, query_id, chunk_id, rank FROM bm UNION ALL SELECT 'reranked', query_id, chunk_id, rank FROM re),
gold AS (SELECT b.item_id AS query_id, min(d.doc_id) AS gold_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
ranks AS (SELECT g.query_id, s.stage, l.rank FROM gold g, (SELECT DISTINCT stage FROM lists) s LEFT JOIN lists l ON l.query_id = g.query_id AND l.stage = s.stage AND l.chunk_id = g.gold_id)
"""


@query(GOLD + "SELECT stage, round(avg(coalesce(CAST(rank = 1 AS INT), 0)), 6) AS hit_at_1, round(avg(coalesce(CAST(rank <= 4 AS INT), 0)), 6) AS hit_at_k, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(rank) AS found, count(*) AS n FROM ranks GROUP BY stage")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(evaluate.gold_ranks(gold(spark, sf_dir), staged(spark, sf_dir)), 4)


@query(GOLD + "SELECT query_id, CAST(max(rank) FILTER (stage = 'bm25') AS INT) AS bm25, CAST(max(rank) FILTER (stage = 'reranked') AS INT) AS reranked FROM ranks GROUP BY 1")
def eval_rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rank_table(evaluate.gold_ranks(gold(spark, sf_dir), staged(spark, sf_dir)), ["bm25", "reranked"])


@query(VECTORS + HALF + """, gold AS (SELECT query_id, chunk_id FROM near WHERE rank = 2),
lists AS (SELECT 'whole' AS model, * FROM near UNION ALL SELECT 'half', * FROM near2),
ranks AS (SELECT g.query_id, m.model, b.rank FROM gold g, (VALUES ('whole'), ('half')) m(model) LEFT JOIN lists b ON b.query_id = g.query_id AND b.model = m.model AND b.chunk_id = g.chunk_id)
SELECT model, 'vector' AS stage, round(avg(coalesce(CAST(rank = 1 AS INT), 0)), 6) AS hit_at_1, round(avg(coalesce(CAST(rank <= 4 AS INT), 0)), 6) AS hit_at_k, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(rank) AS found, count(*) AS n FROM ranks GROUP BY model""")
def compare_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and halved vectors on one test set: the nearest other vector is gold."""
    whole, half = materialize(near_vectors(spark, sf_dir)), near_vectors(spark, sf_dir, half=True)
    lists = whole.withColumn("model", F.lit("whole")).unionByName(half.withColumn("model", F.lit("half"))).withColumn("stage", F.lit("vector"))
    testset = whole.filter("rank = 2").select("query_id", F.col("chunk_id").alias("gold_id"))
    return evaluate.metrics(evaluate.gold_ranks(testset, lists, ["model", "stage"]), 4, ["model", "stage"])


@query(VECTORS + """, nearest AS (SELECT query_id, chunk_id FROM near WHERE rank = 3), g AS (SELECT s.query_id, s.score AS gs FROM scored s JOIN nearest USING (query_id, chunk_id))
SELECT query_id, 'whole' AS variant, count(*) FILTER (score > gs) + 1 AS rank FROM scored JOIN g USING (query_id) GROUP BY 1""")
def full_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rank over all vectors by counting the higher scores; the third nearest vector is gold."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    gold = near_vectors(spark, sf_dir).filter("rank = 3").select("query_id", F.col("chunk_id").alias("gold_id"))
    testset = gold.join(v.withColumnRenamed("chunk_id", "query_id"), "query_id")
    return vectors.gold_ranks(materialize(testset), v).withColumn("variant", F.lit("whole"))


VARIANTS = f"""WITH original AS (SELECT l_orderkey, '表1 ' || l_orderkey || chr(10) || chr(10) || '[表格]' || chr(10) || {TABLE_SQL} AS text FROM lineitem GROUP BY 1), sentences AS ({ORACLES["augment_tables"]}),
said AS (SELECT 'original' AS variant, * FROM original UNION ALL SELECT 'tables', * FROM sentences), asked AS (SELECT l_orderkey, '表1 ' || list(l_linenumber || ':' || l_partkey || '、' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey)[1] AS question FROM lineitem WHERE l_orderkey % 100 = 0 GROUP BY 1),
keys AS (SELECT variant || l_orderkey AS key FROM said UNION ALL SELECT 'q' || l_orderkey FROM asked),
tokens AS (SELECT variant || l_orderkey AS key, unnest({sql.tokens("text")}) AS token FROM said UNION ALL SELECT 'q' || l_orderkey, unnest({sql.tokens("question")}) FROM asked),
{sql.encoded()},
qu AS MATERIALIZED (SELECT l_orderkey AS query_id, u FROM asked JOIN directions ON key = 'q' || l_orderkey), cu AS MATERIALIZED (SELECT variant, l_orderkey AS chunk_id, u FROM said JOIN directions ON key = variant || l_orderkey),
scores AS MATERIALIZED (SELECT query_id, variant, chunk_id, round(list_inner_product(qu.u, cu.u), 9) AS score FROM qu CROSS JOIN cu)
SELECT s.query_id, s.variant, count(*) FILTER (s.score > g.score) + 1 AS rank FROM scores s JOIN scores g ON g.query_id = s.query_id AND g.variant = s.variant AND g.chunk_id = s.query_id GROUP BY 1, 2"""


@query(VARIANTS)
def table_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of orders' tables over all orders, as they are and with their rows as sentences; every hundredth order's first line is asked for."""
    told = materialize(order_tables(spark, sf_dir).select(F.col("l_orderkey").alias("chunk_id"), "text"))
    first = read(spark, sf_dir, "lineitem").filter("l_orderkey % 100 = 0").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    testset = first.select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("表1 "), "x.l_linenumber", F.lit(":"), "x.l_partkey", F.lit("、"), "x.l_suppkey").alias("question"), F.col("l_orderkey").alias("gold_id"))
    return evaluate.variant_ranks(testset, told, {"original": F.col("text"), "tables": augment.augment_tables(F.col("text"))})


@query(f"""WITH gold AS (SELECT b.item_id AS query_id, any_value(b.text) AS question, min(d.doc_id) AS gold_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
keys AS (SELECT 'c' || doc_id AS key FROM documents UNION ALL SELECT 'q' || query_id FROM gold), tokens AS (SELECT 'c' || doc_id AS key, unnest({TOKENS}) AS token FROM documents UNION ALL SELECT 'q' || query_id, unnest({sql.tokens("question")}) FROM gold),
{sql.encoded()},
qu AS MATERIALIZED (SELECT query_id, gold_id, u FROM gold JOIN directions ON key = 'q' || query_id), cu AS MATERIALIZED (SELECT doc_id AS chunk_id, u FROM documents JOIN directions ON key = 'c' || doc_id),
scores AS MATERIALIZED (SELECT query_id, gold_id, chunk_id, round(list_inner_product(qu.u, cu.u), 9) AS score FROM qu CROSS JOIN cu)
SELECT s.query_id, variant, count(*) FILTER (s.score > g.score) + 1 AS rank FROM scores s JOIN scores g ON g.query_id = s.query_id AND g.chunk_id = g.gold_id, (VALUES ('original'), ('tables')) v(variant) GROUP BY 1, 2""")
def full_ranks_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each passage's literal document over all documents, encoded as they are and with their tables as sentences."""
    variants = {"original": F.col("text"), "tables": augment.augment_tables(F.col("text"))}
    return evaluate.variant_ranks(gold(spark, sf_dir), doc_chunks(spark, sf_dir), variants)


STAGES = f"""WITH gold AS MATERIALIZED (SELECT b.item_id AS query_id, any_value(b.text) AS question, min(d.doc_id) AS gold_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
d AS MATERIALIZED (SELECT doc_id AS chunk_id, {TOKENS} AS t FROM documents), q AS MATERIALIZED (SELECT query_id, {sql.tokens("question")} AS t FROM gold),
{sql.BM25} {sql.scored("q")},
lexical AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 30),
keys AS (SELECT 'q' || query_id AS key FROM q UNION ALL SELECT 'c' || chunk_id FROM d), tokens AS MATERIALIZED (SELECT 'q' || query_id AS key, unnest(t) AS token FROM q UNION ALL SELECT 'c' || chunk_id, unnest(t) FROM d),
{sql.encoded(64, "_wide")}, {sql.encoded(16, "_narrow")},
known AS MATERIALIZED (SELECT 'hashing' AS model, * FROM directions_wide UNION ALL SELECT 'hashing-16', * FROM directions_narrow),
near AS MATERIALIZED (SELECT x.model, query_id, chunk_id, row_number() OVER (PARTITION BY x.model, query_id ORDER BY round(list_inner_product(x.u, y.u), 9) DESC, chunk_id) AS rank FROM q JOIN known x ON x.key = 'q' || query_id JOIN known y ON y.model = x.model JOIN d ON y.key = 'c' || chunk_id QUALIFY rank <= 30),
other AS (SELECT model, l.* FROM lexical l, (VALUES ('hashing'), ('hashing-16')) m(model)),
fused AS (SELECT coalesce(a.model, b.model) AS model, coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS ra, b.rank AS rb, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0), 12) AS rrf
  FROM near a FULL JOIN other b ON a.model = b.model AND a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
pool AS MATERIALIZED (SELECT model, query_id, chunk_id, row_number() OVER (PARTITION BY model, query_id ORDER BY rrf DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM fused QUALIFY rank <= 30),
again AS (SELECT model, p.query_id, p.chunk_id, row_number() OVER (PARTITION BY model, p.query_id ORDER BY round(CASE WHEN len(q.t) = 0 THEN 0 ELSE len(list_filter(list_distinct(q.t), lambda x: list_contains(d.t, x))) / len(list_distinct(q.t)) END, 9) DESC, p.rank) AS rank FROM pool p JOIN q USING (query_id) JOIN d USING (chunk_id)),
lists AS (SELECT 'vector' AS stage, * FROM near UNION ALL SELECT 'hybrid', * FROM pool UNION ALL SELECT 'reranked', * FROM again),
ranks AS (SELECT g.query_id, k.model, k.stage, l.rank FROM gold g CROSS JOIN (SELECT DISTINCT model, stage FROM lists) k LEFT JOIN lists l ON l.query_id = g.query_id AND l.model = k.model AND l.stage = k.stage AND l.chunk_id = g.gold_id)
SELECT model, stage, round(avg(coalesce(CAST(rank = 1 AS INT), 0)), 6) AS hit_at_1, round(avg(coalesce(CAST(rank <= 4 AS INT), 0)), 6) AS hit_at_k, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, count(rank) AS found, count(*) AS n FROM ranks GROUP BY ALL"""


@query(STAGES)
def compare_encoders_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two widths of the default encoder by vector, hybrid and reranked lists, 30 deep; a passage's literal document is gold."""
    testset, chunks = materialize(gold(spark, sf_dir)), doc_chunks(spark, sf_dir)
    asked = testset.select("query_id", "question")
    lexical = materialize(bm25.search(asked, bm25.build_index(chunks), 30))
    encoders = {"hashing": embedding.hashing_encoder, "hashing-16": partial(embedding.hashing_encoder, dim=16)}
    lists = materialize(evaluate.staged_by_model(asked, chunks, lexical, encoders, 30))
    return evaluate.metrics(evaluate.gold_ranks(testset, lists, ["model", "stage"]), 4, ["model", "stage"])


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '问题: ' || substr(text, 1, turn % 7) || chr(10) || '答案: ' || text ELSE '问题：' || text END AS t FROM conversations),
p AS (SELECT conv_id, turn, regexp_replace(regexp_extract(t, '问题[:：][\\s]*([^\\n]+)', 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS question, regexp_replace(regexp_extract(t, '答案[:：][\\s]*((?s:.+))', 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS answer FROM t)
SELECT conv_id, turn, CASE WHEN length(question) >= 4 THEN question END AS question, CASE WHEN length(question) >= 4 THEN answer END AS answer FROM p""")
def parse_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, turn = F.col("text"), F.col("turn")
    made = F.when(turn % 2 == 0, F.concat(F.lit("问题: "), F.substring(text, F.lit(1), (turn % 7).cast("int")), F.lit("\n答案: "), text)).otherwise(F.concat(F.lit("问题："), text))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.parse_qa(made).alias("qa")).select("conv_id", "turn", "qa.question", "qa.answer")


@query(CHUNKS + "SELECT chunk_id, source, substr(text, 1, 1200) AS passage FROM chunks WHERE length(text) >= 200")
def sample_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of a sample, of which a test set takes the first of the seeded order."""
    return evaluate.sample_passages(cut_chunks(spark, sf_dir), seed=7).drop("sample_key")


@query(CHUNKS + f""", drawn AS (SELECT chunk_id, source, substr(text, 1, 1200) AS p FROM chunks WHERE length(text) >= 200),
asked AS (SELECT *, '问题: ' || substr(p, 1, 30) || chr(10) || '答案: ' || substr(p, 31, 30) AS t FROM drawn),
qa AS (SELECT *, {sql.strip("regexp_extract(t, '问题[:：][\\s]*([^\\n]+)', 1)")} AS question, {sql.strip("regexp_extract(t, '答案[:：][\\s]*((?s:.+))', 1)")} AS answer FROM asked)
SELECT chunk_id AS query_id, question, answer, chunk_id AS gold_id, source AS gold_source FROM qa WHERE length(question) >= 4 ORDER BY md5('7:' || chunk_id), chunk_id LIMIT 20""")
def make_testset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty questions by a stand-in generator that asks for a passage's first words."""

    def ask(passages: pd.Series) -> pd.Series:
        return passages.map(lambda p: f"问题: {p[:30]}\n答案: {p[30:60]}")

    return evaluate.make_testset(cut_chunks(spark, sf_dir), 20, 7, ask)


# ----------------------------------------------------------------------------------------------------- sources and sinks


TALKS = """WITH talks AS (SELECT conv_id, 'conversation ' || conv_id || chr(10) || string_agg(coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) AS text FROM conversations WHERE conv_id % 10 <> 0 GROUP BY 1)
"""


def talk_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one text file a conversation; every tenth is blank."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    text = F.concat(F.lit("conversation "), "conv_id", F.lit("\n"), F.array_join(F.transform("t", lambda x: x["text"]), "\n"))
    folder = scratch_folder(spark, "texts")
    turns.select(F.when(F.col("conv_id") % 10 == 0, " \t\u3000").otherwise(text).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def talk_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\S+ (\d+)", 1).cast("long")


@query(TALKS + "SELECT conv_id, md5(text) AS digest FROM talks")
def text_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as text files and read back; blank files are left out."""
    found = files.read_text_folder(spark, talk_files(spark, sf_dir))
    return found.select(talk_number(F.col("text")).alias("conv_id"), F.md5("text").alias("digest"))


def shouted(raw: bytes) -> str:
    """A stand-in for a parser: capital letters; fails on the conversations whose number is divisible by three."""
    text = raw.decode()
    number = text.partition("\n")[0].rpartition(" ")[2]
    if number.isdigit() and int(number) % 3 == 0:
        raise ValueError(f"conversation {number}")
    return text.replace("a", "A")


@query(TALKS + "SELECT CASE WHEN conv_id % 3 <> 0 THEN md5(replace(text, 'a', 'A')) END AS digest, CASE WHEN conv_id % 3 = 0 THEN 'ValueError: conversation ' || conv_id END AS error FROM talks")
def parsed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files through a parser that fails on some: those are rows of the errors table."""
    good, bad = files.read_parsed_folder(spark, talk_files(spark, sf_dir), {"txt": shouted})
    return good.select(F.md5("text").alias("digest"), F.lit(None).cast("string").alias("error")).unionByName(bad.select(F.lit(None).cast("string").alias("digest"), "error"))


@query("SELECT text AS question, '' AS answer, 'item::' || item_id AS gold_id, CAST(NULL AS VARCHAR) AS gold_source, sha1(text || chr(10) || 'item::' || item_id) AS query_id FROM benchmark")
def testset_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages written as a test set, a JSON array, and read back."""
    path = scratch_folder(spark, "testset")
    items = read(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), F.lit("").alias("answer"), F.concat(F.lit("item::"), "item_id").alias("gold_id"), F.lit(None).cast("string").alias("gold_source"))
    files.write_testset(items, path)
    return files.read_testset(spark, path)


@query(CHUNKS + "SELECT chunk_id, text, (SELECT count(*) FROM chunks) AS n_chunks FROM chunks WHERE idx = 0 AND CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) % 100 = 0")
def published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index published twice, first of some chunks, then of all; chunks of the last version fetched by id."""
    root, chunks = scratch_folder(spark, "index"), materialize(cut_chunks(spark, sf_dir))
    for part in (chunks.filter("idx = 0"), chunks):
        index = bm25.build_index(part)
        vectors_ = part.select("chunk_id", F.array(F.length("text").cast("float")).alias("embedding"))
        tables.publish_index({"chunks": part, "embeddings": vectors_, **index.tables()}, root)
    index = tables.read_index(spark, root)
    ids = read(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select(F.concat("source", F.lit("/"), "doc_id", F.lit("::0")).alias("chunk_id"))
    asked = ids.unionByName(spark.createDataFrame([("nowhere::0",)], "chunk_id string"))
    return tables.fetch_chunks(index, asked).select("chunk_id", "text", F.lit(tables.count_chunks(index)).cast("long").alias("n_chunks"))


@query("""SELECT 'french' AS cache, count(DISTINCT sha1(text)) AS n FROM documents WHERE lang = 'fr' UNION ALL SELECT 'all', count(*) FROM (SELECT DISTINCT lang, sha1(text) FROM documents) UNION ALL SELECT 'other model', 0 UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'unreadable', 0""")
def cache_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with a model for each language, one model read back; another, a missing folder and files of another kind count as empty."""
    schema, path, broken = "model string, text_key string, embedding array<float>", scratch_folder(spark, "cache"), scratch_folder(spark, "broken")
    docs = read(spark, sf_dir, "documents")
    keyed = docs.select(F.col("lang").alias("model"), text_key(F.col("text")).alias("text_key"), F.array(F.length("text").cast("float")).alias("embedding")).dropDuplicates(["model", "text_key"])
    tables.write_cache(keyed, path)
    spark.range(3).select(F.lit("no table").alias("value")).coalesce(1).write.option("compression", "none").text(f"{broken}/part")
    held = tables.read_cache(spark, path, schema)
    found = {"french": held.filter("model = 'fr'"), "all": held, "other model": held.filter("model = 'german'"), "missing": tables.read_cache(spark, f"{path}-none", schema), "unreadable": tables.read_cache(spark, f"{broken}/part", schema)}
    out = None
    for name, cache in found.items():
        row = cache.agg(F.lit(name).alias("cache"), F.count("text_key").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(DOCUMENT_CHUNKS + "SELECT source, count(*) AS chunks, sum(length(text))::BIGINT AS chars, count(*) AS cached FROM chunked GROUP BY 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as files: chunks of every batch, and how many of their texts the cache then holds."""
    root = scratch_folder(spark, "stream")
    read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("source"), "text").write.parquet(f"{root}/in")
    ingest_stream(spark, f"{root}/in", f"{root}/chunks", f"{root}/cache", f"{root}/checkpoint", "hashing").awaitTermination()
    cached = spark.read.parquet(f"{root}/cache").select("text_key").distinct().withColumn("held", F.lit(1))
    rows = spark.read.parquet(f"{root}/chunks").join(cached, "text_key", "left")
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.count("held").alias("cached"))
