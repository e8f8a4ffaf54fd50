"""Registered queries of the pruned, approximate and growing indexes, bucketed caches, token-wise generation and page text.

Importing this module completes the registry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from corpusloom import sql
from corpusloom.functions.text import SPACE, text_key
from corpusloom.operators import ann, augment, blockmax, bm25, chunking, clean, embedding, segment, vectors
from corpusloom.operators.models import Loaded, Tokens
from corpusloom.queries import DOCUMENT_CHUNKS, ORACLES, QUERIES, SCORES, STEP, TOKENS, TOP, VECTORS, books, doc_chunks, query, questions, read, rules
from corpusloom.sources.segments import SegmentedIndex
from corpusloom.sources.tables import materialize, read_bucketed_cache, scratch_folder, write_bucketed_cache
from corpusloom.streaming.stateful import ingest_with_state
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["ORACLES", "QUERIES"]

# ------------------------------------------------------------------------------------------------------ block-max BM25


def pruned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return blockmax.search(questions(spark, sf_dir), blockmax.build_blocks(bm25.build_index(doc_chunks(spark, sf_dir))), TOP)


@query(SCORES + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm")
def bm25_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the exhaustive search, from the blocks that can hold them."""
    return pruned(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@query()
def bm25_blockmax_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each question, how many of its windows and postings were scored."""
    return pruned(spark, sf_dir)[1]


# ------------------------------------------------------------------------------------------- approximate vector search


def listed_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ann.VectorIndex]:
    """(questions, vectors, index): every vector whose id is divisible by STEP asks for its neighbours among all."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return v.filter(F.col("chunk_id") % STEP == 0).withColumnRenamed("chunk_id", "query_id"), v, ann.build(v, ann.fit(v, TOP))


@query()
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact top-k that probing some lists finds, and how many vectors' codes were scored for it."""
    asked, v, index = listed_vectors(spark, sf_dir)
    found = materialize(ann.search(asked, index, TOP))
    work = found.groupBy("query_id").agg(F.max("n_scored").alias("n_scored"))
    return ann.recall(found, vectors.vector_topk(asked, v, TOP)).join(work, "query_id")


@query(VECTORS + "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM near")
def ann_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists probed, with many candidates rescored, and what may still reach those checked: the exact rows."""
    asked, _, index = listed_vectors(spark, sf_dir)
    found = ann.search(asked, index, TOP, probes=len(index.quantizer.centroids), depth=40 * TOP, exact=True)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------------------------------------------------ growing index


def grown(spark: SparkSession, sf_dir: str) -> SegmentedIndex:
    """All but the French documents come first; then those, with German ones changed, Spanish ones deleted and the rest unchanged."""
    docs = read(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("source"), "text", "lang")
    index = SegmentedIndex(spark, scratch_folder(spark, "segments"), "long")
    index.commit(chunks.filter("lang IS DISTINCT FROM 'fr'"))
    changed = chunks.filter("lang = 'de'").withColumn("text", F.concat(F.lit("neu "), "text"))
    index.commit(changed.unionByName(chunks.filter("lang IN ('fr', 'en')")), chunks.filter("lang = 'es'"))
    return index


LEFT = f"""WITH d AS MATERIALIZED (SELECT doc_id AS chunk_id, {TOKENS} AS t FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'neu ' || text ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'es')),""" + sql.BM25


@query(LEFT + f", q AS (SELECT item_id AS query_id, {TOKENS} AS t FROM benchmark)" + sql.scored("q") + f"""
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored QUALIFY rank <= {TOP}""")
def segmented_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits of an index of two segments, after additions, changes and deletions."""
    return bm25.search(questions(spark, sf_dir), grown(spark, sf_dir).index(), TOP).withColumn("score", F.round("score", 6))


@query(LEFT + "SELECT term, df, round(idf, 6) AS idf, (SELECT count(*) FROM post p WHERE p.term = terms.term) AS postings FROM terms")
def segmented_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term statistics of the same index once it is merged, and the postings that are left of each term."""
    index = grown(spark, sf_dir)
    index.merge()
    posted, terms, _ = index.index()
    return terms.join(posted.groupBy("term").agg(F.count("*").alias("postings")), "term").select("term", "df", F.round("idf", 6).alias("idf"), "postings")


@query(DOCUMENT_CHUNKS + "SELECT source, count(*) AS chunks, sum(length(text))::BIGINT AS chars, count(*) AS cached FROM chunked GROUP BY 1")
def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as files, in several batches: chunks, and how many of their texts were encoded once by then."""
    root = scratch_folder(spark, "stateful")
    read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("source"), "text").repartition(4).write.parquet(f"{root}/in")
    for started in ingest_with_state(spark, f"{root}/in", f"{root}/chunks", f"{root}/cache", f"{root}/checkpoint", "hashing", files_per_batch=2):
        started.awaitTermination()
    # a text that was encoded twice would count twice
    cached = spark.read.parquet(f"{root}/cache").select("text_key").withColumn("held", F.lit(1))
    rows = spark.read.parquet(f"{root}/chunks").join(cached, "text_key", "left")
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.count("held").alias("cached"))


# ------------------------------------------------------------------------------- bucketed caches, generation, page text

BUCKETS = 16


@query("""SELECT doc_id, length(text) AS chars, sha1(text) IN (SELECT sha1(text) FROM documents WHERE lang = 'en') AS reused FROM documents""")
def encode_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all documents with a bucketed cache of the English ones, by an encoder that each worker loads once."""
    docs, path = read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), scratch_folder(spark, "bucketed")
    lengths = docs.filter("lang = 'en'").select(F.lit("length").alias("model"), text_key(F.col("text")).alias("text_key"), F.array(F.length("text").cast("float")).alias("embedding"))
    write_bucketed_cache(lengths.dropDuplicates(["text_key"]), path, BUCKETS)
    cache = read_bucketed_cache(spark, path, "model string, text_key string, embedding array<float>", BUCKETS)
    encoded, _ = embedding.encode_cached(docs, cache, "length", Loaded("length", text_lengths), normalize=False)
    return encoded.select("doc_id", F.get("embedding", F.lit(0)).cast("long").alias("chars"), "reused")


def text_lengths() -> Callable:
    """A stand-in for a model that is loaded: gives each text's length."""
    import numpy as np

    return lambda texts: np.array([[len(t)] for t in texts])


def endless() -> Callable[[str], Iterator[str]]:
    """A stand-in for a language model that never stops by itself: says the prompt's words again and again."""

    def stream(prompt: str) -> Iterator[str]:
        while True:
            for word in prompt.split(" "):
                yield word + " "

    return stream


@query(f"""SELECT doc_id, text || CASE WHEN said <> '' THEN chr(10) || chr(10) || '【检索增强】' || chr(10) || said ELSE '' END AS text, said <> '' AS enriched
FROM (SELECT doc_id, text, {sql.strip("substr(repeat(text || ' ', CAST(2400 // (length(text) + 1) + 1 AS INT)), 1, 400)")} AS said FROM documents)""")
def enrich_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document enriched by a generator that has to be stopped."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return augment.enrich_cached(docs, None, Tokens(Loaded("endless", endless)), "{chunk}")[0].drop("reused")


BOXES = """WITH boxes AS (SELECT ceil(l_orderkey / 8.0)::BIGINT AS page_no, (l_partkey % 500)::DOUBLE AS x0, (l_partkey % 500 + l_suppkey % 97)::DOUBLE AS x1, (l_linenumber * 12 + l_suppkey % 5)::DOUBLE AS top, l_partkey || '/' || l_suppkey AS text FROM lineitem),
"""


@query(BOXES + """cols AS (SELECT page_no, CASE WHEN count(*) >= 10 AND count(*) FILTER (x0 < 230 AND x1 > 270) / count(*) < 0.06 AND count(*) FILTER ((x0 + x1) / 2 < 250) > count(*) * 0.25
  AND count(*) - count(*) FILTER ((x0 + x1) / 2 < 250) > count(*) * 0.25 THEN 2 ELSE 1 END AS n_columns FROM boxes GROUP BY 1),
placed AS (SELECT *, CAST(n_columns = 2 AND (x0 + x1) / 2 >= 250 AS INT) AS c FROM boxes JOIN cols USING (page_no)),
starts AS (SELECT *, CAST(coalesce(top - lag(top) OVER w, 0) > 3 AS INT) AS new FROM placed WINDOW w AS (PARTITION BY page_no, c ORDER BY top, x0, text)),
lined AS (SELECT *, sum(new) OVER (PARTITION BY page_no, c ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS line FROM starts),
lines AS (SELECT page_no, n_columns, c, line, string_agg(text, ' ' ORDER BY x0, top, text) AS text FROM lined GROUP BY ALL)
SELECT page_no, n_columns, string_agg(text, chr(10) ORDER BY c, line) AS text FROM lines GROUP BY ALL""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of word boxes made of order lines, read column by column."""
    x0 = (F.col("l_partkey") % 500).cast("double")
    top = (F.col("l_linenumber") * 12 + F.col("l_suppkey") % 5).cast("double")
    words = read(spark, sf_dir, "lineitem").select(F.ceil(F.col("l_orderkey") / 8).alias("page_no"), x0.alias("x0"), (x0 + F.col("l_suppkey") % 97).alias("x1"), top.alias("top"), F.lit(500.0).alias("page_width"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("text"))
    return clean.page_text(words, ["page_no"], least_words=10)


# --------------------------------------------------------------------------------------------- dictionary segmentation

LETTERS = r"[\p{L}\p{N}]+"


@query(f"""WITH RECURSIVE words AS (SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS}) AS word FROM documents) WHERE length(word) <= {segment.LONGEST} GROUP BY 1 HAVING count(*) >= {segment.LEAST}),
weights AS (SELECT word, CAST(round(1000000 * (ln(n) - ln((SELECT sum(n) FROM words)))) AS BIGINT) AS weight FROM words), least AS (SELECT CAST(round(1000000 * (0 - ln(sum(n)))) AS BIGINT) AS unknown FROM words),
pieces AS (SELECT item_id, generate_subscripts(p, 1) AS spot, unnest(p) AS piece FROM (SELECT item_id, regexp_extract_all(replace(text, ' ', ''), '{LETTERS}|[^{SPACE}]') AS p FROM benchmark)),
runs AS (SELECT DISTINCT piece AS run FROM pieces WHERE regexp_matches(piece, '^{LETTERS}$')),
starts AS (SELECT run, unnest(range(0, length(run))) AS start FROM runs), parts AS (SELECT run, start, unnest(range(1, least({segment.LONGEST}, length(run) - start) + 1)) AS size FROM starts),
edges AS (SELECT run, start, start + size AS stop, weight FROM parts JOIN weights ON word = substr(run, CAST(start + 1 AS INT), CAST(size AS INT)) UNION ALL SELECT run, start, start + 1, unknown FROM starts, least),
ways AS (SELECT run, start, list({{'stop': stop, 'weight': weight}}) AS ways FROM edges GROUP BY ALL),
routes AS (SELECT run, length(run) AS i, [{{'score': 0::BIGINT, 'next': length(run)}}] AS r FROM runs UNION ALL
  SELECT routes.run, i - 1, list_prepend(list_sort(list_transform(ways, lambda e: {{'score': e.weight + r[e.stop - i + 1].score, 'next': e.stop}}), 'DESC')[1], r) FROM routes JOIN ways w ON w.run = routes.run AND w.start = i - 1),
best AS (SELECT run, r FROM routes WHERE i = 0),
walk AS (SELECT run, r, 0::BIGINT AS spot, CAST([] AS VARCHAR[]) AS words FROM best UNION ALL SELECT run, r, r[spot + 1].next, list_append(words, substr(run, CAST(spot + 1 AS INT), CAST(r[spot + 1].next - spot AS INT))) FROM walk WHERE spot < length(run)),
done AS (SELECT run, array_to_string(words, ' ') AS words FROM walk WHERE spot = length(run))
SELECT item_id, string_agg(coalesce(words, piece), ' ' ORDER BY spot) AS tokens FROM pieces LEFT JOIN done ON run = piece GROUP BY 1""")
def segment_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages without their spaces, split into words that the documents have."""
    asked = read(spark, sf_dir, "benchmark").select("item_id", F.replace(F.col("text"), F.lit(" "), F.lit("")).alias("text"))
    made = segment.segment(asked, segment.learn(read(spark, sf_dir, "documents")), "item_id", run=LETTERS)
    return made.select("item_id", F.array_join("tokens", " ").alias("tokens"))


# ----------------------------------------------------------------------------------------------------- giant documents


@query(ORACLES["chunk_books"])
def chunk_giants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned books of chunk_books, their chapters dealt over all tasks."""
    cleaned = clean.clean_text(clean.clean_pages(books(spark, sf_dir), rules(spark)))
    return chunking.chunk_giants(cleaned.select(F.concat_ws("/", "source", "doc_id").alias("source"), F.col("cleaned").alias("text")), chunk_size=500, overlap=80)
