"""Retrieval evaluation: test sets, gold ranks, Hit@k and MRR, variants and encoders side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from corpusloom.functions.text import SPACE, let, strip
from corpusloom.operators import _count, embedding, retrieve, vectors
from corpusloom.operators.augment import strip_think
from corpusloom.sources.tables import materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MIN_CHARS, PASSAGE_CHARS, LEAST_QUESTION = 200, 1200, 4
#: Words in a row that stand for a passage.
ANCHOR = 8


def parse_qa(text: Column, wide_colon: bool = True) -> Column:
    """Struct (question, answer) of generated text, null without a question of four characters; a missing answer is ''."""
    colon = "[:：]" if wide_colon else ":"
    question = strip(F.regexp_extract(text, rf"问题{colon}[\s]*([^\n]+)", 1))
    answer = strip(F.regexp_extract(text, rf"答案{colon}[\s]*([\s\S]+)", 1))
    return F.when(F.length(question) >= LEAST_QUESTION, F.struct(question.alias("question"), answer.alias("answer")))


def sample_passages(chunks: DataFrame, seed: int, min_chars: int = MIN_CHARS, most: int = PASSAGE_CHARS) -> DataFrame:
    """Chunks long enough, cut to ``most`` characters, with ``sample_key`` whose order is a seeded shuffle."""
    long = chunks.filter(F.length("text") >= min_chars)
    return long.select("chunk_id", "source", F.substring("text", 1, most).alias("passage"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string"))).alias("sample_key"))


def make_testset(chunks: DataFrame, n: int, seed: int, generate: Callable[[pd.Series], pd.Series], template: str = "{passage}", oversample: int = 3) -> DataFrame:
    """The first ``n`` passages of the shuffle for which ``generate`` gives a usable question, with their gold ids.

    Passages are drawn in slices of ``n * oversample``, one after the other in the seeded order, until ``n`` are usable or
    there are no more; ``generate`` sees each once.
    """
    candidates, before, after = sample_passages(chunks, seed), *template.partition("{passage}")[::2]
    found, last = None, None
    while True:
        rest = candidates if last is None else candidates.filter(F.struct("sample_key", "chunk_id") > F.struct(F.lit(last[0]), F.lit(last[1]).cast(candidates.schema["chunk_id"].dataType)))
        drawn = rest.orderBy("sample_key", "chunk_id").limit(n * oversample)
        raw = materialize(drawn.withColumn("raw", F.pandas_udf(generate, "string")(F.concat(F.lit(before), "passage", F.lit(after)))))
        usable = raw.withColumn("qa", parse_qa(strip_think(F.col("raw")))).filter("qa IS NOT NULL")
        found = usable if found is None else found.unionByName(usable)
        seen = raw.agg(F.count("*").alias("n"), F.max(F.struct("sample_key", "chunk_id")).alias("last")).first()
        if seen["n"] < n * oversample or found.count() >= n:
            break
        last = seen["last"]
    return found.orderBy("sample_key", "chunk_id").limit(n).select(F.col("chunk_id").alias("query_id"), "qa.question", "qa.answer", F.col("chunk_id").alias("gold_id"), F.col("source").alias("gold_source"))


def run_hashes(texts: DataFrame) -> DataFrame:
    """(id, a) of ``texts`` (id, text): the hash of every ANCHOR words in a row."""
    made = StructType([texts.schema.fields[0], *StructType.fromDDL("a array<long>").fields])
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _count.slices(batch.column(1)):
                some = batch.slice(at, n)
                columns = some.column(0), _count.run_hashes(some.column(1), ANCHOR)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, made).select(texts.columns[0], F.explode("a").alias("a"))


def literal_pairs(passages: DataFrame, documents: DataFrame, passage_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(passage_id, doc_id) of documents that have a passage's text literally.

    Whatever stands between the first and the last white space of a passage are whole words of the document too. ANCHOR of
    them in a row, or one where there are fewer, are joined by hash to the documents' words, and only those pairs are
    compared in full. Passages of less than three words have no such word; they alone are compared with every document.
    """
    def words(t: Column) -> Column:
        return F.split(t, rf"[{SPACE}]+")

    def longest(w: Column) -> Column:
        return F.array_max(F.transform(F.slice(w, F.lit(2), F.size(w) - 2), lambda x: F.struct(F.length(x), x.alias("x"))))["x"]

    long, short = F.col("n") >= ANCHOR + 2, (F.col("n") > 2) & (F.col("n") < ANCHOR + 2)
    asked = passages.select(F.col(passage_id).alias("__p"), F.col(text).alias("__said"), let(words(F.col(text)), lambda w: F.struct(F.when(F.size(w) >= ANCHOR + 2, F.array_join(F.slice(w, 2, ANCHOR), " ")).when(F.size(w) > 2, longest(w)).alias("a"), F.size(w).alias("n"))).alias("__w"))
    asked = materialize(asked.filter(F.col("__said") != "").select("__p", "__said", "__w.a", "__w.n"))
    docs = documents.select(F.col(doc_id).alias("__d"), F.col(text).alias("__t"))

    def matched(hashed: DataFrame, each: DataFrame) -> DataFrame:
        pairs = materialize(each.join(hashed, "a").select("__d", "__p").distinct())  # of known size: few need no shuffle of texts
        full = docs.join(pairs, "__d").join(asked.select("__p", "__said"), "__p")
        return full.filter(F.col("__t").contains(F.col("__said"))).select("__p", "__d")

    counts = asked.agg(F.count_if(long).alias("long"), F.count_if(short).alias("short"), F.count_if(F.col("n") <= 2).alias("tiny")).first()
    out = asked.limit(0).join(docs.limit(0), how="cross").select("__p", "__d")
    if counts["long"]:
        out = out.unionByName(matched(materialize(run_hashes(asked.filter(long).select("__p", "a"))), run_hashes(docs)))
    if counts["short"]:
        each = docs.select("__d", F.explode(let(words(F.col("__t")), lambda w: F.array_distinct(F.transform(w, lambda x: F.xxhash64(x))))).alias("a"))
        out = out.unionByName(matched(asked.filter(short).select("__p", F.xxhash64("a").alias("a")), each))
    if counts["tiny"]:
        out = out.unionByName(docs.join(asked.filter("n <= 2"), F.col("__t").contains(F.col("__said"))).select("__p", "__d"))
    return out.select(F.col("__p").alias(passage_id), F.col("__d").alias(doc_id))


def gold_ranks(testset: DataFrame, ranked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(query_id, keys, rank): the gold chunk's rank in each list of ``ranked`` (query_id, keys, chunk_id, rank), or null."""
    keys = keys or ["stage"]
    lists = ranked.select(*keys).distinct()
    asked = testset.select("query_id", F.col("gold_id").alias("chunk_id")).join(F.broadcast(lists), how="cross")
    return asked.join(ranked.select("query_id", *keys, "chunk_id", "rank"), ["query_id", *keys, "chunk_id"], "left").groupBy("query_id", *keys).agg(F.min("rank").alias("rank"))


def metrics(ranks: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """By list: Hit@1, Hit@k, MRR (a miss counts 0), gold chunks found, questions."""
    r = F.col("rank")
    hit = lambda test: F.round(F.avg(F.coalesce(test.cast("double"), F.lit(0.0))), 6)
    return ranks.groupBy(*(keys or ["stage"])).agg(hit(r == 1).alias("hit_at_1"), hit(r <= k).alias("hit_at_k"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"), F.count("rank").alias("found"), F.count("*").alias("n"))


def rank_table(ranks: DataFrame, stages: list[str]) -> DataFrame:
    """One row a question, one column a stage."""
    return ranks.groupBy("query_id").pivot("stage", stages).agg(F.first("rank"))


def full_ranks(scores: DataFrame, testset: DataFrame, keys: list[str]) -> DataFrame:
    """Gold rank over a full corpus of scores (query_id, keys, chunk_id, score): one more than the chunks scoring higher.

    Counted, not sorted; the gold chunk's score is one row a question and list.
    """
    gold = testset.select("query_id", F.col("gold_id").alias("chunk_id")).join(scores, ["query_id", "chunk_id"]).select("query_id", *keys, F.col("score").alias("gold_score"))
    return scores.join(gold, ["query_id", *keys]).groupBy("query_id", *keys).agg((F.count_if(F.col("score") > F.col("gold_score")) + 1).alias("rank"))


def variant_ranks(testset: DataFrame, chunks: DataFrame, variants: dict[str, Column], encoder: embedding.Encoder = embedding.hashing_encoder) -> DataFrame:
    """(query_id, rank, variant): the gold chunk's rank over all of ``chunks`` (chunk_id, text), each text encoded by every variant.

    ``testset`` has query_id, question and gold_id; ``variants`` gives a column of the text to encode by name. The default
    encoder's vectors are of whole numbers, and ranked as those.
    """
    if encoder is embedding.hashing_encoder:
        held, out = chunks.filter(F.col("text").isNotNull()), None
        asked = materialize(testset.select("query_id", "question", F.col("gold_id").alias("chunk_id")))  # of known size: texts are not shuffled for it
        gold = materialize(held.select("chunk_id", "text").join(asked, "chunk_id"))
        for name, text in variants.items():
            ranks = vectors.counted_gold_ranks(gold.select("query_id", "question", text.alias("gold")), held.select(text.alias("text"))).withColumn("variant", F.lit(name))
            out = ranks if out is None else out.unionByName(ranks)
        return out
    asked = materialize(testset.select("query_id", "gold_id", embedding.encode_query(F.col("question"), encoder=encoder).alias("embedding")))
    out = None
    for name, text in variants.items():
        said = materialize(chunks.filter(F.col("text").isNotNull()).select("chunk_id", text.alias("text")))  # Python takes no column made of lambdas
        encoded = materialize(said.select("chunk_id", embedding.encode(F.col("text"), encoder).alias("embedding")))
        ranks = vectors.gold_ranks(asked, encoded).withColumn("variant", F.lit(name))
        out = ranks if out is None else out.unionByName(ranks)
    return out


def staged_by_model(questions: DataFrame, chunks: DataFrame, lexical: DataFrame, encoders: dict[str, embedding.Encoder], depth: int = 30) -> DataFrame:
    """(query_id, model, stage, chunk_id, rank) of the vector, hybrid and reranked lists of every encoder, ``depth`` deep.

    ``lexical`` is the BM25 list (query_id, chunk_id, rank), the same for all; its first ``depth`` ranks are fused.
    """
    out = None
    first = lexical.filter(F.col("rank") <= depth)
    for model, encoder in encoders.items():
        asked = materialize(questions.select("query_id", embedding.encode_query(F.col("question"), encoder=encoder).alias("embedding")))
        encoded = materialize(chunks.filter(F.col("text").isNotNull()).select("chunk_id", embedding.encode(F.col("text"), encoder).alias("embedding")))
        near = materialize(vectors.vector_topk(asked, encoded, depth))
        fused = materialize(retrieve.rrf_fuse(near, first).filter(F.col("rank") <= depth))
        again = retrieve.rerank(fused.join(chunks, "chunk_id").join(questions, "query_id"), depth)
        for stage, ranked in (("vector", near), ("hybrid", fused), ("reranked", again)):
            rows = ranked.select("query_id", F.lit(model).alias("model"), F.lit(stage).alias("stage"), "chunk_id", "rank")
            out = rows if out is None else out.unionByName(rows)
    return out


def answers_report(testset: DataFrame, answered: DataFrame) -> DataFrame:
    """(query_id, question, reference, answer, gold_source, retrieved_sources, source_hit)."""
    joined = testset.select("query_id", "question", F.col("answer").alias("reference"), "gold_source").join(answered.select("query_id", "answer", "retrieved_sources"), "query_id", "left")
    return joined.withColumn("source_hit", F.coalesce(F.array_contains("retrieved_sources", F.col("gold_source")), F.lit(False)))
