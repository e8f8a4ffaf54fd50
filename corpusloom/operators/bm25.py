"""BM25: an inverted index as tables, and batch search for a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from corpusloom.functions.text import let, tokens
from corpusloom.operators import _count
from corpusloom.sources.tables import exploded, materialize
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Questions scored at a time, and chunks that a task scores against them at a time.
BLOCK, ROWS = 1024, 1024
#: Scores are rounded to so many digits before they are ranked, as sums of floats depend on their order.
DIGITS = 9
Tokenizer = Callable[[Column], Column]


class Index(tuple):
    """(postings, term_stats, corpus_stats); ``forward`` has the same postings, a row for each chunk, if no two share an id."""

    forward: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        """What ``publish_index`` writes of it: postings a row a chunk where it has them so."""
        posted, terms, stats = self
        held = {"postings": posted} if self.forward is None else {"forward": self.forward}
        return held | {"term_stats": terms, "corpus_stats": stats}


def counted(words: Column) -> Column:
    """Array of (term, tf) of an array of tokens, in order of terms: they are sorted, and a term's run is its count."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, let(F.sort_array(words), runs))


def counted_rows(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", tokenizer: Tokenizer = tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, dl, terms: array of (term, tf), and the columns of ``keep``), one row a chunk.

    Tokens are counted inside their chunk's row, so nothing is shuffled; the default tokenizer's by ``_count``.
    """
    if tokenizer is tokens:
        return _counted_texts(chunks.select(F.col(id_col).alias("chunk_id"), *keep, F.col(text_col).cast("string").alias("__t"))).drop("dfs")
    split = chunks.select(F.col(id_col).alias("chunk_id"), *keep, tokenizer(F.col(text_col)).alias("__t"))
    return split.select("chunk_id", *keep, F.greatest(F.size("__t"), F.lit(0)).cast("long").alias("dl"), counted(F.col("__t")).alias("terms"))


def _counted_texts(texts: DataFrame) -> DataFrame:
    """``texts``, whose last column is the text, with dl, terms and dfs in its place.

    dfs holds (term, df) of a stretch of rows in the first of them, so that what is summed up over all rows is a stretch's
    terms, not a row's.
    """
    made = StructType([*texts.schema.fields[:-1], *StructType.fromDDL("dl long, terms array<struct<term:string,tf:long>>, dfs array<struct<term:string,df:long>>").fields])
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _count.slices(batch["__t"]):
                some = batch.slice(at, n)
                columns = [*some.columns[:-1], *_count.counted(some["__t"])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, made)


def distinct_ids(forward: DataFrame) -> bool:
    """Whether no two rows share an id."""
    return not forward.groupBy("chunk_id").count().filter("count > 1").limit(1).count()


def postings(forward: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """((term, chunk_id, tf, dl, and the columns of ``keep``) of a forward index, whether ids are distinct).

    Only where ids are not are postings of one id and length brought together by a shuffle.
    """
    each = exploded(forward, keep)
    if distinct_ids(forward):
        return each, True
    return materialize(each.groupBy("term", "chunk_id", "dl", *keep).agg(F.sum("tf").alias("tf")).select(*each.columns)), False


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl) of chunks' lengths (dl)."""
    n = F.count("*")
    return lengths.agg(n.alias("n_docs"), F.when(n > 0, F.coalesce(F.sum("dl"), F.lit(0)) / n).alias("avgdl"))


def term_weights(counted: DataFrame, n_docs: Column, stats: DataFrame) -> DataFrame:
    """(term, df, idf) of ``counted`` (term, df): negative idf is set to EPSILON times the mean idf of the whole vocabulary before that."""
    counted = materialize(counted).join(F.broadcast(stats.select("n_docs")), how="cross")  # read twice: for the mean, and for each term
    raw = counted.withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean), how="cross").select("term", "df", F.round(idf, DIGITS).alias("idf"), "mean_idf")


def term_stats(posted: DataFrame, n_docs: Column, stats: DataFrame) -> DataFrame:
    return term_weights(posted.groupBy("term").agg(F.count("*").alias("df")), n_docs, stats)


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", tokenizer: Tokenizer = tokens) -> Index:
    """(postings, term_stats, corpus_stats): texts are tokenized a single time, what is made of them is written once.

    The statistics are single rows and broadcast as such.
    """
    texts = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("__t"))  # other tokenizers may take other types
    counts = materialize(_counted_texts(texts.withColumn("__t", F.col("__t").cast("string"))) if tokenizer is tokens else counted_rows(texts, "chunk_id", "__t", tokenizer))
    forward = counts.select("chunk_id", "dl", "terms")
    posted, distinct = postings(forward)
    stats = materialize(corpus_stats(forward.select("dl")))
    if distinct and "dfs" in counts.columns:
        terms = term_weights(counts.select(F.explode("dfs").alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")), F.col("n_docs"), stats)
    else:
        terms = term_stats(posted, F.col("n_docs"), stats)
    index = Index((posted, materialize(terms), stats))
    index.forward = forward if distinct else None
    return index


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, row, term, part) of ROWS chunks at a time: of each of their postings the chunk's place, the term's number and its part of the score."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            sizes = pc.list_value_length(some["terms"]).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(some.num_rows), sizes)
            yield some["chunk_id"].to_pandas().to_numpy(), row, some["terms"].flatten().to_numpy(zero_copy_only=False), some["parts"].flatten().to_numpy(zero_copy_only=False)


def _from_forward(numbers: pd.DataFrame, avgdl: float | None):
    """As ``_gathered``, from batches of a forward index; ``numbers`` has the asked terms in order of their numbers."""
    words, idf = numbers["term"].tolist(), numbers["idf"].to_numpy(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                sizes = pc.fill_null(pc.list_value_length(some["terms"]), 0).to_numpy(zero_copy_only=False)
                flat = some["terms"].flatten()
                term = pc.struct_field(flat, "term")
                no = pc.fill_null(pc.index_in(term, value_set=pa.array(words, type=term.type)), -1).to_numpy(zero_copy_only=False)
                met = no >= 0
                row, no = np.repeat(np.arange(some.num_rows), sizes)[met], no[met]
                tf = pc.struct_field(flat, "tf").to_numpy(zero_copy_only=False)[met].astype(np.float64)
                dl = some["dl"].to_numpy(zero_copy_only=False)[row]
                yield some["chunk_id"].to_pandas().to_numpy(), row, no, idf[no] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)) if len(no) else np.empty(0)

    return run


def _best(asked: pd.DataFrame, ids: list, k: int, schema: pa.Schema, gathered=_gathered):
    """A function from a task's chunks, as ``gathered`` gives them, to each question's k best of them, ties included.

    ``asked`` has question, term and qtf as numbers.
    """
    by_term = {t: (g["question"].to_numpy(), g["qtf"].to_numpy(np.float64)) for t, g in asked.groupby("term")}

    def part(chunk_ids: np.ndarray, row: np.ndarray, term: np.ndarray, parts: np.ndarray) -> pd.DataFrame:
        scores, met = np.zeros((len(ids), len(chunk_ids))), np.zeros((len(ids), len(chunk_ids)), bool)
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.diff(term[order], prepend=-1))
        for rows in np.split(order, starts[1:]):
            if len(rows):
                questions, qtf = by_term[term[rows[0]]]
                at = np.ix_(questions, row[rows])
                scores[at] += qtf[:, None] * parts[rows]
                met[at] = True
        scores = np.where(met, np.round(scores, DIGITS), -np.inf)
        if k < scores.shape[1]:
            met &= scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        question, chosen = np.nonzero(met)
        return pd.DataFrame({"question": question, "chunk_id": chunk_ids[chosen], "score": scores[question, chosen]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for some in gathered(batches):
            found = part(*some)
            if len(found):
                held = found if held is None else pd.concat([held, found])
                held = held[held.groupby("question")["score"].rank(method="min", ascending=False) <= k]
        if held is not None:
            asked_by = np.asarray(ids, dtype=object)[held["question"].to_numpy().astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((asked_by, held["chunk_id"].to_numpy(), held["score"].to_numpy()), schema, strict=True)], schema=schema)

    return run


def fillers(queries: DataFrame, scored: DataFrame, asked: DataFrame, posted: DataFrame, ordered: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score 0): for queries with less than ``k`` hits from 0 on, the first ``k`` chunks without any of their terms.

    Chunks are tried in store order, so many at first and eight times as many whenever some query still lacks fillers.
    """
    full = scored.filter("score >= 0").groupBy("query_id").count().filter(F.col("count") >= k)
    short = materialize(queries.join(full, "query_id", "left_anti").distinct())
    tried, found = 4 * k, None
    while short.limit(1).count():
        first = materialize(ordered.orderBy("store_order").limit(tried))
        n_first = first.count()
        met = posted.select("term", "chunk_id").join(F.broadcast(first.select("chunk_id")), "chunk_id").join(asked.join(short, "query_id", "left_semi").select("query_id", "term"), "term").select("query_id", "chunk_id").distinct()
        free = short.join(F.broadcast(first), how="cross").join(met, ["query_id", "chunk_id"], "left_anti")
        nth = F.row_number().over(W.partitionBy("query_id").orderBy("store_order"))
        free = materialize(free.withColumn("__nth", nth).filter(F.col("__nth") <= k).select("query_id", "chunk_id", F.lit(0.0).alias("score")))
        done = free.groupBy("query_id").count().filter(F.col("count") >= k) if n_first == tried else short
        ready = free.join(done, "query_id", "left_semi")
        found = ready if found is None else found.unionByName(ready)
        if n_first < tried:
            break
        short, tried = materialize(short.join(done, "query_id", "left_anti")), 8 * tried
    return scored.limit(0) if found is None else found


def search(queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], k: int, store: DataFrame | None = None, tokenizer: Tokenizer = tokens, query_id: str = "query_id", question: str = "question", block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank), best first, ties by chunk_id.

    Questions are taken in blocks of ``block`` by a hash of their id. Postings are cut down to a block's terms and gathered
    by chunk, unless the index has them so; each task keeps its own k best of every question, and only those are shuffled again. With
    ``store`` (chunk_id, and ``store_order`` where the order is another), a query with fewer hits than k is filled up with
    chunks of score 0 in that order; a chunk of negative score comes after those.
    """
    posted, terms, stats = index
    forward = getattr(index, "forward", None)
    spark = queries.sparkSession
    n_blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenizer(F.col(question))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighed = asked.join(terms.select("term", "idf"), "term").withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    kinds = dict(asked.dtypes) | {"chunk_id": dict(posted.dtypes)["chunk_id"]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    ordered = None if store is None else (store if "store_order" in store.columns else store.withColumn("store_order", F.col("chunk_id"))).select("chunk_id", "store_order")
    ties = "chunk_id" if ordered is None else "store_order"
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = spark.createDataFrame([], schema)
    made = to_arrow_schema(scored.schema)
    for b in range(n_blocks):
        mine = (weighed.filter(F.col("__block") == b) if n_blocks > 1 else weighed).select("query_id", "term", "qtf", "idf").toPandas()
        if mine.empty:
            continue
        ids, numbers = sorted(mine["query_id"].unique().tolist()), mine.drop_duplicates("term")[["term", "idf"]].reset_index(drop=True)
        numbered = pd.DataFrame({"question": mine["query_id"].map({q: i for i, q in enumerate(ids)}), "term": mine["term"].map({t: i for i, t in enumerate(numbers["term"])}), "qtf": mine["qtf"]})
        if forward is not None:
            best = forward.select("chunk_id", "dl", "terms").mapInArrow(_best(numbered, ids, k, made, _from_forward(numbers, stats.first()["avgdl"])), schema)
        else:
            known = spark.createDataFrame(numbers.assign(no=range(len(numbers))), "term string, idf double, no int")
            found = posted.join(F.broadcast(known), "term").join(F.broadcast(stats), how="cross").select("chunk_id", F.struct("no", part.alias("part")).alias("x"))
            gathered = found.groupBy("chunk_id").agg(F.collect_list("x").alias("x")).select("chunk_id", F.col("x.no").alias("terms"), F.col("x.part").alias("parts"))
            best = gathered.mapInArrow(_best(numbered, ids, k, made), schema)
        scored = scored.unionByName(materialize(best) if n_blocks > 1 or store is not None else best)
    if ordered is not None:
        scored = scored.unionByName(fillers(queries.select(F.col(query_id).alias("query_id")), scored, asked, posted, ordered, k)).join(ordered, "chunk_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), ties))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
