"""Exact vector top-k for a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from corpusloom.operators import _count, embedding as embeddings
from corpusloom.sources.tables import materialize
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK, DIGITS = 1024, 9
#: Vectors that a task scores at a time; bytes of questions that go to a task at a time, and questions it multiplies with them.
ROWS, HELD, TILE = 4096, 1 << 25, 128
#: Far more than a product of doubles is off by, far less than a rounded digit.
SLACK = 1e-12
#: Rows of whole numbers that a task holds at a time, and products that it works out at a time.
COUNTED, PRODUCTS = 1 << 18, 1 << 18
#: More than the cosine of two float vectors is off from that of the whole numbers they were made of.
NEAR = 5e-7
#: Pairs of a question that are multiplied together with those of other questions.
FEW = 64


def nearest(score: Callable[[pd.DataFrame], np.ndarray], k: int, n: int, least: np.ndarray | None = None):
    """A function from a task's batches of rows (with chunk_id) to (q, chunk_id, score): each question's ``k`` best, ties by id.

    ``score`` gives a matrix questions x rows of some rows; scores below ``least`` do not count. What is held are the k best of
    every question and what came since they were last sorted out.
    """

    def sorted_out(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held).sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], kind="stable").groupby("q").head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor, held, size = np.full(n, -np.inf) if least is None else least.copy(), [], 0
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                rows = whole.iloc[at : at + ROWS]
                scores = score(rows)
                q, c = np.nonzero(scores >= floor[:, None])
                if len(q) > 4 * k * n and scores.shape[1] > k:
                    floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
                    q, c = np.nonzero(scores >= floor[:, None])
                held.append(pd.DataFrame({"q": q, "chunk_id": rows["chunk_id"].to_numpy()[c], "score": scores[q, c]}))
                size += len(q)
                if size > 8 * k * n:
                    held = [sorted_out(held)]
                    size = len(held[0])
                    last = held[0].groupby("q")["score"].agg(["min", "size"])
                    full = last[last["size"] == k]
                    floor[full.index.to_numpy()] = np.maximum(floor[full.index.to_numpy()], full["min"].to_numpy())
        if size:
            yield sorted_out(held)

    return run


def unit(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype(np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "chunk_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, best first, ties by id.

    Queries are taken in blocks of ``block`` by a hash of their id, one after the other; a block's matrix (bounded) goes to
    every task, each task keeps its own k best of every query, ROWS vectors at a time, and only those are shuffled.
    """
    kind = dict(vectors.select(vector_id).dtypes)[vector_id]
    n_blocks = max(1, -(-queries.count() // block))
    held = queries.select(query_id, embedding, F.pmod(F.xxhash64(query_id), F.lit(n_blocks)).alias("__block"))
    qkind = dict(queries.select(query_id).dtypes)[query_id]

    def best(matrix: np.ndarray, ids: list):
        found = nearest(lambda rows: np.round(matrix @ unit(rows["embedding"]).T, DIGITS), k, len(ids))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in found(batches):
                yield pd.DataFrame({"query_id": np.asarray(ids, dtype=object)[pdf["q"].to_numpy()], "chunk_id": pdf["chunk_id"].to_numpy(), "score": pdf["score"].to_numpy()})

        return run

    parts = []
    for b in range(n_blocks):
        rows = held.filter(F.col("__block") == b).select(query_id, embedding).toPandas()
        if len(rows):
            some = vectors.filter(F.col(embedding).isNotNull()).select(F.col(vector_id).alias("chunk_id"), F.col(embedding).alias("embedding"))
            found = some.mapInPandas(best(unit(rows[embedding]), rows[query_id].tolist()), f"query_id {qkind}, chunk_id {kind}, score double")
            parts.append(materialize(found) if n_blocks > 1 else found)
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {qkind}, chunk_id {kind}, score double, rank int")
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return all_.withColumn("rank", rank).filter(F.col("rank") <= k)


def _higher(asked: np.ndarray, least: np.ndarray, ids: list):
    """A function from a task's vectors to (query_id, higher): how many have a rounded score above the question's ``least``.

    Equal questions are multiplied once. Scores are rounded only for the questions that have one so close to the limit that
    it matters.
    """
    distinct, which = np.unique(asked, axis=0, return_inverse=True)
    order = np.argsort(which, kind="stable")
    which, limit = which[order], least[order] + 0.5 * 10.0**-DIGITS
    ends = np.searchsorted(which, np.arange(0, len(distinct) + TILE, TILE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        higher = np.zeros(len(ids), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                rows = unit(pdf["embedding"].iloc[at : at + ROWS]).T
                for t, start in enumerate(range(0, len(distinct), TILE)):
                    scores = distinct[start : start + TILE] @ rows
                    for i in range(ends[t], ends[t + 1]):
                        row = scores[which[i] - start]
                        n = np.count_nonzero(row > limit[i] + SLACK)
                        if n != np.count_nonzero(row > limit[i] - SLACK):
                            n = np.count_nonzero(np.round(row, DIGITS) > least[order[i]])
                        higher[order[i]] += n
        yield pd.DataFrame({"query_id": np.asarray(ids, dtype=object), "higher": higher})

    return run


def gold_ranks(testset: DataFrame, vectors: DataFrame, vector_id: str = "chunk_id", embedding: str = "embedding", block: int | None = None) -> DataFrame:
    """(query_id, rank) of ``testset`` (query_id, embedding, gold_id): one more than the vectors nearer than the gold one.

    Every question meets every vector. Questions go to the tasks ``block`` at a time (as many as HELD bytes hold), joined to
    their gold vectors once; each task counts, and only the counts are shuffled.
    """
    gold = vectors.select(F.col(vector_id).alias("gold_id"), F.col(embedding).alias("__gold"))
    joined = materialize(testset.select("query_id", F.col("embedding").alias("embedding"), "gold_id").join(gold, "gold_id").filter(F.col("embedding").isNotNull() & F.col("__gold").isNotNull()))
    size = joined.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    kind = dict(testset.dtypes)["query_id"]
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank long")
    n_blocks = -(-size["n"] // (block or max(BLOCK, HELD // (8 * max(1, size["width"])))))
    some, parts = vectors.filter(F.col(embedding).isNotNull()).select(F.col(embedding).alias("embedding")), None
    for b in range(n_blocks):
        rows = joined.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).select("query_id", "embedding", "__gold").toPandas()
        if len(rows):
            asked = unit(rows["embedding"])
            least = np.round((asked * unit(rows["__gold"])).sum(axis=1), DIGITS)
            found = some.mapInPandas(_higher(asked, least, rows["query_id"].tolist()), f"query_id {kind}, higher long").groupBy("query_id").agg(F.sum("higher").alias("higher"))
            found = materialize(found) if n_blocks > 1 else found
            parts = found if parts is None else parts.unionByName(found)
    return parts.groupBy("query_id").agg((F.sum("higher") + 1).alias("rank"))


def _floats(counts: np.ndarray) -> np.ndarray:
    """The encoder's floats of whole numbers, a row a vector, as doubles."""
    return embeddings.normalized(counts.astype(np.float64)).astype(np.float64)


def _stretch(counts: np.ndarray) -> np.ndarray:
    """The length of each vector of floats."""
    length = np.linalg.norm(_floats(counts), axis=1)
    return np.where(length == 0, 1, length)


def _scores(asked: np.ndarray, floats: np.ndarray) -> np.ndarray:
    """Rounded products of pairs of vectors of length 1, a column each, summed up place after place: places with zeros may be left out."""
    return np.round(np.add.reduce(np.ascontiguousarray(asked * floats), axis=0), DIGITS)


class _Outranked:
    """How many vectors are nearer than a question's gold one, for vectors of whole numbers.

    A product of whole numbers is their sum by the question's few places, and questions in order of their places share
    sums. Vectors are sorted by length: those of one length need the same product to be nearer, so that a comparison
    settles a run of them. Where floats and roundings matter (products within NEAR of the gold one's) the vectors are
    multiplied as floats.
    """

    def __init__(self, asked: np.ndarray, least: np.ndarray) -> None:
        self.least = least
        distinct, which = np.unique(asked, axis=0, return_inverse=True)
        columns = np.argsort(-np.count_nonzero(distinct, axis=0), kind="stable")
        entries = [tuple((int(d), int(q[d])) for d in columns[q[columns] != 0]) for q in distinct]
        place = {d: i for i, d in enumerate(columns.tolist())}
        turn = sorted(range(len(entries)), key=lambda i: [(place[d], times) for d, times in entries[i]])
        self.entries = [entries[i] for i in turn]
        at = np.empty(len(turn), np.int64)
        at[turn] = np.arange(len(turn))
        which = at[which.ravel()]
        self.members = np.argsort(which, kind="stable")
        self.ends = np.searchsorted(which[self.members], np.arange(len(distinct) + 1))
        self.asked = np.ascontiguousarray(distinct[turn].T)
        self.lengths = np.sqrt((self.asked.astype(np.float64) ** 2).sum(axis=0))
        self.units = np.ascontiguousarray((_floats(distinct[turn]) / _stretch(distinct[turn])[:, None]).T)

    def _products(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Of each distinct question in turn, its products with ``rows`` (places x vectors); good until the next is asked for."""
        sums = np.zeros((1 + max(map(len, self.entries)), rows.shape[1]), rows.dtype)
        held: tuple = ()
        for entries in self.entries:
            k = 0
            while k < min(len(held), len(entries)) and held[k] == entries[k]:
                k += 1
            for i, (d, times) in enumerate(entries[k:], k):
                if abs(times) == 1:
                    (np.add if times > 0 else np.subtract)(sums[i], rows[d], out=sums[i + 1])
                else:
                    np.multiply(rows[d], rows.dtype.type(times), out=sums[i + 1])
                    sums[i + 1] += sums[i]
            held = entries
            yield sums[len(entries)]

    def higher(self, counts: np.ndarray) -> np.ndarray:
        """How many rows of ``counts`` are nearer, by question."""
        out = np.zeros(len(self.least), np.int64)
        n, most = len(counts), int((np.abs(self.asked).T.astype(np.float64) @ np.abs([counts.min(axis=0), counts.max(axis=0)]).max(axis=0)).max())
        squares = np.einsum("ij,ij->i", counts, counts, dtype=np.int64)
        most = max(most, int(1.01 * self.lengths.max() * np.sqrt(squares.max())) + 1)  # limits are no greater than lengths multiplied
        kind = next(t for t in (np.int16, np.int32, np.int64) if most < np.iinfo(t).max)
        order = np.argsort(squares, kind="stable")
        rows, squares = np.ascontiguousarray(counts[order].T, dtype=kind), squares[order]
        of_row = np.where(squares == 0, 1, np.sqrt(squares)), np.concatenate([_stretch(counts[order[at : at + ROWS]]) for at in range(0, n, ROWS)])
        squares, starts = np.unique(squares, return_index=True)
        starts, roots = np.append(starts, n), np.sqrt(squares)
        products, above = self._products(rows), np.empty(n, bool)
        tile, close, held = max(1, PRODUCTS // len(roots)), [], 0
        for first in range(0, len(self.members), tile):
            some = self.members[first : first + tile]
            of = np.searchsorted(self.ends, np.arange(first, first + len(some)), side="right") - 1
            low, high = (((self.least[some] + x) * self.lengths[of])[:, None] * roots for x in (-NEAR, NEAR))
            np.floor(high, out=high)
            near, limits = high >= low, high.astype(kind)
            changes = np.ones(high.shape, bool)
            np.not_equal(limits[:, 1:], limits[:, :-1], out=changes[:, 1:])
            for i, m in enumerate(some):
                if first + i == self.ends[of[i]]:
                    product = next(products)
                runs = changes[i].nonzero()[0]
                begins = starts[runs]
                sizes = np.empty_like(begins)
                np.subtract(begins[1:], begins[:-1], out=sizes[:-1])
                sizes[-1] = n - begins[-1]
                np.greater(product, limits[i, runs].repeat(sizes), out=above)
                out[m] += np.count_nonzero(above)
                groups = near[i].nonzero()[0]
                if len(groups):
                    sizes = starts[groups + 1] - starts[groups]
                    found = np.arange(sizes.sum()) + (starts[groups + 1] - sizes.cumsum()).repeat(sizes)
                    run = product[found]
                    found = found[(run <= high[i, groups].repeat(sizes)) & (run >= low[i, groups].repeat(sizes))]
                    if len(found) > FEW:
                        out[m] += self._nearer(m, of[i], found, rows, of_row)
                    elif len(found):
                        close.append((m, of[i], found))
                        held += len(found)
                        if held >= ROWS:
                            self._settle(out, close, rows, of_row)
                            close, held = [], 0
        self._settle(out, close, rows, of_row)
        return out

    def _nearer(self, m: int, q: int, found: np.ndarray, rows: np.ndarray, of_row: tuple[np.ndarray, np.ndarray]) -> int:
        """How many of a question's many pairs are nearer as floats, by its places only."""
        places, n = self.asked[:, q].nonzero()[0], 0
        for at in range(0, len(found), ROWS):
            some = found[at : at + ROWS]
            floats = (rows[places[:, None], some] / of_row[0][some]).astype(np.float32) / of_row[1][some]
            n += np.count_nonzero(_scores(self.units[places, q][:, None], floats) > self.least[m])
        return n

    def _settle(self, out: np.ndarray, close: list[tuple[int, int, np.ndarray]], rows: np.ndarray, of_row: tuple[np.ndarray, np.ndarray]) -> None:
        """Multiplies the few pairs of many questions as floats."""
        if close:
            sizes = [len(c[2]) for c in close]
            m, q, found = np.repeat([c[0] for c in close], sizes), np.repeat([c[1] for c in close], sizes), np.concatenate([c[2] for c in close])
            floats = (rows[:, found] / of_row[0][found]).astype(np.float32) / of_row[1][found]
            np.add.at(out, m, _scores(self.units[:, q], floats) > self.least[m])


def counted_gold_ranks(testset: DataFrame, texts: DataFrame, dim: int = embeddings.DIM, block: int | None = None) -> DataFrame:
    """(query_id, rank) by ``gold_ranks`` of the default encoder's vectors, without writing any.

    ``testset`` has query_id, question and the gold text, ``texts`` one column of all texts, encoded where they are read.
    Questions go to the tasks ``block`` at a time (as many as HELD bytes hold).
    """
    made = StructType([testset.schema["query_id"], *StructType.fromDDL("asked binary, least double").fields])
    asked_schema, counted_schema = to_arrow_schema(made), to_arrow_schema(StructType([testset.schema["query_id"], *StructType.fromDDL("higher long").fields]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, gold = _count.hashed(batch["question"], dim), _count.hashed(batch["gold"], dim)
            least = _scores(*((_floats(c) / _stretch(c)[:, None]).T for c in (asked, gold)))
            yield pa.RecordBatch.from_arrays([batch["query_id"].cast(asked_schema[0].type), pa.array([q.tobytes() for q in asked], pa.binary()), pa.array(least)], schema=asked_schema)

    def higher(rows: pd.DataFrame):
        ids = rows["query_id"].tolist()
        asked = np.frombuffer(b"".join(rows["asked"]), np.int32).reshape(len(ids), dim)
        held = _Outranked(asked, rows["least"].to_numpy())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, counts, size = np.zeros(len(ids), np.int64), [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    made = _count.hashed(batch.column(0).slice(at, ROWS), dim)
                    counts.append(made.astype(np.int16) if np.abs(made).max() < 1 << 15 else made)
                    size += len(made)
                    if size >= COUNTED:
                        out += held.higher(np.concatenate(counts))
                        counts, size = [], 0
            if size:
                out += held.higher(np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, counted_schema[0].type), pa.array(out)], schema=counted_schema)

        return run

    rows = materialize(testset.select("query_id", "question", "gold").mapInArrow(ask, made))
    n_blocks = -(-rows.count() // (block or max(BLOCK, HELD // (4 * dim))))
    kind, parts = dict(testset.dtypes)["query_id"], None
    texts = materialize(texts) if n_blocks > 1 else texts
    for b in range(n_blocks):
        some = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).toPandas()
        if len(some):
            found = texts.mapInArrow(higher(some), f"query_id {kind}, higher long").groupBy("query_id").agg(F.sum("higher").alias("higher"))
            found = materialize(found) if n_blocks > 1 else found
            parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return texts.sparkSession.createDataFrame([], f"query_id {kind}, rank long")
    return parts.groupBy("query_id").agg((F.sum("higher") + 1).alias("rank"))
