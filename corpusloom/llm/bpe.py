"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Texts are split into words by the tokenizer's pattern. A word is an array of its bytes, and a fold joins, step by step, the
leftmost adjacent pair whose joined bytes have the least rank, until no pair has one. Ranks are a literal (the value of a
one-row table): two arrays from pairs of ids to joined ids, so that a lookup is an index or two, and one for pairs of bytes.
A fold takes quadratic time, so words of more than LONG bytes keep their ranks in a heap, where texts are split; the
outcome is the same and the time for one long unbroken word grows as n log n.
Decoding takes each id's bytes from a literal table, as hexadecimal digits, and concatenates these pieces.

Only distinct words are folded: words are counted over the whole table, and the frequent ones (a bounded number; by a
threshold on their counts) are folded once and broadcast; each text's other distinct words are folded in its row. What is
remembered never changes a result.

Defined cases: null text is empty; an empty text has no ids and decodes to no bytes; the special tokens' texts are
ordinary text; repeated rows get equal results; null ids are kept; columns of the input other than the id and the text are
not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from .common import bounded_batches, cut, let, mix, slices
from .pretokens import expand, pretokens

#: At most so many words are remembered, none of more bytes than LONGEST.
REMEMBERED, LONGEST = 1 << 20, 64
#: Most bytes of a word that is folded.
LONG = 256
#: Words that one task folds, of those remembered.
FOLDED_PER_TASK = 8192

#: Bits of a token id, in packed longs.
TOKEN_BITS = 20
TOKEN_MASK = (1 << TOKEN_BITS) - 1
NEVER = 1 << TOKEN_BITS

#: Base of the words' hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def _two_places(entries: list[int], places: list[tuple[int, int]], size: int) -> tuple[list[int], list[int]]:
    """Two tables of ``size`` slots that hold each entry at its first or second place, -1 elsewhere."""
    tables = ([None] * size, [None] * size)
    for i in range(len(entries)):
        held, side = i, 0
        for _ in range(200):
            slot = places[held][side]
            held, tables[side][slot] = tables[side][slot], held
            if held is None:
                break
            side = 1 if places[held][0] == slot and side == 0 else 0
        else:
            raise ValueError("the rank map does not fit its tables")
    one, two = ([-1 if i is None else entries[i] for i in t] for t in tables)
    return one, two


def by_heap(parts: list[int], least: Callable[[int], int | None]) -> list[int]:
    """``parts`` (ids) with adjacent ones joined, the least rank first and then the leftmost, by a heap of ranks.

    ``least`` gives for two ids, as ``first << 32 | second``, the rank and in the low TOKEN_BITS bits the id of both.
    """
    parts, n = list(parts), len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := least(parts[i] << 32 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= n or least(parts[i] << 32 | parts[j]) != rank:
            continue  # one of the two has been joined since
        parts[i], parts[j] = rank & TOKEN_MASK, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := least(parts[left] << 32 | parts[right])) is not None:
                heapq.heappush(heap, (r, left))
    return [p for p in parts if p >= 0]


@lru_cache(maxsize=2)
def joins(ranks_path: str) -> tuple[list[int], Callable[[int], int | None]]:
    """(id of each byte, ``least`` for ``by_heap``) of a rank file; made where a long word is met, once a worker."""
    tokens = read_ranks(ranks_path)
    ids = {t: i for i, t in enumerate(tokens)}
    found = {ids[t[:k]] << 32 | ids[t[k:]]: r << TOKEN_BITS | r for t, r in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
    return [ids[bytes((b,))] for b in range(256)], found.get


class Ranks:
    """The literal rank map, and the fold that uses it.

    A pair of ids is one long, and its entry stands at its first or second place. A first place tells whether any pair that
    has it stands at its second one, so that most pairs that have no rank take one look.
    """

    BITS = 18
    FACTORS = (7_654_321, 5_308_417)  # with 40 bits of a pair no product passes 63 bits
    #: In an entry's low bits, beside a rank; and the entry of a place without pair.
    ELSEWHERE = 1 << TOKEN_BITS - 1
    NOTHING = TOKEN_MASK << 2 * TOKEN_BITS

    def __init__(self, spark: SparkSession, tokens: list[bytes]) -> None:
        if len(tokens) > self.ELSEWHERE:
            raise ValueError(f"more than {self.ELSEWHERE} ranks")
        ids = {t: i for i, t in enumerate(tokens)}
        found = [(ids[t[:k]] << TOKEN_BITS | ids[t[k:]], r) for t, r in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        one, two = _two_places([p << TOKEN_BITS | r for p, r in found], [(self._at(p, 0), self._at(p, 1)) for p, _ in found], 1 << self.BITS)
        one, two = ([self.NOTHING if e < 0 else e for e in t] for t in (one, two))
        for e in two:
            if e != self.NOTHING:
                one[self._at(e >> TOKEN_BITS, 0)] |= self.ELSEWHERE
        pairs = [ids.get(bytes((a, b)), NEVER) for a in range(256) for b in range(256)]
        singles = [ids[bytes((b,))] for b in range(256)]
        row = pa.table({name: pa.array([values], pa.list_(pa.int64())) for name, values in (("t0", one), ("t1", two), ("pairs", pairs), ("bytes", singles))})
        #: A struct of arrays. Spark wants it in a column of its own, which it then puts where the column is used.
        self.literal = spark.createDataFrame(row).select(F.struct("t0", "t1", "pairs", "bytes")).scalar()

    def _at(self, pair: int, side: int) -> int:
        return pair * self.FACTORS[side] >> TOKEN_BITS & (1 << self.BITS) - 1

    def joined(self, ranks: Column, a: Column, b: Column) -> Column:
        """The id (which is the rank) of the joined bytes of two tokens, or NEVER, also where one of them is null."""
        never = F.lit(NEVER).cast("long")

        def at(pair: Column, side: int) -> Column:
            return F.get(ranks[f"t{side}"], F.shiftright(pair * F.lit(self.FACTORS[side]).cast("long"), TOKEN_BITS).bitwiseAND((1 << self.BITS) - 1).cast("int"))

        def second(pair: Column) -> Column:
            return let(at(pair, 1), lambda e: F.when(F.shiftright(e, TOKEN_BITS) == pair, e.bitwiseAND(TOKEN_MASK)).otherwise(never))

        def first(pair: Column, e: Column) -> Column:
            here = F.when(F.shiftright(e, TOKEN_BITS) == pair, e.bitwiseAND(self.ELSEWHERE - 1))
            return here.when(e.bitwiseAND(self.ELSEWHERE) > 0, second(pair)).otherwise(never)

        return let(F.shiftleft(a, TOKEN_BITS).bitwiseOR(b), lambda pair: let(at(pair, 0), lambda e: first(pair, e)))

    @staticmethod
    def _first(ranks: Column, word: Column, b: Column, i: Column) -> Column:
        """Rank of joining byte ``b`` at ``i`` with the byte after it."""
        return F.coalesce(F.get(ranks["pairs"], b * 256 + F.get(word, i + 1)), F.lit(NEVER).cast("long"))

    def fold(self, ranks: Column, word: Column) -> Column:
        """Ids of an array of bytes; ``ranks`` is the bound literal.

        The state is an array of longs, one a token: the rank of joining it with the next one, its place and its id. The
        least long is the leftmost of the pairs with the least rank.
        """
        rank_shift, place_shift = 2 * TOKEN_BITS, TOKEN_BITS

        def token(entry: Column) -> Column:
            return entry.bitwiseAND(TOKEN_MASK)

        def ranked(a: Column, b: Column) -> Column:
            return F.shiftleft(self.joined(ranks, a, b), rank_shift)

        def merged(state: Column, least: Column, at: Column) -> Column:
            rank = F.shiftright(least, rank_shift)
            place = least.bitwiseAND(TOKEN_MASK << place_shift)
            after, before = F.get(state, at + 1), F.get(state, at - 2)
            new = ranked(rank, token(after)).bitwiseOR(place).bitwiseOR(rank)
            left = ranked(token(before), rank).bitwiseOR(before.bitwiseAND((1 << rank_shift) - 1))
            middle = F.when(at > 1, F.array(left, new)).otherwise(F.array(new))
            return F.concat(F.slice(state, F.lit(1), F.greatest(at - 2, F.lit(0))), middle, F.slice(state, at + 2, F.size(state)))

        def step(state: Column) -> Column:
            def go(least: Column) -> Column:
                at = F.array_position(state, least).cast("int")
                return F.when(least >= NEVER << rank_shift, state).otherwise(let(at, lambda k: merged(state, least, k)))

            return let(F.array_min(state), go)

        n = F.size(word)
        start = F.transform(word, lambda b, i: F.shiftleft(self._first(ranks, word, b, i), rank_shift).bitwiseOR(F.shiftleft(i.cast("long"), place_shift)).bitwiseOR(F.get(ranks["bytes"], b)))
        done = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, lambda s, _: step(s))
        return F.transform(done, lambda e: token(e).cast("int"))

    def of(self, df: DataFrame, words: str, name: str) -> DataFrame:
        """``df`` with a column ``name``: the ids of every word of ``words``, an array of byte arrays.

        A word that starts with a number below 0 has its ids already, each as -1 - id.
        """
        each = lambda k: F.transform(words, lambda w: F.when(F.get(w, F.lit(0)) < 0, F.transform(w, lambda i: -1 - i)).otherwise(self.fold(k, w)))
        return df.withColumn("__ranks", self.literal).select(*df.columns, let(F.col("__ranks"), each).alias(name))


def _hashes(words: pa.Array, block: int = 1 << 16) -> np.ndarray:
    """64-bit hash of each word: a polynomial of its bytes, mixed. Equal hashes are not yet equal words."""
    parts = [np.empty(0, np.uint64)]
    for start in range(0, len(words), block):
        part = words.slice(start, block).cast(pa.large_binary())
        _, ends, data = part.buffers()
        ends = np.frombuffer(ends, np.int64)[part.offset : part.offset + len(part) + 1]
        raw, sizes = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64), np.diff(ends)
        powers = np.cumprod(np.full(max(1, sizes.max()), _BASE, np.uint64))
        place = np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], sizes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * powers[place])])[ends - ends[0]]
        parts.append(mix(np.diff(sums)))
    return np.concatenate(parts)


@dataclass(frozen=True)
class Remembered:
    """Words in order of their hashes, and their ids one word after the other."""

    hashes: np.ndarray
    words: pa.Array
    starts: np.ndarray
    sizes: np.ndarray
    flat: np.ndarray

    @staticmethod
    def of(words: pa.Array, ids: pa.ListArray) -> Remembered:
        hashes = _hashes(words)
        order = np.argsort(hashes, kind="stable")
        offsets = np.asarray(ids.offsets).astype(np.int32)
        return Remembered(hashes[order], words.cast(pa.large_binary()).take(pa.array(order)), offsets[:-1][order] - offsets[0], np.diff(offsets)[order], np.asarray(ids.flatten()))

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, or -1."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, _hashes(words)), len(self.hashes) - 1)
        same = pc.equal(self.words.take(pa.array(at)), words.cast(pa.large_binary()))
        return np.where(np.asarray(same), at, -1)


def _with_long(words: pa.Array, ranks_path: str) -> pa.Array:
    """Each word as a list of its bytes; one of more than LONG bytes as its ids, each as -1 - id."""
    long = np.flatnonzero(np.asarray(pc.binary_length(words.cast(pa.large_binary()))) > LONG)
    if not len(long):
        return _byte_lists(words)
    singles, least = joins(ranks_path)
    rows = [list(w) for w in words.cast(pa.large_binary()).to_pylist()]
    for i in long.tolist():
        rows[i] = [-1 - t for t in by_heap([singles[b] for b in rows[i]], least)]
    return pa.array(rows, pa.list_(pa.int32()))


def _byte_lists(words: pa.Array) -> pa.Array:
    """Each word as a list of its bytes."""
    raw = words.cast(pa.large_binary()).to_pylist()
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)))


def _rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values: the bytes of each row's part of ``values``."""
    ends = (offsets * values.dtype.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _values(rows: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``_rows``: (all values, row offsets); null rows have none."""
    kind = np.dtype(kind)
    raw = b"".join(x.as_buffer() for x in rows if x.is_valid)
    return np.frombuffer(raw, kind), np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(rows), 0)).astype(np.int64) // kind.itemsize)])


class Encoding:
    """Encodes and decodes columns by a rank file."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str) -> None:
        bounded_batches(spark)
        self.spark, self.pattern, self.path = spark, pattern, ranks_path
        tokens = read_ranks(ranks_path)
        self.ranks = Ranks(spark, tokens)
        #: Of each id its bytes, in hexadecimal digits: the value of a one-row table.
        self.pieces = spark.createDataFrame(pa.table({"pieces": pa.array([[t.hex() for t in tokens]], pa.list_(pa.string()))})).select(F.struct("pieces")).scalar()
        self.known = spark.sparkContext.broadcast(Remembered.of(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))))

    def counts(self, texts: DataFrame) -> DataFrame:
        """(word, n) over all rows of the only column of ``texts``."""
        pattern = self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, stop in slices(batch.column(0)):
                    codes, _, words = pretokens(batch.column(0).slice(start, stop - start), pattern)
                    yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "n"])

        return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def remember(self, texts: DataFrame, most: int = REMEMBERED) -> Encoding:
        """Folds the frequent words of ``texts`` (one column) once; at most ``most``, by the least count that leaves no more."""
        counted = cut(self.counts(texts).filter((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)))
        # counts on a scale of eighths of powers of two, so that few numbers come to the driver
        scale = F.floor(F.log2("n") * 8).cast("int")
        least, total = None, 0
        for level, n in sorted(((r["level"], r["n"]) for r in counted.groupBy(scale.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True):
            if total + n > most:
                break
            least, total = level, total + n
        if least is None:
            return self
        listed = F.arrow_udf(_byte_lists, "array<int>")(F.col("word"))
        frequent = counted.filter(scale >= least).select("word").repartition(-(-total // FOLDED_PER_TASK))
        folded = self.ranks.of(frequent.select("word", F.array(listed).alias("w")), "w", "ids").select("word", F.col("ids")[0].alias("ids")).toArrow()
        self.known = self.spark.sparkContext.broadcast(Remembered.of(*(folded.column(c).combine_chunks() for c in ("word", "ids"))))
        return self

    def encode(self, df: DataFrame, text_col: str) -> DataFrame:
        """``df`` with ids (array<int>) and id_bytes (little-endian unsigned 32-bit integers) instead of its text."""
        pattern, known, path = self.pattern, self.known, self.path
        kept = [f for f in df.schema.fields if f.name not in (text_col, "ids", "id_bytes", "decoded")]
        names, n = [f.name for f in kept], len(kept)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Words as numbers (a remembered word's place; after those, a place in the row's list of others) and that list."""
            for batch in batches:
                for start, stop in slices(batch.column(n)):
                    codes, offsets, words = pretokens(batch.column(n).slice(start, stop - start), pattern)
                    numbers = known.value.find(words)[codes]
                    new = np.flatnonzero(numbers < 0)
                    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[new]
                    per_row = max(1, len(words))
                    pairs, where = np.unique(row * per_row + codes[new], return_inverse=True)
                    firsts = np.searchsorted(pairs, np.arange(len(offsets)) * per_row)
                    numbers[new] = len(known.value.hashes) + where - firsts[row]
                    others = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), _with_long(words.take(pa.array(pairs % per_row)), path))
                    same = [batch.column(i).slice(start, stop - start) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([*same, _rows(numbers.astype(np.int32), offsets), others], names=[*names, "__numbers", "__others"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Ids in the order of the words."""
            held = known.value
            for batch in batches:
                for start, stop in slices(batch.column(n)):
                    part = batch.slice(start, stop - start)
                    codes, offsets = _values(part.column(n), np.int32)
                    each, inner = np.asarray(part.column(n + 1).offsets).astype(np.int64), part.column(n + 1).flatten()
                    ends, codes = np.asarray(inner.offsets).astype(np.int64), codes.astype(np.int64)
                    other = codes >= len(held.hashes)
                    codes[other] += (each[:-1] - each[0]).repeat(np.diff(offsets))[other]
                    starts = np.concatenate([held.starts, len(held.flat) + ends[:-1] - ends[0]])
                    at, stops = expand(codes, starts, np.concatenate([held.sizes, np.diff(ends)]))
                    ids = np.concatenate([held.flat, np.asarray(inner.flatten())]).astype(np.int32)[at]
                    rows = stops[offsets]
                    found = {"ids": pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids)), "id_bytes": _rows(ids.astype("<u4"), rows)}
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], *found.values()], names=[*names, *found])

        def schema(**more: DataType) -> StructType:
            return StructType([*kept, *(StructField(name, kind) for name, kind in more.items())])

        read = df.select(*names, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
        words = read.mapInArrow(split, schema(__numbers=BinaryType(), __others=ArrayType(ArrayType(IntegerType()))))
        folded = self.ranks.of(words, "__others", "__folded").drop("__others")
        return folded.mapInArrow(gather, schema(ids=ArrayType(IntegerType()), id_bytes=BinaryType()))

    def decode(self, df: DataFrame, ids: str = "ids", name: str = "decoded") -> DataFrame:
        """``df`` with a column ``name``: the bytes that the ids in ``ids`` stand for; unknown ids stand for none."""
        joined = lambda k: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(k["pieces"], i)), ""))
        return df.withColumn("__pieces", self.pieces).select(*df.columns, let(F.col("__pieces"), joined).alias(name))


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lists: bool = True) -> DataFrame:
    """(doc_id, id_bytes, ids if ``lists``, decoded): every text's ids, and the bytes that they decode to."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoding = Encoding(documents.sparkSession, ranks_path, pattern).remember(docs.select("text"))
    done = encoding.decode(encoding.encode(docs, "text"))
    return done if lists else done.drop("ids")
