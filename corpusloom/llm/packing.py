"""Best-fit packing of token pieces into sequences, for whole tables.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens (only longer documents are cut; their first
piece is the shorter one, all later ones are full). Best-fit decreasing then runs over the histogram of piece lengths, which has at most
``capacity`` rows however large the table is: bins that are filled alike form one group, a segment tree over remaining
capacities finds the tightest group that still fits, and one step places as many pieces of a length as the group takes.
The outcome is that of best-fit decreasing over all pieces of the table at once. Pieces find their place by their rank
within their length; ranks are counted in parts of about PART_ROWS pieces, so that a frequent length is no single task.

Defined cases: null text is empty and makes a piece of the end token alone; rows that repeat an id, and null ids, are
packed like any other row; equal pieces take places in any order; an empty table gives no rows; columns of the input
other than the id and the text are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, slices
from .pretokens import expand, odd_space, space_words

CAPACITY, END_ID, PART_ROWS = 1024, 2, 100_000

#: Words whose ids a Python worker remembers, in each of two generations.
REMEMBERED = 120_000

#: Text bytes that a Python worker tokenizes at a time.
SLICE = 1_500_000


class Ids:
    """Ids of whole texts, with the ids of frequent words remembered.

    The tokenizer's pattern always breaks before a single space and around a single line feed between other
    characters, so such a text is encoded word by word, each distinct word of a batch once; any other text is encoded
    whole. Words are remembered in two generations: when the young one is full it becomes the old one, and words met
    again move back. Where the vocabulary numbers its tokens in the order of its merges, new words take the faster of
    two equal encoders.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        numbers = [model["vocab"]["".join(m)] for m in merges]
        self.fast = None
        if numbers == sorted(numbers) and len(numbers) + 256 <= numbers[-1] + 1:
            as_byte = {c: b for b, c in _byte_letters().items()}
            ranks = {bytes(as_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.line_feed = ranks[b"\n"]

    def _new(self, words: list[str]) -> list[bytes]:
        if self.fast is None or "\n" in words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.asarray(self.fast.encode_ordinary("\n".join([*words, ""])), dtype="<u4")
        ends = np.flatnonzero(ids == self.line_feed)
        raw, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + 1])
        return [raw[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {"": b"", "\n": self.young.get("\n") or self._new(["\n"])[0]}
        if "\n" not in self.young:
            self.young["\n"] = self._new(["\n"])[0]
        out = list(map(self.young.get, words))
        missing = [i for i, known in enumerate(out) if known is None]
        fresh = []
        for i in missing:
            known = self.old.get(words[i])
            if known is None:
                fresh.append(i)
            else:
                out[i] = self.young[words[i]] = known
        for i, ids in zip(fresh, self._new([words[i] for i in fresh]) if fresh else [], strict=True):
            out[i] = self.young[words[i]] = ids
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, row offsets)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = odd_space(texts)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        codes, offsets, distinct = space_words(pc.if_else(odd, pa.scalar("", pa.large_string()), texts))
        known = self._words(distinct.to_pylist())
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        at, ends = expand(codes, np.cumsum(sizes) - sizes, sizes)
        ids, rows = flat[at], ends[offsets]
        if pc.any(odd).as_py():
            whole = [np.asarray(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, dtype="<u4") if o.as_py() else ids[i:j] for t, o, i, j in zip(texts, odd, rows[:-1], rows[1:], strict=True)]
            return np.concatenate(whole), np.concatenate([[0], np.cumsum([len(w) for w in whole])])
        return ids, rows


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def held_ids(path: str) -> Ids:
    """One instance for all tasks of a Python worker."""
    return Ids(path)


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces; ``slice_bytes`` of text are tokenized at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = held_ids(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at, stop in slices(batch.column(1), slice_bytes):
                flat, offsets = ids.of(batch.column(1).slice(at, stop - at))
                rows: list[tuple[int, int, int, int, int]] = []
                for i, (first, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    raw = flat[first:last].tobytes() + end
                    short = (len(raw) - 4) % (4 * capacity) + 4  # the first piece; raw has the end token at least
                    for k, s in enumerate([0, *range(short, len(raw), 4 * capacity)]):
                        part = raw[s : s + 4 * capacity if k else short]
                        rows.append((at + i, k, s // 4, len(part) // 4, zlib.crc32(part)))
                row, *rest = np.asarray(rows, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    read = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Placement:
    """Pieces of one length, from a rank on: ``per_bin`` of them in each of ``bins`` sequences from ``first_bin``."""

    length: int
    first_rank: int
    count: int
    per_bin: int
    first_bin: int
    offset: int


class TightestFit:
    """A segment tree over remaining capacities; leaves hold groups (first bin, number of bins) that are alike."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]
        self.filled = [0] * (2 * self.size)

    def _count(self, remaining: int, by: int) -> None:
        node = remaining + self.size
        while node:
            self.filled[node] += by
            node //= 2

    def put(self, remaining: int, first: int, bins: int) -> None:
        if bins:
            self.groups[remaining].append((first, bins))
            self._count(remaining, 1)

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(remaining, first bin, bins) of a group with the least remaining capacity from ``least`` on, taken out."""
        node = least + self.size
        while not self.filled[node]:
            while node & 1:
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        remaining = node - self.size
        self._count(remaining, -1)
        return remaining, *self.groups[remaining].pop()


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Placements of ``counts[length]`` pieces of each length, and the number of bins."""
    tree, out, bins = TightestFit(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining, first, n = tree.take(length) or (capacity, bins, -(-left // (capacity // length)))
            bins = max(bins, first + n)
            per = remaining // length
            full = min(n, left // per)
            if full:
                out.append(Placement(length, rank, full * per, per, first, capacity - remaining))
                tree.put(remaining - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and n > full:
                out.append(Placement(length, rank, left, per, first + full, capacity - remaining))
                tree.put(remaining - left * length, first + full, 1)
                full, left = full + 1, 0
            tree.put(remaining, first + full, n - full)
    return out, bins


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (with doc_id, piece, length) with sequence_id and offset; evaluates its input once."""
    spark = cut_pieces.sparkSession
    written = cut(cut_pieces)
    histogram = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    parts = spark.createDataFrame([(n, -(-count // PART_ROWS)) for n, count in histogram.items()], "length long, __parts long")
    held = written.join(F.broadcast(parts), "length").withColumn("__part", F.pmod(F.xxhash64(*written.columns), F.col("__parts"))).drop("__parts")
    counts = held.groupBy("length", "__part").count()
    before = W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # one row for PART_ROWS pieces, and one for each length
    bases = cut(counts.select("length", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base")))
    plan, _ = best_fit_decreasing(histogram, capacity)
    table = np.asarray([(p.length, p.first_rank, p.per_bin, p.first_bin, p.offset) for p in plan] or np.empty((0, 5)), dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.int64(1) << 48
        starts = table[:, 0] * wide + table[:, 1]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf.pop("__rank").to_numpy()
            _, first_rank, per, first_bin, offset = table[np.searchsorted(starts, length * wide + rank, side="right") - 1].T
            nth = rank - first_rank
            yield pdf.assign(sequence_id=first_bin + nth // per, offset=offset + nth % per * length)

    ranked = held.join(F.broadcast(bases), ["length", "__part"])
    order = W.partitionBy("length", "__part").orderBy(*written.columns)
    ranked = ranked.withColumn("__rank", F.row_number().over(order) - 1 + F.col("__base")).select(*written.columns, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, slice_bytes: int = SLICE) -> DataFrame:
    bounded_batches(documents.sparkSession)
    return pack(pieces(documents, tokenizer_path, capacity, end_id, slice_bytes=slice_bytes), capacity)
