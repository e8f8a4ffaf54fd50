"""Byte-level BPE by a contiguous array of ranks, and decoding.

A word starts as its bytes, one part each, with the rank of joining every part with the next one beside it. Each step scans
for the least rank, deletes the boundary behind it, and looks up the ranks of the new part with its two neighbours, until
no pair has a rank. Words of up to SHORT bytes are held as rows of one matrix for each length, so that a step is a few
numpy calls for all of them; every row loses one part a step until it is done. Scanning is quadratic, so longer words
keep their ranks in a heap instead, with the same outcome.

Texts are split where the vocabulary's library splits them, special tokens' texts first (they are ids of their own);
each worker remembers the ids of the words it met last, a bounded number, which never changes a result.
Decoding puts the bytes of each id one after the other and reads them as UTF-8.

Defined cases: null text is empty; an empty text has no ids and decodes to an empty text; repeated rows get equal results;
null ids are kept; bytes that are not UTF-8 decode to U+FFFD; the time for one long unbroken word grows as n log n; columns
of the input other than the id and the text are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _rows, _values, by_heap
from .common import bounded_batches, slices
from .packing import _byte_letters
from .pretokens import expand, finder, pretokens

#: Bytes of a short word; words that a worker remembers, in each of two generations; text bytes that it encodes at a time.
SHORT, REMEMBERED, SLICE = 48, 120_000, 1_500_000
NEVER = np.int64(1) << 40

#: Characters that all Unicode versions in use class alike; words with others are split by the library itself.
SETTLED = regex.compile("[\x00-\u024f\u2010-\u2027\u20ac]*")


def _decoded(ids: np.ndarray, rows: np.ndarray, pieces: pa.Array) -> pa.Array:
    """Of each row, the pieces of its ids one after the other."""
    taken = pieces.take(pa.array(ids))  # its buffer holds the pieces one after the other
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(taken)).astype(np.int64))])[rows]
    return _rows(np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: offsets[-1]], offsets)


class Vocabulary:
    """Ids, merges and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model, special = read["model"], read["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or read["normalizer"] or read["pre_tokenizer"]["type"] != "ByteLevel" or any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("the vocabulary is not plain byte-level BPE")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.pattern, self.library = PATTERN, Tokenizer.from_file(path).pre_tokenizer
        self.as_byte = {c: b for b, c in _byte_letters().items()}
        letters = _byte_letters()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in special}
        #: Bytes of each id, for decoding.
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = bytes(self.as_byte[c] for c in token) if all(c in self.as_byte for c in token) else token.encode()
        self.of_byte = np.asarray([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first, second, joined = (np.asarray(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], strict=True))
        keys = first << 32 | second
        order = np.argsort(keys, kind="stable")
        #: Pairs of ids in order, and of each its rank and the id of both together in one number.
        self.pairs, self.ranked = keys[order], (order << 20) | joined[order]
        self.least = dict(zip(keys.tolist(), (np.arange(len(keys)) << 20 | joined).tolist(), strict=True))
        splits = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.splitter = regex.compile(f"({splits})") if splits else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of joining ``a`` with ``b``, and in the low bits the id of both; NEVER where they do not join."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranked[at], NEVER)

    def short(self, words: np.ndarray) -> list[np.ndarray]:
        """Ids of words of one length, given as a matrix of bytes."""
        parts = self.of_byte[words]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(parts)
        row = np.arange(len(parts))
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            each = np.arange(len(row))
            least = ranks[each, at] if ranks.shape[1] else np.full(len(row), NEVER)
            done = least >= NEVER
            for i, ids in zip(row[done].tolist(), parts[done], strict=True):
                out[i] = ids
            on = ~done
            row, at, least, each = row[on], at[on], least[on], each[: int(on.sum())]
            if not len(row):
                break
            # the boundary behind ``at`` goes: later parts and ranks move up by one
            behind = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts[on], behind + (behind > at[:, None]), axis=1)
            parts[each, at] = least & ((1 << 20) - 1)
            between = behind[:-1]
            ranks = np.take_along_axis(ranks[on], between + (between >= at[:, None]), axis=1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < parts.shape[1] - 1)
            ranks[before, at[before] - 1] = self.rank(parts[before, at[before] - 1], parts[before, at[before]])
            ranks[after, at[after]] = self.rank(parts[after, at[after]], parts[after, at[after] + 1])
        return out

    def long(self, word: bytes) -> np.ndarray:
        """Ids of one word, its ranks in a heap: the least rank first, then the leftmost."""
        return np.asarray(by_heap(self.of_byte[np.frombuffer(word, np.uint8)].tolist(), self.least.get), np.int64)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            size = int(sizes[group[0]]) if len(group) else 0
            if not size:
                continue
            if size <= SHORT:
                found = self.short(np.frombuffer(b"".join(words[i] for i in group.tolist()), np.uint8).reshape(len(group), size))
            else:
                found = [self.long(words[i]) for i in group.tolist()]
            for i, ids in zip(group.tolist(), found, strict=True):
                out[i] = ids.astype("<u4").tobytes()
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text (without special tokens)."""
        if SETTLED.fullmatch(text):
            return finder(self.pattern)(text)
        raw = (bytes(self.as_byte[c] for c in word) for word, _ in self.library.pre_tokenize_str(text))
        return [w.decode() for w in raw]


class Encoder:
    """Ids of whole texts; holds the words met last."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.pieces = pa.array(self.vocabulary.pieces, pa.large_binary())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        out, fresh = list(map(self.young.get, words)), []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = self.old.get(words[i])
            if ids is None:
                fresh.append(i)
            else:
                out[i] = self.young[words[i]] = ids
        for i, ids in zip(fresh, self.vocabulary.encode_words([words[i].encode() for i in fresh]), strict=True):
            out[i] = ids
            if len(words[i]) <= SHORT:
                self.young[words[i]] = ids
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets, distinct = pretokens(texts, self.vocabulary.pattern, self.vocabulary.split)
        known = self._words(distinct.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at, ends = expand(codes, np.cumsum(sizes) - sizes, sizes)
        return np.frombuffer(b"".join(known), "<u4")[at], ends[offsets]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, row offsets)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        splitter = self.vocabulary.splitter
        marked = np.zeros(len(texts), bool)
        for t in self.vocabulary.special:
            marked |= np.asarray(pc.match_substring(texts, t))
        if not marked.any():
            return self._plain(texts)
        # each text as its stretches between special tokens, which stand at the odd places
        cut = [splitter.split(t.as_py()) if m else [t.as_py()] for t, m in zip(texts, marked.tolist(), strict=True)]
        flat, ends = self._plain(pa.array([s for parts in cut for s in parts[::2]], pa.large_string()))
        found, sizes, k = [], [], 0
        for parts in cut:
            n = 0
            for i, part in enumerate(parts):
                ids = np.asarray([self.vocabulary.special[part]], "<u4") if i % 2 else flat[ends[k] : ends[k + 1]]
                k += 1 - i % 2
                found.append(ids)
                n += len(ids)
            sizes.append(n)
        return np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each row of ids."""
        raw = _decoded(ids.astype(np.int64), offsets, self.pieces)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:  # some id sequences are not UTF-8
            return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())


@lru_cache(maxsize=1)
def held(path: str) -> Encoder:
    """One instance for all tasks of a Python worker."""
    return Encoder(path)


def encode_documents(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lists: bool = True) -> DataFrame:
    """(doc_id, id_bytes, ids if ``lists``, decoded): each text's ids, and the text that they decode to.

    ``id_bytes`` holds the ids as little-endian unsigned 32-bit integers.
    """
    bounded_batches(documents.sparkSession)
    kind = documents.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(tokenizer_path)
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE):
                ids, rows = encoder.encode(batch.column(1).slice(start, stop - start))
                found = {"doc_id": batch.column(0).slice(start, stop - start), "id_bytes": _rows(ids, rows)}
                if lists:
                    found["ids"] = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*found.values(), encoder.decode(ids, rows)], names=[*found, "decoded"])

    read = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, id_bytes binary, " + ("ids array<int>, " if lists else "") + "decoded string")


def decode(id_bytes: Column, tokenizer_path: str) -> Column:
    """The text of ids given as little-endian unsigned 32-bit integers; null stays null."""

    def run(rows: pa.Array) -> pa.Array:
        encoder, parts = held(tokenizer_path), []
        for start, stop in slices(rows, SLICE):
            part = rows.slice(start, stop - start)
            ids, offsets = _values(part, np.dtype("<u4"))
            parts.append(pc.if_else(pc.is_valid(part), encoder.decode(ids, offsets), pa.scalar(None, pa.string())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(run, "string")(id_bytes)
