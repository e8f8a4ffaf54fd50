"""Small shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text bytes that one vectorised step inside a Python worker handles at a time.
SLICE_BYTES = 700_000

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

_LIBRARY = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: lineage ends here and lost executors cost no rerun.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a session of one machine (tests) makes a
    temporary one and any other is refused. Rows are stored as compressed Parquet, so that later readers take only the
    columns they need; the files stay until the folder is cleared.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows, counted while they are written."""
    seen = Observation()
    held = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return held, seen.get["n"]


def give_back() -> None:
    """Returns memory that is free inside this Python process to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBRARY, "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends at most BATCH_ROWS rows at a time to Python, as whole texts may be long."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, and no other letter changed."""
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: CRC-32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


# ---------------------------------------------------------------------------------------------- words of Arrow batches


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) row ranges whose texts hold about ``limit`` bytes; one longer text makes a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield start, i
            give_back()
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
    give_back()


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text as (codes of all words, row offsets, the distinct words).

    Null texts have no words; ``lower`` turns A-Z to a-z.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten()
    offsets = np.asarray(split.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():  # leading and trailing white space leave empty pieces
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    coded = flat.dictionary_encode()
    codes, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    if lower:  # only the distinct words: lower-casing a slice that was cast gives wrong offsets in some Arrow releases
        coded = pc.ascii_lower(distinct).dictionary_encode()
        codes, distinct = np.asarray(coded.indices).astype(np.int64)[codes], coded.dictionary
    return codes, offsets, distinct


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def word_hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each distinct word's bytes."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(distinct))


def windows_hash(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries (a polynomial of the mixed entries, mixed again)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    out = np.full(n, np.uint64(seed + width), dtype=np.uint64)
    for k in range(width):
        out = out * base + hashes[k : k + n]
    return mix(out)


def byte_table(lower: bool, gap: bytes, breaks: bytes = b"") -> bytes:
    """A map of all bytes for ``mapped_words``: ``gap`` and ``breaks`` to space and line feed, A-Z to a-z if ``lower``."""
    table = bytearray(range(256))
    if lower:
        table[ord("A") : ord("Z") + 1] = LOWER.encode()
    for to, listed in ((b" ", gap), (b"\n", breaks)):
        for b in listed:
            table[b] = to[0]
    return bytes(table)


def mapped_words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words of each text once its bytes are mapped: (codes of all words, row offsets, distinct words, part of each word).

    Mapped spaces and line feeds stand between words, line feeds also between parts; parts are numbered upwards and none
    goes from one text to the next. Null texts have no words. ``table`` leaves bytes from 128 on as they are.
    """
    held = pc.fill_null(texts.cast(pa.large_string()), "")
    none = np.empty(0, np.int64)
    if not len(held):
        return none, np.zeros(1, np.int64), pa.array([], pa.large_string()), none
    _, ends, data = held.buffers()
    ends = np.frombuffer(ends, np.int64)[held.offset : held.offset + len(held) + 1]
    mapped = np.frombuffer(bytes(memoryview(data or b"")[ends[0] : ends[-1]]).translate(table), np.uint8)
    ends = ends - ends[0]
    breaks = mapped == 10
    gap = breaks | (mapped == 32)
    filled = np.flatnonzero(np.diff(ends))
    before, after = np.append(True, gap)[: len(gap)], np.append(gap, True)[1:]  # is a word's first byte, its last byte here?
    before[ends[filled]] = True
    after[ends[filled + 1] - 1] = True
    starts, stops = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    sizes = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(mapped[~gap])))
    coded = words.dictionary_encode()
    offsets = np.searchsorted(starts, ends)
    part = np.cumsum(breaks)[starts] + np.repeat(np.arange(len(held)), np.diff(offsets)) if len(starts) else none
    return np.asarray(coded.indices).astype(np.int64), offsets, coded.dictionary, part
