"""The default tokenizer's tokens counted, and runs of words hashed, for a batch of texts at once, by their bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from corpusloom.functions.text import SPACE, WORD

#: Bytes of text whose tokens are in memory at a time (a longer text is taken alone).
BYTES = 2 << 20
#: Kinds of characters: white space, those that make up a token together, those that are one each.
WHITE, JOINED, SINGLE = 0, 1, 2
#: An odd base, its inverse modulo 2 ** 64, and an odd number that mixes.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


def _kinds() -> np.ndarray:
    """The kind of every code point, by the classes of the tokenizer's pattern."""
    out = np.full(0x110000, SINGLE, np.uint8)
    for kind, body in ((JOINED, WORD), (WHITE, SPACE)):
        plain = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), body)
        for first, last in re.findall(r"(?s)(.)(?:-(.))?", plain):
            out[ord(first) : ord(last or first) + 1] = kind
    return out


KINDS = _kinds()


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 belongs to."""
    out = KINDS[data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        length = 2 + (data[high] >= 0xE0) + (data[high] >= 0xF0)
        code = data[high] & (0x7F >> length)
        code = code.astype(np.int32)
        for i in (1, 2, 3):
            more = length > i
            code[more] = code[more] << 6 | data[high[more] + i] & 0x3F
        kind = KINDS[code]
        for i in range(4):
            more = length > i
            out[high[more] + i] = kind[more]
    return out


def slices(texts: pa.Array, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of about ``most`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end - at
        at = end


def readable(texts: pa.Array) -> pa.Array:
    """``texts`` with nulls empty and bytes that are no UTF-8 replaced."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each starts and the last ends)."""
    texts = readable(texts)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def tokens_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the tokens of all texts, how many each text has).

    White space is taken out of the bytes, so that tokens lie side by side and are an Arrow array by their starts.
    """
    data, ends = laid_out(texts)
    kind = kinds(data)
    kept, joined = kind != WHITE, kind == JOINED
    goes_on = np.zeros(len(data) + 1, bool)
    goes_on[1:-1] = joined[1:] & joined[:-1]
    goes_on[ends] = False  # a text starts a token anew
    starts = np.flatnonzero(kept & ~goes_on[:-1] & ((data & 0xC0) != 0x80))
    places = np.append(0, np.cumsum(kept, dtype=np.int32)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(places[starts], places[-1])), pa.py_buffer(data[kept])).dictionary_encode()
    return words, np.diff(np.searchsorted(starts, ends))


def hashed(texts: pa.Array, dim: int) -> np.ndarray:
    """Signed feature hashing: of each text's tokens, how many more of a place (the hash modulo ``dim``) count up than down."""
    out = np.empty((len(texts), dim), np.int32)
    for at, n in slices(texts):
        words, per_text = tokens_of(texts.slice(at, n))
        h = np.fromiter(map(zlib.crc32, words.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(words.dictionary))
        number = words.indices.to_numpy()
        places = np.repeat(np.arange(n) * dim, per_text) + (h % dim)[number]
        out[at : at + n] = np.bincount(places, weights=np.where(h >> 31, 1.0, -1.0)[number], minlength=n * dim).reshape(n, dim)
    return out


def counted(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of tokens, array of (term, tf) in order of terms, null where there are none) of each text.

    Third, in the first text's row, how many of all these texts have each term: (term, df).
    """
    n = len(texts)
    words, per_text = tokens_of(texts)
    order = pc.sort_indices(words.dictionary).to_numpy()
    size = max(1, len(order))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    keys = np.repeat(np.arange(n, dtype=np.int64) * size, per_text) + number[words.indices.to_numpy()]
    keys.sort()
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    row, number = np.divmod(keys[firsts], size)
    terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(order[number])), pa.array(np.diff(firsts, append=len(keys)))], ["term", "tf"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), terms, mask=pa.array(per_text == 0))
    have = pa.StructArray.from_arrays([words.dictionary.take(pa.array(order)), pa.array(np.bincount(number, minlength=len(order)))], ["term", "df"])
    return pa.array(per_text), lists, pa.ListArray.from_arrays(pa.array(np.append(0, np.full(n, len(order))).astype(np.int32)), have)


def run_hashes(texts: pa.Array, width: int) -> pa.Array:
    """Hashes of every ``width`` words in a row of each text, words being what stands between white space.

    A word's hash is a sum of its bytes times powers of BASE, taken from sums over all bytes; equal words have equal ones.
    """
    data, ends = laid_out(texts)
    kept = np.zeros(len(data) + 1, bool)
    kept[:-1] = kinds(data) != WHITE
    apart = np.ones(len(data) + 1, bool)
    apart[1:] = ~kept[:-1]
    apart[ends] = True
    starts = np.flatnonzero(kept & apart)
    stops = np.flatnonzero(kept[:-1] & apart[1:] | kept[:-1] & ~kept[1:]) + 1
    powers = np.full(len(data) + 1, BASE, np.uint64)
    powers[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + 1) * np.cumprod(powers)[:-1], out=sums[1:])
    powers[1:] = INVERSE
    words = (sums[stops] - sums[starts]) * np.cumprod(powers)[starts]
    words = (words ^ words >> 32) * np.uint64(MIX)
    words ^= words >> 29
    per_text = np.diff(np.searchsorted(starts, ends))
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        runs = runs * np.uint64(BASE) + words[i : i + len(runs)]
    last = np.repeat(np.cumsum(per_text), per_text)[: len(runs)]  # where the words of a run's text end
    runs = runs[np.arange(len(runs)) + width <= last]
    sizes = np.maximum(per_text - width + 1, 0)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(runs.view(np.int64)))
