"""Texts split where byte-level tokenizers split them, in Arrow batches.

The public pattern always breaks before a single space and around a single line feed between other characters, so such
texts are cut there first and each distinct piece of a batch is matched once; all other texts are matched whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that is not a single space or line feed between other characters, and the mark used for splitting.
ODD_SPACE = r"[\x01\t\r\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"

#: A space or none, and letters of the Latin blocks: one match of the public pattern.
PLAIN_WORD = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"


def odd_space(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, ODD_SPACE)


def space_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of all pieces, row offsets, distinct pieces) of texts without odd space; pieces begin with their space."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01")
    split = pc.split_pattern(marked, "\x01")
    coded = split.flatten().dictionary_encode()
    offsets = np.asarray(split.offsets).astype(np.int64)
    return np.asarray(coded.indices).astype(np.int64), offsets - offsets[0], coded.dictionary


@lru_cache(maxsize=4)
def finder(pattern: str):
    import regex

    return regex.compile(pattern).findall


def expand(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the entries that the codes stand for, one after the other; the end of each code's entries, from 0)."""
    each = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(each)])
    return np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1]), ends


def pretokens(texts: pa.Array, pattern: str, find: Callable[[str], list[str]] | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of all matches of ``pattern``, row offsets, distinct matches); null texts have none.

    ``find`` gives the matches in a text, where another finder than the pattern's is wanted.
    """
    from public_tokenizers import PATTERN

    texts, find = pc.fill_null(texts.cast(pa.large_string()), ""), find or finder(pattern)
    odd = np.asarray(odd_space(texts)) if pattern == PATTERN else np.ones(len(texts), bool)
    codes, offsets, distinct = space_words(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts))
    # a text that is matched whole counts as a piece of its own, in place of its only, empty one
    whole = np.flatnonzero(odd)
    codes[offsets[whole]] = len(distinct) + np.arange(len(whole))
    plain = np.asarray(pc.match_substring_regex(distinct, PLAIN_WORD))
    found = [find(t) for t in chain(distinct.filter(pa.array(~plain)).to_pylist(), texts.take(pa.array(whole)).to_pylist())]
    sizes, starts = np.ones(len(distinct) + len(whole), np.int64), np.zeros(len(distinct) + len(whole), np.int64)
    others = np.concatenate([np.flatnonzero(~plain), len(distinct) + np.arange(len(whole))])
    sizes[others] = np.fromiter(map(len, found), np.int64, len(found))
    n_plain = int(plain.sum())
    starts[: len(distinct)][plain] = np.arange(n_plain)
    starts[others] = n_plain + np.cumsum(sizes[others]) - sizes[others]
    coded = pa.concat_arrays([distinct.filter(pa.array(plain)), pa.array(list(chain.from_iterable(found)), pa.large_string())]).dictionary_encode()
    entries, ends = expand(codes, starts, sizes)
    return np.asarray(coded.indices).astype(np.int64)[entries], ends[offsets], coded.dictionary
