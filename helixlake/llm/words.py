"""Words and word n-grams of whole Arrow batches, in numpy: no Python object per word.

A word is a run of digits, letters and non-ASCII bytes, A-Z lower-cased. Words and n-grams are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_code = np.arange(256)
IS_WORD = ((_code >= 48) & (_code <= 57)) | ((_code >= 65) & (_code <= 90)) | ((_code >= 97) & (_code <= 122)) | (_code >= 128)
FOLD = np.where((_code >= 65) & (_code <= 90), _code + 32, _code)
#: A random number per (lower-cased) byte, the same on every machine.
BYTE = np.random.Generator(np.random.PCG64(20240613)).integers(1, 2**63, 256, dtype=np.uint64)[FOLD] | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Text is worked on in pieces of about so many bytes, which bounds the working memory.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK):
    """Ranges [a, b) of rows of about ``size`` bytes; a longer row is a range of its own."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        yield a, b
        a = b


def tokenise(raw: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...] = ()):
    """(word hashes, bounds of each row's words, hashes of each word's first bytes for each prefix length)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64), [np.empty(0, np.uint64) for _ in prefixes]
    is_word = IS_WORD[raw]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    rows = off[:-1][off[:-1] < n]
    first[rows] = is_word[rows]
    at = np.flatnonzero(is_word)
    begin = np.flatnonzero(first[at])
    starts = at[begin]
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64), [np.empty(0, np.uint64) for _ in prefixes]
    sizes = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, sizes)
    value = BYTE[raw[at]] * _powers(int(place.max()) + 1)[place]
    words = mix(np.add.reduceat(value, begin) ^ sizes.astype(np.uint64))
    heads = [mix(np.add.reduceat(np.where(place < k, value, np.uint64(0)), begin) + np.uint64(k)) for k in prefixes]
    return words, np.searchsorted(starts, off), heads


def ngrams(words: np.ndarray, bounds: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams, bounds of each row's n-grams). short: a row of 1 to n - 1 words has one n-gram, of all its words."""
    total = len(words)
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(total)
    fits = at + n <= end
    if short:
        fits |= at == np.repeat(bounds[:-1], np.diff(bounds))
    start = np.flatnonzero(fits)
    out = np.zeros(len(start), np.uint64)
    for j in range(n):
        k = start + j
        inside = k < end[start]
        out = mix(out + np.uint64(j + 1)) + np.where(inside, words[np.minimum(k, total - 1)], np.uint64(0))
    return mix(out), np.searchsorted(start, bounds)


def per_row_unique(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, how often each occurs, and the new bounds."""
    kept, counts, sizes = [], [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x = np.sort(values[a:b])
        if len(x):
            new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            kept.append(x[new])
            counts.append(np.diff(np.append(new, len(x))))
            sizes.append(len(new))
        else:
            sizes.append(0)
    out = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    empty = np.empty(0, np.int64)
    return (np.concatenate(kept) if kept else np.empty(0, np.uint64)), (np.concatenate(counts) if counts else empty), out
