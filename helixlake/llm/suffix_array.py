"""Enhanced suffix array of a bounded group of texts: all maximal repeats, with all their occurrences.

The suffix array is built by prefix doubling, or for short texts by sorting the suffixes themselves; a stack scan of
the common-prefix lengths visits the interval tree, and an interval is a maximal repeat if the bytes before its
suffixes differ (a text's start differs from everything). Every occurrence of a repeat is given, not only neighbours
in the array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, length of the prefix that each shares with the one before)."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while step < n and rank.max(initial=0) < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):  # longest steps first: equal ranks share 2^k codes
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        same &= (a + (1 << k) <= n) & (b + (1 << k) <= n)
        lcp[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def sorted_suffixes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length of the prefix shared with the one before) of all suffixes of at least ``length`` bytes, in
    order. For short texts: suffixes are sorted as they are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    many = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    keys = [t[i:] for t in texts for i in range(len(t) - length + 1)]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    row, start = row[order], start[order]
    lcp = np.zeros(len(row), np.int64)
    if len(row) > 1:
        width = -(-int(sizes.max()) // 8) * 8
        raw = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
        begin = (np.cumsum(sizes) - sizes)[row] + start
        left = sizes[row] - start
        view = np.lib.stride_tricks.sliding_window_view(raw, width)
        for a in range(1, len(row), 8192):  # bounds the copies
            z = min(len(row), a + 8192)
            words = view[begin[a - 1 : z]].view(np.uint64)
            differ = words[1:] ^ words[:-1]
            at = (differ != 0).argmax(axis=1)
            low = differ[np.arange(z - a), at]
            byte = np.zeros(z - a, np.int64)  # little-endian: the first byte that differs is the lowest that is not 0
            for shift in (32, 16, 8):
                none = (low & np.uint64((1 << shift) - 1)) == 0
                byte += none * (shift // 8)
                low = np.where(none, low >> np.uint64(shift), low)
            same = np.where(differ.any(axis=1), at * 8 + byte, width)
            lcp[a:z] = np.minimum(same, np.minimum(left[a:z], left[a - 1 : z - 1]))
    return row, start, lcp


def stack_scan(lcp: np.ndarray, before: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of suffixes that share at least ``length`` bytes and have different bytes
    before them, one linear scan."""
    out: list[tuple[int, int, int]] = []
    if len(lcp) < 2:
        return out
    change = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    deep = np.where(lcp >= length, lcp, 0)
    deep[0] = 0
    turn = np.flatnonzero(np.concatenate((deep[1:] != deep[:-1], [True]))) + 1  # nothing happens between
    depths = np.append(deep, 0)[turn].tolist()
    change = change.tolist()
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
    for i, depth in zip(turn.tolist(), depths, strict=True):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if change[i - 1] > change[first]:
                out.append((d, first, i - 1))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def maximal_repeats(texts: list[bytes], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, start)]) of each repeat of at least ``length`` bytes that no byte on either side extends."""
    # every text ends in a code of its own, so no common prefix runs across texts
    parts = [np.concatenate((np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), [i])) for i, t in enumerate(texts)]
    if not parts:
        return []
    codes = np.concatenate(parts)
    begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1]
    order, lcp = suffix_array(codes)
    row = np.searchsorted(begins, order, side="right") - 1
    before = np.where(order == begins[row], -1 - row, codes[np.maximum(order - 1, 0)])
    return [(d, sorted(zip(row[a : z + 1].tolist(), (order[a : z + 1] - begins[row[a : z + 1]]).tolist(), strict=True))) for d, a, z in stack_scan(lcp, before, length)]


def repeated_spans(texts: list[bytes], length: int) -> list[list[int]]:
    """[start, end, start, end, ...] of each short text: what its maximal repeats with the others (or itself) cover."""
    row, start, lcp = sorted_suffixes(texts, length)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)  # a place more for each text's end
    raw = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    place = base[row] + start if len(row) else np.empty(0, np.int64)
    before = np.where(start == 0, -1 - row, raw[np.maximum(place - 1, 0)].astype(np.int64)) if len(row) else place
    edge = np.zeros(len(raw) + 1, np.int32)
    for some in _blocks(stack_scan(lcp, before, length), 1 << 20):
        d, a, z = np.array(some, np.int64).T
        n = z - a + 1
        at = place[np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        edge += np.bincount(at, minlength=len(edge)).astype(np.int32)
        edge -= np.bincount(at + np.repeat(d, n), minlength=len(edge)).astype(np.int32)
    inside = np.cumsum(edge[:-1]) > 0
    flips = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    text = np.searchsorted(base, flips[::2], side="right") - 1
    out: list[list[int]] = [[] for _ in texts]
    for t, a, z in zip(text.tolist(), flips[::2].tolist(), flips[1::2].tolist(), strict=True):
        out[t] += (a - int(base[t]), z - int(base[t]))
    return out


def _blocks(intervals: list[tuple[int, int, int]], occurrences: int):
    """The intervals in blocks of about so many occurrences."""
    held, n = [], 0
    for x in intervals:
        held.append(x)
        n += x[2] - x[1] + 1
        if n >= occurrences:
            yield held
            held, n = [], 0
    if held:
        yield held


def repeat_groups(docs: DataFrame, group: str, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, repeat, n_bytes, key, start): one row per occurrence of each maximal repeat among the texts of a group.

    A group is one task and must fit it (a class of near copies, the documents of a site): the caller bounds it.
    Null texts are empty; a null group is a group.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in (group, key)]

    def find(part: pa.Table) -> pa.Table:
        texts = [(x or "").encode() for x in part["text"].to_pylist()]
        rows = [(i, n, r, at) for i, (n, where) in enumerate(maximal_repeats(texts, length)) for r, at in where]
        which = pa.array([r[2] for r in rows], pa.int64())
        ids = part["id"].combine_chunks()
        return pa.table({"grp": part["grp"].combine_chunks().take(pa.array([0] * len(rows), pa.int64())), "repeat": pa.array([r[0] for r in rows], pa.int64()), "n_bytes": pa.array([r[1] for r in rows], pa.int64()), "id": ids.take(which), "start": pa.array([r[3] for r in rows], pa.int64())})

    slim = docs.select(F.col(group).alias("grp"), F.col(key).alias("id"), F.col(text).alias("text"))
    found = slim.groupBy("grp").applyInArrow(find, f"grp {kinds[0]}, repeat long, n_bytes long, id {kinds[1]}, start long")
    return found.withColumnsRenamed({"grp": group, "id": key})
