"""Repeated-substring dedup over whole UTF-8 texts, by the common-prefix interval tree of their suffixes.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else. Suffixes that share such a
string meet by its anchor: the least hash among the ``gram``-byte strings inside it, leftmost of ties, so equal strings
have equal anchors at equal places. The strings of a text with one anchor form a range of starts; the bytes under that
range are the anchor's context.

1. Groups of documents list the (anchor, context) pairs of their texts, contexts by a hash of their own. A pair that
   occurs twice repeats all its strings; an anchor whose one context occurs once repeats none. Only anchors with
   several contexts are open.
2. The contexts of open anchors, each once, are dealt to buckets of bounded size by a hash of the anchor. Each bucket
   builds the enhanced suffix array of its contexts, and the stack scan of its interval tree with the left-extension
   test gives the maximal repeats with all their occurrences (suffix_array.py); what they cover goes.
3. An anchor with more than ``crowd`` contexts does not fit a bucket (the edge of a passage that very many documents
   share): its strings are named by 128-bit hashes beside the anchor's 64, and names that start twice mark their bytes.

So strings are told apart by their bytes, or by 128 bits and more.

Defined results: null counts as empty; texts shorter than ``length`` keep all bytes; rows that are equal are each
other's copies and lose all bytes if they are long enough (those equal in key too share a group of documents); a very
long text is a group of its own and worked on in pieces, so its task holds it and a few numbers per changed byte; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from . import lookups
from .common import table, trim
from .suffix_array import repeated_spans
from .words import CHUNK, chunks, mix, text_buffer

#: A random number per byte, the same on every machine; and the base of the rolling hash with its inverse mod 2^64.
BYTE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

_tables: dict[int, tuple[int, list]] = {}


def _powers(n: int, which: int) -> list[np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if _tables.get(which, (0,))[0] != size:
        both = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _tables[which] = (size, both)
    return [x[:n] for x in _tables[which][1]]


class Rolling:
    """Hashes of any strings of some bytes, the same wherever a string is."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        up, self.down = _powers(len(raw) + 1, which)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[which][raw] * up[:-1])))

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start])


class Anchored:
    """The ``length``-byte strings of a run of texts, by anchor: first and last start, anchor hash g, context hash c."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int, gram: int):
        n = len(raw)
        self.first = self.last = np.empty(0, np.int64)
        self.g = self.c = np.empty(0, np.uint64)
        if n < length:
            return
        hashed = Rolling(raw)
        least = grams = hashed(np.arange(n - gram + 1), gram)
        where = np.arange(len(grams), dtype=np.int32)
        have, want = 1, length - gram + 1
        while have < want:  # minimum over want grams, by doubling
            step = min(have, want - have)
            right = least[step:] < least[: len(least) - step]
            least = np.where(right, least[step:], least[: len(least) - step])
            where = np.where(right, where[step:], where[: len(where) - step])
            have += step
        starts = np.arange(len(where))
        row = np.searchsorted(off, starts, side="right") - 1
        good = np.flatnonzero(starts + length <= off[row + 1])  # strings never cross texts
        if not len(good):
            return
        where = where[good]
        new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (good[1:] != good[:-1] + 1))))
        anchor = where[new].astype(np.int64)
        self.first = good[new]
        self.last = good[np.append(new[1:], len(good)) - 1]
        self.g = grams[anchor]
        span = self.last - self.first
        self.c = mix(hashed(self.first, span + length) ^ (span.astype(np.uint64) << np.uint64(32)) ^ (anchor - self.first).astype(np.uint64))


def runs(off: np.ndarray, length: int):
    """(first byte, last byte + 1, bounds of texts inside) of runs of about CHUNK bytes; a longer text is cut into runs
    that overlap, so that every string is in one of them."""
    for a, b in chunks(off):
        if b > a + 1 or off[b] - off[a] <= 2 * CHUNK:
            yield int(off[a]), int(off[b]), off[a : b + 1] - off[a]
        else:
            for low in range(int(off[a]), int(off[b]), CHUNK):
                high = min(int(off[b]), low + CHUNK + length - 1)
                yield low, high, np.array([0, high - low])


class Group:
    """The anchors of a group of documents."""

    def __init__(self, group: pa.Table, length: int, gram: int):
        self.raw, self.off = text_buffer(group["text"].combine_chunks())
        first, last, g, c = [], [], [], []
        for a, z, off in runs(self.off, length):
            x = Anchored(self.raw[a:z], off, length, gram)
            first.append(x.first + a), last.append(x.last + a), g.append(x.g), c.append(x.c)
        self.first, self.last = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, last))
        self.g, self.c = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (g, c))

    def places(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """For rows with (g, c): the row that each anchor of the group is in (-1: none), and for each row its first anchor."""
        g, c = (rows[x].to_numpy().view(np.uint64) for x in ("g", "c"))
        place = pairs(np.concatenate((g, self.g)), np.concatenate((c, self.c)))[3]
        row_of = np.full(int(place.max(initial=-1)) + 1, -1)
        row_of[place[: len(g)]] = np.arange(len(g))
        of = row_of[place[len(g) :]]
        begin = np.full(len(g), -1)
        known = np.flatnonzero(of >= 0)[::-1]
        begin[of[known]] = known
        return of, begin


def pairs(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (g, c) in order, their counts, and the place of each input among them."""
    order = np.lexsort((c, g))
    sg, sc = g[order], c[order]
    new = np.concatenate(([True], (sg[1:] != sg[:-1]) | (sc[1:] != sc[:-1]))) if len(sg) else np.empty(0, bool)
    place = np.empty(len(g), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return sg[at], sc[at], np.diff(np.append(at, len(sg))), place


def _by_trees(contexts: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """(grp, g, c, spans) of contexts (grp, g, c, repeats, body), by one interval tree a bucket."""
    size = contexts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = size // bucket_bytes + 1

    def cover(bucket: pa.Table) -> pa.Table:
        spans = repeated_spans([x.as_buffer().to_pybytes() for x in bucket["body"]], length)
        trim()
        some = np.array([bool(x) for x in spans], bool) & ~bucket["repeats"].to_numpy()
        rest = bucket.select(["grp", "g", "c"]).filter(pa.array(some))
        return rest.append_column("spans", pa.array([x for x, s in zip(spans, some.tolist(), strict=True) if s], pa.list_(pa.int32())))

    dealt = contexts.select("grp", "g", "c", "repeats", "body", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(cover, "grp int, g long, c long, spans array<int>")


def _by_names(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many contexts: strings are named, and names are counted."""

    def name(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                bodies = [x.as_buffer() for x in some.column(4)]
                raw = np.frombuffer(b"".join(bodies), np.uint8)
                sizes = np.array([len(x) for x in bodies])
                many = sizes - length + 1
                which = np.repeat(np.arange(len(sizes)), many)
                at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                start = (np.cumsum(sizes) - sizes)[which] + at
                names = [pa.array(Rolling(raw, k)(start, length).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(which)) for c in range(4)), pa.array(at.astype(np.int32)), *names], ["grp", "g", "c", "repeats", "at", "n1", "n2"])

    named = contexts.select("grp", "g", "c", "repeats", "body").mapInArrow(name, "grp int, g long, c long, repeats boolean, at int, n1 long, n2 long")
    named = save(named, "crowded-names")
    # a context that occurs twice is listed once
    twice = named.groupBy("g", "n1", "n2").agg(F.sum(F.when(F.col("repeats"), 2).otherwise(1)).alias("n")).filter("n > 1").select("g", "n1", "n2")
    hit = named.filter("NOT repeats").join(save(twice, "crowded-repeats"), ["g", "n1", "n2"])
    return hit.groupBy("grp", "g", "c").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + length))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", gram: int | None = None, bytes_per_group: int = 8 << 20, bucket_bytes: int = 1 << 20, crowd: int = 1024) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    gram = gram or length // 2
    dealt, _ = lookups.grouped(docs, key, text, bytes_per_group)
    kind = docs.schema[key].dataType.simpleString()

    def request(group: pa.Table) -> pa.Table:
        x = Group(group, length, gram)
        g, c, n, _ = pairs(x.g, x.c)
        return pa.table({"grp": pa.array(np.full(len(g), group["grp"][0].as_py(), np.int32)), "g": pa.array(g.view(np.int64)), "c": pa.array(c.view(np.int64)), "n": pa.array(n.astype(np.int32))})

    def bodies(group: pa.Table, wanted: pa.Table) -> pa.Table:
        x = Group(group, length, gram) if wanted.num_rows else None
        begin = x.places(wanted)[1] if x else np.empty(0, np.int64)
        text_of = [x.raw[x.first[i] : x.last[i] + length].tobytes() for i in begin.tolist()]
        return wanted.select(["grp", "g", "c", "repeats", "contexts"]).append_column("body", pa.array(text_of, pa.binary()))

    def finish(group: pa.Table, found: pa.Table) -> pa.Table:
        raw, off = text_buffer(group["text"].combine_chunks())
        edge = np.zeros(len(raw) + 1, np.int32)
        if found.num_rows:
            x = Group(group, length, gram)
            of, begin = x.places(found)
            whole = found["spans"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
            gone = np.flatnonzero((of >= 0) & whole[of])
            np.add.at(edge, x.first[gone], 1)
            np.add.at(edge, x.last[gone] + length, -1)
            part = found.filter(pa.array(~whole))["spans"].combine_chunks()
            ends = part.flatten().to_numpy().reshape(-1, 2)
            start = np.repeat(x.first[begin[~whole]], np.diff(part.offsets.to_numpy()) // 2)
            np.add.at(edge, start + ends[:, 0], 1)
            np.add.at(edge, start + ends[:, 1], -1)
        trim()
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        rows = off[:-1][off[:-1] < len(raw)]
        begins[rows] = gone[rows]
        removed, spans = (np.concatenate(([0], np.cumsum(v)))[off] for v in (gone, begins))
        kept = [raw[a:z][~gone[a:z]].tobytes() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return pa.table({key: group["id"].combine_chunks(), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "n_spans": pa.array(np.diff(spans), pa.int64()), "kept": pa.array(kept, pa.binary())})

    by_group = dealt.groupBy("grp")
    pair = Window.partitionBy("g", "c")
    asked = by_group.applyInArrow(request, "grp int, g long, c long, n int")
    # a pair has a row a group at most
    seen = asked.select("grp", "g", "c", (F.sum("n").over(pair) > 1).alias("repeats"), (F.col("grp") == F.min("grp").over(pair)).alias("own"))
    seen = save(seen, "anchors")
    open_ = save(seen.filter("own").groupBy("g").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "open-anchors")
    live = save(seen.join(open_, "g", "left").filter("repeats OR contexts IS NOT NULL"), "live-anchors")
    wanted = live.filter("own AND contexts IS NOT NULL").select("grp", "g", "c", "repeats", "contexts")
    contexts = by_group.cogroup(wanted.groupBy("grp")).applyInArrow(bodies, "grp int, g long, c long, repeats boolean, contexts long, body binary")
    contexts = save(contexts, "contexts")
    found = live.filter("repeats").select("grp", "g", "c", F.lit(None).cast("array<int>").alias("spans"))
    found = found.unionByName(save(_by_trees(contexts.filter(F.col("contexts") <= crowd), length, bucket_bytes), "covered"))
    if not (crowded := contexts.filter(F.col("contexts") > crowd)).isEmpty():
        found = found.unionByName(save(_by_names(crowded, length), "covered-in-crowds"))
    return by_group.cogroup(found.groupBy("grp")).applyInArrow(finish, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_repeats(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string, cut out of the hexadecimal text (in blocks of 1,000 starts) and told apart by its MD5.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, k * 1000 AS base, substr(h, (k * 2000 + 1)::INT, 2398) AS part, least(1000, n - 199 - k * 1000) AS many FROM (SELECT *, unnest(range((n - 199 + 999) // 1000)) AS k FROM d WHERE n >= 200)),
w AS (SELECT doc_id, base + i AS pos, md5(substr(part, (2 * i + 1)::INT, 400)) AS s FROM (SELECT *, unnest(range(many)) AS i FROM b)),
r AS (SELECT doc_id, pos FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
p AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM r),
k AS (SELECT *, sum((prev IS NULL OR pos > prev + 200)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM p),
sp AS (SELECT doc_id, k, min(pos) AS a, max(pos) + 200 AS z FROM k GROUP BY doc_id, k),
g AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM sp),
x AS (SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, (2 * y + 1)::INT, (2 * (a - y))::INT), '' ORDER BY a) || any_value(substr(h, (2 * l + 1)::INT)) AS kept
  FROM g JOIN d USING (doc_id) JOIN (SELECT doc_id, max(z) AS l FROM sp GROUP BY doc_id) USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
"""


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(removed bytes, spans, remaining bytes) of each text, by counting every string."""
    seen: dict[bytes, int] = {}
    for x in texts:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), spans, kept))
    return out
