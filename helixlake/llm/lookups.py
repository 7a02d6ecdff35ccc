"""Counting keys over a whole corpus and handing the answers back to where they were asked.

Documents are dealt into groups of bounded size, and a group asks for its distinct keys with their counts: however often
a key occurs, it is asked for once per group, so no key is hot. The questions are

* rows (grp, key, n): the count table is their sum by key, and a join with it answers each row; or
* frames: a group's keys as sorted arrays cut by key range (bucket), a row each. A bucket adds up what all groups ask for
  and answers each of them in its own order. That takes a third of the bytes while frames are long; as there are groups
  times buckets of them, rows are better beyond FRAMES groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASK = "bucket int, grp int, keys binary, counts binary"
ANSWER = "grp int, bucket int, totals binary"
ROWS = "grp int, k long, n long"
#: Groups up to which frames hold some hundred keys each.
FRAMES = 4096


def grouped(docs: DataFrame, key: str, text: str, bytes_per_group: int = 8 << 20) -> tuple[DataFrame, int]:
    """(grp, id, text) and the number of groups; rows are dealt by a hash of both columns."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, math.ceil(total / bytes_per_group))
    grp = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(groups)).cast("int")
    return docs.select(grp.alias("grp"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), groups


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: high bytes and small counts are mostly alike."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unplanes(data: bytes, kind=np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    plain = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bucket_ranges(keys: np.ndarray, buckets: int):
    """(bucket, first, last + 1) of the runs of sorted keys in one bucket; only buckets with keys."""
    at = bucket_of(keys, buckets)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
    return list(zip(at[first].tolist(), first.tolist(), np.append(first[1:], len(at)).tolist(), strict=True)) if len(at) else []


def ask(grp: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """The questions of a group about its sorted distinct keys."""
    rows = [(b, grp, pack_sorted(keys[a:z]), planes(counts[a:z].astype(np.uint64))) for b, a, z in bucket_ranges(keys, buckets)]
    return table(rows, [("bucket", pa.int32()), ("grp", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def ask_rows(grp: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    return pa.table({"grp": pa.array(np.full(len(keys), grp, np.int32)), "k": pa.array(keys.view(np.int64)), "n": pa.array(counts.astype(np.int64))})


def count_tables(asked: DataFrame) -> DataFrame:
    """(grp, k, n: the count over all other groups) of the rows asked for, where it is not 0.

    Rows are dealt by the key once, for the count table and for the join with it; a key has a row a group at most.
    """
    dealt = asked.repartition("k")
    counts = dealt.groupBy("k").agg(F.sum("n").alias("total"))
    return dealt.join(counts, "k").filter("total > n").select("grp", "k", (F.col("total") - F.col("n")).alias("n"))


def table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    schema = pa.schema(fields)
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sum_bucket(asked: pa.Table) -> pa.Table:
    """The answers of a bucket: each key's count over all other groups, which is mostly 0 and so costs little."""
    parts = [unpack_sorted(x.as_buffer()) for x in asked["keys"]]
    counts = np.concatenate([unplanes(x.as_buffer()) for x in asked["counts"]])
    found, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    sums = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.uint64)
    totals = np.split(sums[inverse] - counts, np.cumsum([len(x) for x in parts])[:-1])
    rows = [(g, b, planes(np.ascontiguousarray(t))) for g, b, t in zip(asked["grp"].to_pylist(), asked["bucket"].to_pylist(), totals, strict=True)]
    return table(rows, [("grp", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])


def answers(replies: pa.Table, keys: np.ndarray) -> np.ndarray:
    """What other groups count for the sorted keys that a group asked for."""
    if "k" in replies.column_names:
        out = np.zeros(len(keys), np.uint64)
        out[np.searchsorted(keys, replies["k"].to_numpy().view(np.uint64))] = replies["n"].to_numpy()
        return out
    order = np.argsort(replies["bucket"].to_numpy(), kind="stable")
    column = replies["totals"]
    return np.concatenate([unplanes(column[int(i)].as_buffer()) for i in order]) if len(order) else np.empty(0, np.uint64)
