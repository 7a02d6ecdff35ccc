"""Sharding [native]: weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a fixed pseudo-random draw; a record goes to the shard with the smallest draw
-ln(u)/weight. A shard that is added takes records only into itself, a shard that is removed gives away only its own.

Defined results: a null text counts as empty; rows with equal keys (a null key included) share one shard, since the key
alone decides; very long texts are only measured; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, table, uniform


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` weighted shards, as one expression without a shuffle."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.struct((-F.ln(uniform(text, F.lit(str(i)))) / F.lit(float(w))).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.least(*draws)["i"] if len(draws) > 1 else F.lit(0)


def shard(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per record: key, size, text_crc32, shard, slot (gapless within its shard), grown_shard (one shard more)."""
    weights = list(weights or [1.0] * n_shards)
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, weights[-1]]).alias("grown_shard"),
        # the order within a shard; the text's checksum spreads records that share one key
        uniform(F.coalesce(F.col(key).cast("string"), F.lit("")), F.crc32(body).cast("string"), F.lit("slot")).alias("_u"),
    )
    ranked = prefix_sums(placed, ["shard"], "_u", [F.col(key), F.col("text_crc32"), F.col("size")], F.lit(1).cast("long"), "_r", docs.count())
    return ranked.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_r") - 1).alias("slot"), "grown_shard")


def op10_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


#: Smallest draw -ln(u) is greatest u; the table of CRC-32 is made by its rule.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
t AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
b AS (SELECT doc_id, strlen(body) + 1 AS size, list_transform(regexp_extract_all(hex(body), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM b, t),
s AS (SELECT *, list_transform(range(17), lambda i: ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, i::VARCHAR)), 1, 13))::BIGINT) AS u,
  ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text_crc32::VARCHAR, 'slot')), 1, 13))::BIGINT AS place FROM c),
k AS (SELECT *, (list_position(u, list_max(u[1:16])) - 1)::INT AS shard, (list_position(u, list_max(u)) - 1)::INT AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM k
"""
