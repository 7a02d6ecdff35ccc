r"""Exact dedup: deterministic block naming.

Texts are compared after replacing each run of blanks by one space. A text is cut into blocks of ``block`` bytes; the
distinct blocks are sorted and numbered, which gives each block an integer name; then adjacent names are paired, the
distinct pairs sorted and numbered, and so on until one name is left of each text. Equal names mean equal bytes: no
step can collide. Texts of different block counts finish at different levels or with different pairs (a missing
partner is 0).

A text whose byte length and 64-bit checksum no other text shares has no equal: that pair is its identity, and only the
others go through the naming. A checksum that two different texts share costs time there, never a wrong result.

Defined results: null counts as empty, and empty texts equal each other; of rows that share the smallest doc_id one
is kept; a null doc_id sorts after all others; a very long text is many blocks, of which no task needs more than a few;
other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save
from .common import BLANK, table


def _numbered(values: DataFrame, label: str) -> DataFrame:
    """Distinct rows, sorted, with an integer name from 1 up; saved, as numbers depend on the partitions.

    The order is by checksum and then by the values: partitions are even however many blocks begin alike, and the
    driver's sample of the order holds checksums only.
    """
    columns = values.columns
    ranked = values.distinct().withColumn("_sum", F.xxhash64(*columns)).repartitionByRange("_sum").sortWithinPartitions("_sum", *columns)
    return save(ranked.select(*columns, (F.monotonically_increasing_id() + 1).alias("name")), label)


def block_names(texts: DataFrame, block: int = 4096) -> DataFrame:
    """(rid, level, name) of (rid, body): bodies are equal exactly where level and name are."""
    body = F.col("body").cast("binary")
    count = F.greatest(F.ceil(F.octet_length("body") / block).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(0), count - 1)
    pieces = texts.select("rid", count.alias("n"), F.posexplode(F.transform(starts, lambda i: F.substring(body, i * block + 1, block))).alias("at", "piece"))
    names = _numbered(pieces.select("piece"), "block-names")
    # never broadcast: a block unfolds many times from its compressed size
    now = save(pieces.join(names.hint("merge"), "piece").select("rid", "n", "at", "name"), "named")
    most = now.agg(F.max("n")).first()[0] or 1
    done, level = None, 0
    while True:
        ready = now.filter("n = 1").select("rid", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        if most <= 1:
            return done
        half = F.col("at") % 2 == 0
        pairs = (
            now.filter("n > 1").groupBy("rid", F.expr("(n + 1) div 2").cast("int").alias("n"), F.expr("at div 2").cast("int").alias("at"))
            .agg(F.max(F.when(half, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(0).cast("long")).alias("b"))
        )
        pairs = save(pairs, "pairs")
        names = _numbered(pairs.select("a", "b"), "pair-names")
        now = save(pairs.join(names.hint("merge"), ["a", "b"]).select("rid", "n", "at", "name"), "named")
        most, level = (most + 1) // 2, level + 1


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 4096) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256."""
    body = docs.select(F.col(key).alias("id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, " ").alias("body"))
    body = body.withColumns({"len": F.octet_length("body"), "sum": F.xxhash64("body")})
    narrow = save(body.select("id", "len", "sum", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")), "sums")
    shared = save(narrow.groupBy("len", "sum").count().filter("count > 1").select("len", "sum"), "shared-sums")
    alone = narrow.join(shared, ["len", "sum"], "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = save(body.join(shared, ["len", "sum"]).select(F.monotonically_increasing_id().alias("rid"), "id", "body"), "candidates")
    named = save(block_names(maybe.select("rid", "body"), block).join(maybe.select("rid", "id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")), "rid"), "identities")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    groups = save(named.groupBy("level", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size")), "groups")
    grouped = named.join(groups, ["level", "name"]).select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped).withColumnRenamed("id", key)


def op3_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""
