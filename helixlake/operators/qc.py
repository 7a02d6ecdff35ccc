"""Proof by query that nothing leaks between splits, and lineage gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("split_group", "genome_id", "contig_id", "chunk_hash")


def observations(chunks: DataFrame, kinds: tuple[str, ...] = KINDS, label: str = "labels") -> DataFrame:
    """(kind, key, split, label): one row per chunk and kind."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in kinds])
    return chunks.select("split", F.col(label).cast("string").alias("label"), F.explode(pairs).alias("o")).select("o.kind", "o.key", "split", "label")


def crossing(obs: DataFrame) -> DataFrame:
    """(kind, key, splits) of keys in more than one split."""
    return obs.groupBy("kind", "key").agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def overlap_counts(obs: DataFrame) -> DataFrame:
    return crossing(obs).groupBy("kind").agg(F.count("*").alias("overlaps"))


def overlap_examples(obs: DataFrame, n: int = 20) -> DataFrame:
    return crossing(obs).select("kind", "key", F.array_join("splits", ",").alias("splits")).orderBy("kind", "key").limit(n)


def label_conflicts(obs: DataFrame) -> DataFrame:
    return obs.filter("kind = 'chunk_hash'").groupBy("key").agg(F.countDistinct("label").alias("labels")).filter("labels > 1")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side more often than on the other: equality whatever the order."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, total, parity): a digest of a multiset that any partitioning gives alike, from 60 bits of each row's MD5,
    so that any engine can recompute it. Nulls count as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("parity"))


def shared_split(main: DataFrame, sub: DataFrame, columns: tuple[str, ...] = ("chunk_id", "sequence")) -> DataFrame:
    """(split, shared): whether the main task's rows of class 1, under their sub labels, are the sub task's rows.

    Digests of the multisets are compared, so the order in which files list them does not matter.
    """
    own = main.filter("labels = 1").select("split", *columns, F.col("sub_labels").cast("string").alias("label"))
    other = sub.select("split", *columns, F.col("labels").cast("string").alias("label"))

    def digest(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*columns, "label")
        return df.groupBy("split").agg(F.struct(F.count("*").alias("n"), F.sum((h % 1_000_000_007).cast("decimal(38,0)")).alias("sum"), F.bit_xor(h).alias("parity")).alias(name))

    both = digest(own, "a").join(digest(other, "b"), "split", "full_outer")
    return both.select("split", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("shared"))


def qc_report(chunks: DataFrame, label: str = "labels") -> DataFrame:
    """One row: overlaps by kind, label conflicts, passed."""
    obs = observations(chunks, label=label)
    counts = overlap_counts(obs).agg(F.map_from_entries(F.collect_list(F.struct("kind", "overlaps"))).alias("overlaps"))
    clashes = label_conflicts(obs).agg(F.count("*").alias("label_conflicts"))
    return counts.crossJoin(clashes).withColumn("passed", (F.size("overlaps") == 0) & (F.col("label_conflicts") == 0))


def verify_lineage(lineage: DataFrame, expected: DataFrame) -> DataFrame:
    """(artifact, problem): files that are missing, not recorded, or not what was recorded. Both: (artifact, sha256)."""
    both = lineage.withColumnRenamed("sha256", "now").join(expected.withColumnRenamed("sha256", "then"), "artifact", "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "not recorded").when(F.col("now") != F.col("then"), "changed")
    return both.select("artifact", problem.alias("problem")).filter("problem IS NOT NULL")
