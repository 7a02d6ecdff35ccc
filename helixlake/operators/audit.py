"""Audits: recomputation, collisions, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys_crossing(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(key_kind, crossing): how many values of each key are in several splits."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(k).cast("string").alias("value")) for k in keys])
    obs = rows.select(split, F.explode(pairs).alias("o")).select(split, "o.*").filter("value IS NOT NULL AND value <> ''")
    return obs.groupBy("key_kind", "value").agg(F.countDistinct(split).alias("n")).groupBy("key_kind").agg(F.count_if(F.col("n") > 1).alias("crossing"))


def split_pairs(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(split_a, split_b, shared): values of the key in both, counted per value's set of splits, without a self-join."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    a = sets.select("s", F.explode("s").alias("split_a"))
    return a.select("split_a", F.explode("s").alias("split_b")).filter("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def crossing_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges whose two groups are in different splits."""
    left = groups.select(F.col("grp").alias("left_group"), F.col("split").alias("left_split"))
    right = groups.select(F.col("grp").alias("right_group"), F.col("split").alias("right_split"))
    return edges.join(left, "left_group").join(right, "right_group").filter("left_split <> right_split")


def crosstab(rows: DataFrame, row: str, column: str, values: list, genome: str) -> DataFrame:
    """Distinct genomes by row and column, 0 where there are none; the columns are given, so no pass finds them."""
    return rows.groupBy(row).pivot(column, values).agg(F.countDistinct(genome)).na.fill(0)


def crosstab_rows(rows: DataFrame, row: str, column: str, genome: str) -> DataFrame:
    """(row, column, genomes): distinct genomes for every pair of a row value and a column value found, 0 where there are none."""
    n = rows.groupBy(F.col(row).alias("_r"), F.col(column).alias("_c")).agg(F.countDistinct(genome).alias("n"))
    every = n.select(F.col("_r").alias(row)).distinct().crossJoin(n.select(F.col("_c").alias(column)).distinct())
    both = every.join(n, F.col(row).eqNullSafe(F.col("_r")) & F.col(column).eqNullSafe(F.col("_c")), "left")
    return both.select(row, column, F.coalesce("n", F.lit(0)).alias("genomes"))


def collisions(rows: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Per source: records, distinct keys, colliding keys, records under them, records that would be merged."""
    n = rows.groupBy(source, *keys).agg(F.count("*").alias("n"))
    many = F.when(F.col("n") > 1, F.col("n"))
    return n.groupBy(source).agg(F.sum("n").alias("records"), F.count("*").alias("unique_keys"), F.count(many).alias("collision_groups"), F.coalesce(F.sum(many), F.lit(0)).cast("long").alias("collision_records"), F.coalesce(F.sum(many - 1), F.lit(0)).cast("long").alias("merged_excess"))


def collision_causes(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each colliding key, how many distinct values each column has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in columns]).filter("n > 1")


def excluded_genomes(rows: DataFrame, genome: str, reason: str) -> DataFrame:
    """Genomes without any kept record, with their reasons counted."""
    per = rows.groupBy(genome, F.col(reason).alias("r")).agg(F.count("*").alias("n"))
    whole = per.groupBy(genome).agg(F.count_if(F.col("r").isNull()).alias("kept"), F.sum("n").alias("records"), F.array_sort(F.collect_list(F.struct("r", "n"))).alias("reasons"))
    return whole.filter("kept = 0").drop("kept")


def recomputed(saved: DataFrame, again: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose saved value is missing or off by more than the tolerance."""
    both = saved.select(*keys, F.col(value).alias("a")).join(again.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return both.filter(~F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.col("a").isNull() & F.col("b").isNull()))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(problem, n): keys that repeat on a side or lack a partner; no rows mean the join is one to one."""
    a, b = left.groupBy(key).agg(F.count("*").alias("a")), right.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("a").isNull(), "left lacks").when(F.col("b").isNull(), "right lacks").when((F.col("a") > 1) | (F.col("b") > 1), "repeats")
    return both.select(problem.alias("problem")).filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))
