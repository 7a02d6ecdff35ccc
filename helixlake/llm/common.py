"""Pieces shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Characters that separate words in the size of a document.
BLANK = r"[\x20\x09-\x0D]+"
NON_BLANK = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share small executors."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function of mapInArrow that gives memory back when its partition is done."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) fixed by the parts: the first 52 bits of their MD5.

    MD5 rather than a Spark-only hash, so that any SQL engine can recompute it.
    """
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _offsets(totals: DataFrame, keys: list[str], buckets: int, fan: int) -> DataFrame:
    """Add ``_o``: the sum of ``_t`` in all smaller ``_b`` of the same keys; level by level, ``fan`` buckets a task."""
    if buckets <= fan:
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    cut = totals.withColumn("_p", F.floor(F.col("_b") / fan).cast("long"))
    upper = cut.groupBy(*keys, F.col("_p").alias("_b")).agg(F.sum("_t").alias("_t"))
    upper = _offsets(upper, keys, math.ceil(buckets / fan), fan).select(*keys, F.col("_b").alias("_p"), F.col("_o").alias("_above"))
    before = Window.partitionBy(*keys, "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    return inside.join(upper, [*keys, "_p"]).withColumn("_o", F.col("_o") + F.col("_above")).drop("_p", "_above")


def prefix_sums(df: DataFrame, keys: Sequence[str], u: str, ties: Sequence[Column], amount: Column, out: str, rows: int, per_bucket: int = 512, fan: int = 4096, counted: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the running sum of ``amount`` within ``keys`` (none: over all rows), in the order of ``u`` in [0, 1)
    and then ``ties``.

    No group of ``keys`` meets in one task: rows fall into order-preserving buckets of ``u`` (about ``per_bucket`` rows each,
    however large the group), buckets into ranges of ``fan`` buckets, those into larger ones, until one range is left;
    each level adds what lies before it. Rows of equal ``u`` share a bucket: here those that repeat both key and text.
    ``counted`` has the same rows in fewer columns, for the buckets' totals.
    """
    keys, buckets = list(keys), max(1, math.ceil(rows / per_bucket))

    def cut_up(x: DataFrame) -> DataFrame:
        return x.withColumn("_b", F.least(F.floor(F.col(u) * buckets), F.lit(buckets - 1)).cast("long")).withColumn("_a", amount)

    cut = cut_up(df)
    totals = cut_up(df if counted is None else counted).groupBy(*keys, "_b").agg(F.sum("_a").alias("_t"))
    offsets = _offsets(totals, keys, buckets, fan).select(*keys, "_b", "_o")
    inside = Window.partitionBy(*keys, "_b").orderBy(u, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, [*keys, "_b"]).withColumn(out, F.col("_o") + F.sum("_a").over(inside)).drop("_b", "_a", "_o")
