"""Running sums and ranks over any number of rows, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save

#: Rows are dealt by their order into at least so many ranges.
RANGES = 8


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add for each of ``sums`` the sum of its column over all rows up to this one, within ``by``, in the order.

    Rows are dealt into ranges of (by, order), as in a global sort, so a group of any size is cut over many tasks; the
    ranges' totals are summed up first, and each range adds what lies before it. The order must tell rows apart: rows
    that are equal in it lie in one range, and among themselves in no fixed order. Null sums count as 0, null ``by`` is a
    group of its own.
    """
    by, n = list(by), ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    amounts = {f"_amount_{name}": F.coalesce(column, F.lit(0)) for name, column in sums.items()}
    keys = [F.col(c).asc_nulls_first() for c in by]
    # written, so that the numbers of the ranges are what they are, whatever is computed again
    placed = save(df.withColumns(amounts).repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(f"_amount_{name}").alias(f"_total_{name}") for name in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums])
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets, same)
    return out.select(*df.columns, *[(F.col(f"_before_{name}") + F.sum(f"_amount_{name}").over(inside)).alias(name) for name in sums])


def ranks(df: DataFrame, order: Sequence[Column], name: str = "rank", by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add the place of each row within ``by``, from 1, as row_number does over one window."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, by, ranges)
