"""Calibration and training histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

TEMPERATURES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)


def genome_logits(frame: DataFrame, classes: int, logits: str = "logits", length: str = "valid_length", key: str = "genome_id", truth: str = "truth", order: str = "chunk_id") -> DataFrame:
    """Length-weighted mean logits per genome; the label of its last row."""
    means = [(F.sum(F.get(logits, F.lit(c)).cast("double") * F.col(length)) / F.sum(length)).alias(f"_l{c}") for c in range(classes)]
    out = frame.groupBy(key).agg(*means, F.max_by(truth, order).alias(truth))
    return out.select(key, truth, F.array(*[F.col(f"_l{c}") for c in range(classes)]).alias(logits))


def temperature_grid(genomes: DataFrame, temperatures: tuple[float, ...] = TEMPERATURES, logits: str = "logits", truth: str = "truth") -> DataFrame:
    """(temperature, nll): mean negative log-likelihood over genomes."""
    each = genomes.withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in temperatures])))
    scaled = F.transform(logits, lambda v: v / F.col("temperature"))
    top = F.array_max(scaled)
    total = top + F.ln(F.aggregate(F.transform(scaled, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b))
    return each.groupBy("temperature").agg(F.avg(total - F.get(scaled, F.col(truth))).alias("nll"))


def best_temperature(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min(F.struct("nll", "temperature")).alias("m")).select("m.temperature", "m.nll")


def mean_nll(frame: DataFrame, p: str = "p", truth: str = "truth", by: tuple[str, ...] = ()) -> DataFrame:
    return frame.groupBy(*by).agg(F.avg(-F.ln(F.greatest(F.get(p, F.col(truth)), F.lit(1e-12)))).alias("nll"))


def repair_history(history: DataFrame, checkpoint: float, run: str = "run", order: str = "pos") -> DataFrame:
    """Keep, per run, the branch of a training history that the checkpoint stands for.

    Where the epoch goes back, rows after the new epoch are dropped; the row of an epoch that is already there stays.
    Rows after the checkpoint go. Epochs compare at one decimal of their exact binary value.

    So a row goes if any later row has a smaller epoch, and of what is left the first row of each epoch stays: a running
    minimum from the end, linear in a run's rows.
    """
    at = history.withColumn("_e", N.round1(F.col("epoch").cast("double")))
    later = F.min("_e").over(Window.partitionBy(run).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1))
    left = at.withColumn("_later", later).filter(F.coalesce(F.col("_later") >= F.col("_e"), F.lit(True)) & (F.col("_e") <= F.lit(round(checkpoint, 1))))
    return left.groupBy(run, "_e").agg(F.min_by(F.struct(*history.columns), order).alias("_row")).select("_row.*")


def first_of_epoch(history: DataFrame, order: str = "pos") -> DataFrame:
    """Later rows of an epoch are skipped."""
    n = F.row_number().over(Window.partitionBy("epoch").orderBy(order))
    return history.withColumn("_n", n).filter("_n = 1").drop("_n")


def best_so_far(history: DataFrame, metric: str, order: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """Add best (highest so far) and improved (strictly above all before)."""
    before = F.max(metric).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("improved", before.isNull() | (F.col(metric) > before)).withColumn("best", F.greatest(metric, before))


def best_checkpoint(history: DataFrame, metric: str, order: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """The row with the best metric; of ties the earlier."""
    return history.groupBy(*by).agg(F.max_by(F.struct(*history.columns), F.struct(metric, -F.col(order))).alias("r")).select("r.*")


def early_stop(history: DataFrame, metric: str, patience: float, interval: float, min_delta: float = 0.0, order: str = "pos", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The check at which training stops, per run: ``patience / interval`` checks (rounded, 1 at least) in a row without
    a gain of more than min_delta over the best. (stop null: it runs to its end)."""
    checks = max(1, round(patience / interval))
    listed = history.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col(metric).cast("double").alias("v")))).alias("_l"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("waited"), F.lit(None).cast("long").alias("stop"))

    def step(now: Column, x: Column) -> Column:
        better = now["best"].isNull() | (x["v"] > now["best"] + min_delta)
        waited = F.when(better, 0).otherwise(now["waited"] + 1)
        stop = F.coalesce(now["stop"], F.when(waited >= checks, x["at"]))
        return F.struct(F.when(better, x["v"]).otherwise(now["best"]).alias("best"), waited.alias("waited"), stop.alias("stop"))

    return listed.select(*by, F.aggregate("_l", start, step)["stop"].alias("stop"))
