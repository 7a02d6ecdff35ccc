"""Training statistics, class weights and weight normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dataset_stats(chunks: DataFrame, legacy_contigs: bool = False) -> DataFrame:
    """One row per label: chunks, bases, genomes, contigs (by contig id alone if legacy, else within the genome)."""
    contig = F.col("contig_id") if legacy_contigs else F.struct("genome_id", "contig_id")
    return chunks.groupBy("labels").agg(F.count("*").alias("chunks"), F.sum("valid_length").cast("long").alias("bases"), F.countDistinct("genome_id").alias("genomes"), F.countDistinct(contig).alias("contigs"))


def class_weights(counts: DataFrame, count: str = "genomes", power: float = 0.5) -> DataFrame:
    """Add weight: (largest / count) ** power, divided by the mean over classes."""
    every = Window.partitionBy()
    raw = counts.withColumn("_w", F.pow(F.max(count).over(every) / F.col(count), F.lit(power)))
    return raw.withColumn("weight", F.col("_w") / F.avg("_w").over(every)).drop("_w")


def normalised_weights(chunks: DataFrame, weights: DataFrame) -> DataFrame:
    """Add loss_weight: sample weight times class weight, scaled so that the mean over the split is 1."""
    joined = chunks.join(weights.select("labels", F.col("weight").alias("_c")), "labels")
    scale = joined.groupBy("split").agg((F.count("*") / F.sum(F.col("sample_weight") * F.col("_c"))).alias("_k"))
    return joined.join(scale, "split").withColumn("loss_weight", F.col("sample_weight") * F.col("_c") * F.col("_k")).drop("_c", "_k")


def loss_by_source(rows: DataFrame, loss: str = "loss", weight: str = "loss_weight") -> DataFrame:
    """Weighted loss and weight mass of each source, and its share of all."""
    part = rows.groupBy("source").agg(F.sum(F.col(weight) * F.col(loss)).alias("weighted_loss"), F.sum(weight).alias("weight_mass"))
    every = Window.partitionBy()
    return part.withColumns({"loss_share": F.col("weighted_loss") / F.sum("weighted_loss").over(every), "mass_share": F.col("weight_mass") / F.sum("weight_mass").over(every)})
