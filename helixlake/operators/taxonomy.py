"""Taxon vocabularies for open-set classification, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import sequence as S
from .ordered import ranks

AUTHORITATIVE = ("gv_labels", "snapshot_metadata")


def usable_rows(manifest: DataFrame, source: str, rank: str) -> DataFrame:
    value = F.trim(f"taxonomy_{rank}")
    return manifest.filter((F.col("source") == source) & (F.col("split") != "quarantine") & F.col("taxonomy_source").isin(*AUTHORITATIVE)).select("genome_id", "split", value.alias("taxon")).filter(S.usable_taxon(F.col("taxon")))


def vocabulary(rows: DataFrame, minimum: int) -> DataFrame:
    """(taxon, genomes, label_id): taxa with enough train genomes, counted before ambiguous genomes are left out;
    ids follow the names."""
    counts = rows.filter("split = 'train'").groupBy("taxon").agg(F.countDistinct("genome_id").alias("genomes")).filter(F.col("genomes") >= minimum)
    return ranks(counts, [F.col("taxon")], "_n").select("taxon", "genomes", (F.col("_n") - 1).cast("int").alias("label_id"))


def reliable_genomes(rows: DataFrame) -> DataFrame:
    """Genomes with exactly one name."""
    return rows.groupBy("genome_id").agg(F.collect_set("taxon").alias("t")).filter(F.size("t") == 1).select("genome_id", F.get("t", F.lit(0)).alias("taxon"))


def relabel(chunks: DataFrame, reliable: DataFrame, vocab: DataFrame) -> DataFrame:
    """Chunks of reliable genomes with the taxon's id, -1 where it was not seen in training."""
    named = reliable.join(vocab.select("taxon", "label_id"), "taxon", "left").select("genome_id", F.coalesce("label_id", F.lit(-1)).alias("_l"))
    return chunks.join(named, "genome_id").withColumn("labels", F.col("_l")).drop("_l")


def dataset(relabelled: DataFrame) -> DataFrame:
    """Unseen taxa stay in inference only."""
    return relabelled.filter("labels >= 0 OR split = 'inference'")


def unseen(relabelled: DataFrame) -> DataFrame:
    """The chunks of unseen taxa, of every split, for the open-set files."""
    return relabelled.filter("labels < 0")


def known_counts(relabelled: DataFrame) -> DataFrame:
    return relabelled.groupBy("split").agg(F.count_if(F.col("labels") >= 0).alias("known_chunks"), F.count_if(F.col("labels") < 0).alias("unseen_taxon_chunks"))


def open_set_report(predictions: DataFrame, threshold: float = 0.8, p: str = "p", truth: str = "truth", by: tuple[str, ...] = ()) -> DataFrame:
    accept, known = N.accepted(F.col(p), threshold), F.col(truth) >= 0
    right = (N.argmax(F.col(p)) == F.col(truth)) & accept
    share = lambda c: F.avg(c.cast("double"))
    return predictions.groupBy(*by).agg(
        F.count_if(known).alias("known_n"), F.count_if(~known).alias("unseen_n"), share(accept).alias("prediction_coverage"),
        share(F.when(~known, ~accept)).alias("unknown_rejection_rate"), share(F.when(known, right)).alias("known_unconditional_accuracy"),
    )
