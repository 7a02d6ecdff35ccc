"""Preprocessing run: labelled records become a training set whose splits share no fragment.

    python -m jobs.build_dataset --records PATH --labels PATH --output FOLDER [--config FILE] [--master URL]

1. Records are read with their labels (of rows with the same id the smallest label counts; none is the class "none").
2. They are cut into fragments. Records of one class that share a fragment are linked; where a fragment occurs under
   several classes, the record that has it first and those of another class are quarantined.
3. Linked records form a group; groups are allocated whole to splits, within strata of source and class, the largest
   first, each to the split that is least filled after taking it.
4. The fragments of all kept records are written with their split and weight, and checked: a fragment or a group that
   crosses splits is an error, and then the lineage is not written.

Output, all Parquet, below the output folder:

    chunks/split=S/     record id, source, label, split_group, start, end, hash, valid_length, sample_weight, text
    quarantine/         record id, reason
    groups/             split_group, source, label, bases, contigs, genomes, split
    lineage/            name, rows, digest: of the inputs as read and of each table as written, with the settings

The lineage is written last and names what it was made from. A run whose inputs, settings and tables all agree with it
writes nothing; another run replaces the tables. Both leave the same rows, as all draws are hashes.

Defined results: records with a null or empty text have no chunks and are in no group; null ids are quarantined; rows
with the same id and text are one record, rows with the same id and another text are an error; null sources are the
source ""; empty inputs give empty tables.

At scale: the texts are shuffled once, to the split of their record, and cut after it; rows that repeat an id are brought
together before. Fragments are hashed once and only those whose hash others have meet, by the first of each hash; groups are contracted in a logarithm of rounds; allocation holds a few numbers of one group at a
time.
"""

from __future__ import annotations

import argparse
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import sequence as S
from helixlake.operators import chunks, qc, similarity, splits
from helixlake.operators.components import connected_components
from helixlake.session import BATCH, get_spark, observed, save, ship

from .common import kept, log, read_config, read_if_there, settings

DEFAULTS: dict[str, Any] = {
    "id": "doc_id", "text": "text", "source": "source", "label": "quality", "fragment_size": 500, "minimum_tail": 50,
    "train": 0.8, "validation": 0.1, "seed": 0,
}
TABLES = ("chunks", "quarantine", "groups")


def read_records(records: DataFrame, labels: DataFrame, config: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(record_id, source, text) and (record_id, source, bases, label), each record once.

    Only rows whose id repeats (or is null) are brought together; the texts of the others stay where they are.
    """
    key = config["id"]
    rows = records.select(F.col(key).alias("record_id"), F.coalesce(config["source"], F.lit("")).alias("source"), F.coalesce(config["text"], F.lit("")).alias("text")).filter("text <> ''")
    slim = save(rows.select("record_id", "source", F.length("text").alias("bases")), "record-rows")
    again = save(slim.filter("record_id IS NOT NULL").groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1").select("record_id"), "repeated-ids")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    twice = rows.join(again, "record_id", "left_semi").unionByName(rows.filter("record_id IS NULL"))
    once = twice.groupBy("record_id").agg(F.min("source").alias("source"), F.first("text").alias("text"), F.min(sha).alias("_a"), F.max(sha).alias("_z"))
    once = save(once.withColumn("text", F.when(F.col("_a").eqNullSafe(F.col("_z")) | F.col("record_id").isNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("two texts have the id "), F.col("record_id").cast("string"))))).drop("_a", "_z"), "repeated-records")
    others = lambda t: t.filter("record_id IS NOT NULL").join(again, "record_id", "left_anti")
    texts = others(rows).unionByName(once)
    if not again.isEmpty():
        texts = save(texts, "records")
    facts = others(slim).unionByName(once.select("record_id", "source", F.length("text").alias("bases")))
    known = labels.groupBy(F.col(key).alias("record_id")).agg(F.min(config["label"]).cast("string").alias("label"))
    return texts, save(facts.join(known, "record_id", "left").withColumn("label", F.coalesce("label", F.lit("none"))), "record-facts")


def cut(records: DataFrame, config: dict[str, Any], *keep: str) -> DataFrame:
    pieces = chunks.explode_chunks(records, config["fragment_size"], config["minimum_tail"], sequence="text", keep=keep)
    return pieces.withColumn("hash", F.sha2(F.col("piece").cast("binary"), 256))


def placed_groups(texts: DataFrame, records: DataFrame, config: dict[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record_id, label, split_group, split) of the kept records, (record_id, reason) of the others, and the groups."""
    named = records.filter("record_id IS NOT NULL")
    hashes = save(cut(texts.filter("record_id IS NOT NULL"), config).select("record_id", "start", F.unhex("hash").alias("hash")), "fragment-hashes")
    met = save(similarity.shared(hashes).join(named.select("record_id", "label"), "record_id"), "shared-fragments")
    edges, clash = similarity.exact_edges(met.select("record_id", F.col("record_id").alias("grp"), "label", "hash", F.struct("record_id", "start").alias("pos")))
    gone = clash.unionByName(records.filter("record_id IS NULL").select("record_id", F.lit("no_id").alias("reason")))
    gone = save(gone, "quarantine")
    left = save(named.join(gone, "record_id", "left_anti").select("record_id", "source", "label", "bases"), "kept-records")
    edges = edges.select(F.col("left_group").alias("u"), F.col("right_group").alias("v"))
    group = connected_components(edges, vertices=left.select(F.col("record_id").alias("node"))).withColumnRenamed("node", "record_id")
    grouped = save(left.join(group, "record_id"), "grouped-records")
    stats = save(splits.component_stats(grouped, genome="record_id", order="record_id"), "group-stats")
    ratios = {"train": config["train"], "validation": config["validation"], "inference": round(1 - config["train"] - config["validation"], 12)}
    groups = stats.join(splits.allocate(stats, ratios, config["seed"]), "component").withColumn("split_group", S.stable_id(F.col("component"), prefix="SIM_"))
    groups = save(groups.select("component", "split_group", F.col("main_source").alias("source"), F.col("main_label").alias("label"), "bases", "contigs", "genomes", "split"), "groups")
    placed = grouped.join(groups.select("component", "split_group", "split"), "component").select("record_id", "label", "split_group", "split")
    return save(placed, "placed-records"), gone, groups.drop("component")


#: Of a table without rows.
EMPTY = (0, "None-None")


def digest(table: DataFrame) -> tuple[int, str]:
    row = qc.fingerprint(table, *table.columns).first()
    return row["rows"], f"{row['total']}-{row['parity']}"


def current(spark: SparkSession, output: str, inputs: list[tuple]) -> bool:
    """Whether the lineage below output is of these inputs and settings, and of the tables as they are."""
    lineage = read_if_there(spark, f"{output}/lineage")
    known = {r["name"]: (r["rows"], r["digest"]) for r in lineage.collect()} if lineage else {}  # a row a table
    if any(known.get(name) != (rows, value) for name, rows, value in inputs):
        return False
    tables = {t: read_if_there(spark, f"{output}/{t}") for t in TABLES}
    return all(known.get(t) == (digest(x) if x else EMPTY) for t, x in tables.items())


def run(spark: SparkSession, records_path: str, labels_path: str, output: str, given: dict[str, Any] | None = None) -> bool:
    """Build the tables below output; False if they are up to date."""
    config = settings(DEFAULTS, given)
    if not 0 <= config["train"] + config["validation"] <= 1:
        raise ValueError("train and validation take more than everything")
    with kept(spark, BATCH[0]):
        ship(spark)
        raw, labels = spark.read.parquet(records_path).select(config["id"], config["source"], config["text"]), spark.read.parquet(labels_path).select(config["id"], config["label"])
        inputs = [("input records", *digest(raw)), ("input labels", *digest(labels)), ("settings", 0, json.dumps(config, sort_keys=True))]
        log.info("read %d rows of %s and %d of %s", inputs[0][1], records_path, inputs[1][1], labels_path)
        if current(spark, output, inputs):
            log.info("%s is up to date", output)
            return False
        texts, records = read_records(raw, labels, config)
        placed, gone, groups = placed_groups(texts, records, config)
        joined = texts.join(placed, "record_id").withColumn("_bp", F.length("text"))
        pieces = cut(joined, config, "source", "label", "split_group", "split", "_bp").withColumn("valid_length", F.col("end") - F.col("start"))
        table = pieces.select("record_id", "source", "label", "split_group", "start", "end", "hash", "valid_length", S.sample_weight(F.col("valid_length"), F.col("_bp")).alias("sample_weight"), F.col("piece").alias("text"), "split")
        counted, wrote = observed(table, "chunks", rows=F.count(F.lit(1)), chars=F.sum("valid_length"))
        counted.write.mode("overwrite").partitionBy("split").parquet(f"{output}/chunks")
        gone.write.mode("overwrite").parquet(f"{output}/quarantine")
        groups.write.mode("overwrite").parquet(f"{output}/groups")
        made = {t: spark.read.schema(x.schema).parquet(f"{output}/{t}") for t, x in zip(TABLES, (table, gone, groups), strict=True)}
        several = F.bit_count(F.bit_or(F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).otherwise(4))) > 1
        crossing = qc.observations(made["chunks"], ("hash", "split_group"), "label").groupBy("kind", "key").agg(several.alias("crosses")).filter("crosses").count()
        if crossing:
            raise RuntimeError(f"{crossing} fragments or groups are in several splits")
        lineage = [*inputs, *((t, *digest(made[t])) for t in TABLES)]
        spark.createDataFrame(lineage, "name string, rows long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{output}/lineage")
        log.info("wrote %d chunks of %d characters, %d records under quarantine and %d groups to %s", wrote.get["rows"], wrote.get["chars"] or 0, lineage[-2][1], lineage[-1][1], output)
    return True


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.build_dataset", description=__doc__.split("\n", 1)[0])
    for name in ("records", "labels", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file of settings")
    parser.add_argument("--master")
    options = parser.parse_args(argv)
    log.parent.setLevel("INFO")
    spark = get_spark("build-dataset", options.master)
    try:
        run(spark, options.records, options.labels, options.output, read_config(options.config) if options.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    import logging

    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    main()
