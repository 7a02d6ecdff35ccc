"""Incremental ingest: records that have arrived since the last run become fragments that never cross splits.

    python -m jobs.ingest_fragments --input FOLDER --output FOLDER --checkpoint FOLDER [--config FILE] [--master URL]

The input is a growing folder of Parquet files of records (an id, a text, a source), or one file. A file stream takes the files that
are new since the checkpoint, in batches, and the job ends when there are no more. For each batch:

1. Of records with equal texts the one with the smallest id stays, unless an earlier batch has kept that text.
2. A record's split is drawn from the hash of its text, so a text has the same split whichever file brings it.
3. Records are cut into fragments. A fragment whose hash another split holds already is quarantined (status "leak"):
   the split that came first keeps it, by batch, then by record id and start. So kept fragments never cross splits.

Output, all Parquet, below the output folder:

    records/batch=N/     kept records: id, source, text_sha256, split, n_chars
    fragments/batch=N/split=S/     record id, source, start, end, hash, text, status (kept or leak)
    log/batch=N/         what the batch read and wrote

A batch that is repeated after a failure looks at earlier batches only and replaces its own partitions, so it gives the
same rows again. A run without new files changes nothing. The output and the checkpoint belong together: a new
checkpoint needs a new output folder. A file is read once; a change of it later is not seen.

Defined results: a null or empty text has no fragments and is no record; a null id comes before others; rows that
repeat each other are one record; columns that are not named are not read; an empty input gives no rows.

At scale: a batch shuffles its own texts once (with equal ones combined before), and of the tables kept only the hash
and split columns are read. Hashes that very many fragments share are reduced before they meet, and the join with them
is one of two plain exchanges, which the engine splits where a hash is frequent.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators import chunks
from helixlake.session import get_spark, observed, save, shared_root

from .common import drawn_split, log, read_config, settings, write_partitions

DEFAULTS: dict[str, Any] = {
    "id": "doc_id", "text": "text", "source": "source", "fragment_size": 500, "minimum_tail": 50,
    "train": 0.8, "validation": 0.1, "files_per_batch": 1000,
}
RECORDS = ["record_id", "source", "text_sha256", "split", "n_chars"]


def new_records(batch: DataFrame, earlier: DataFrame | None, config: dict[str, Any]) -> DataFrame:
    """(record_id, source, text, text_sha256, split, n_chars): texts that no earlier batch has, each once."""
    text = F.coalesce(F.col(config["text"]), F.lit(""))
    rows = batch.select(F.col(config["id"]).alias("record_id"), F.col(config["source"]).alias("source"), text.alias("text")).filter("text <> ''")
    hashed = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    # equal hashes are equal texts, so any of them will do
    once = hashed.groupBy("text_sha256").agg(F.min(F.struct("record_id", "source")).alias("r"), F.first("text").alias("text"))
    if earlier is not None:
        once = once.join(earlier.select("text_sha256"), "text_sha256", "left_anti")
    split = drawn_split(F.col("text_sha256"), config["train"], config["validation"])
    return once.select("r.record_id", "r.source", "text", "text_sha256", split.alias("split"), F.length("text").cast("long").alias("n_chars"))


def placed_fragments(records: DataFrame, earlier: DataFrame | None, config: dict[str, Any]) -> DataFrame:
    """(record_id, source, start, end, hash, text, split, status) of the records' fragments."""
    cut = chunks.explode_chunks(records, config["fragment_size"], config["minimum_tail"], sequence="text", keep=("source", "split"))
    cut = cut.withColumn("hash", F.sha2(F.col("piece").cast("binary"), 256))
    owner = cut.groupBy("hash").agg(F.min_by("split", F.struct("record_id", "start")).alias("owner"))
    if earlier is not None:
        before = earlier.filter("status = 'kept'").select("hash", F.col("split").alias("_before")).distinct()
        owner = owner.join(before, "hash", "left").select("hash", F.coalesce("_before", "owner").alias("owner"))
    status = F.when(F.col("split") == F.col("owner"), "kept").otherwise("leak")
    return cut.join(save(owner, "fragment-owners"), "hash").select("record_id", "source", "start", "end", "hash", F.col("piece").alias("text"), "split", status.alias("status"))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, given: dict[str, Any] | None = None) -> int:
    """Take what is new below source; the number of batches that this took."""
    config = settings(DEFAULTS, given)
    shared_root(spark)
    names = [config[c] for c in ("id", "source", "text")]
    schema = spark.read.parquet(source).select(*names).schema
    kinds = {"records": "text_sha256 string, batch int", "fragments": "hash string, status string, batch int, split string"}
    done: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = {n: session.read.schema(k).parquet(f"{output}/{n}").filter(F.col("batch") < number) if number else None for n, k in kinds.items()}
        seen, read = observed(batch, f"read-{number}", rows=F.count(F.lit(1)))
        records = save(new_records(seen, earlier["records"], config), "new-records")
        listed, wrote = observed(records, f"records-{number}", records=F.count(F.lit(1)), chars=F.sum("n_chars"))
        write_partitions(listed.select(*RECORDS, F.lit(number).alias("batch")), f"{output}/records", "batch")
        leak = F.count_if(F.col("status") == "leak")
        placed, cut = observed(placed_fragments(records, earlier["fragments"], config), f"fragments-{number}", fragments=F.count(F.lit(1)), leaks=leak)
        write_partitions(placed.withColumn("batch", F.lit(number)), f"{output}/fragments", "batch", "split")
        row = {"batch": number, **read.get, **wrote.get, **cut.get}
        row["chars"] = row["chars"] or 0
        write_partitions(session.createDataFrame([row], "batch int, rows long, records long, chars long, fragments long, leaks long"), f"{output}/log", "batch")
        log.info("batch %d of %s: read %d rows; wrote %d records of %d characters, %d fragments, %d of them leaks, to %s", number, source, *(row[c] for c in ("rows", "records", "chars", "fragments", "leaks")), output)
        done.append(number)

    path = source.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # meets the path alone; file streams take a single file by a pattern only
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not done:
        log.info("nothing new below %s", source)
    return len(done)


def fragments(spark: SparkSession, output: str, key: str = "long", source: str = "string") -> DataFrame:
    """The fragments written so far; the types are those of the ids and sources."""
    kind = f"record_id {key}, source {source}, start long, end long, hash string, text string, status string, batch int, split string"
    return spark.read.schema(kind).parquet(f"{output}/fragments")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.ingest_fragments", description=__doc__.split("\n", 1)[0])
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file of settings")
    parser.add_argument("--master")
    options = parser.parse_args(argv)
    log.parent.setLevel("INFO")
    spark = get_spark("ingest-fragments", options.master)
    try:
        run(spark, options.input, options.output, options.checkpoint, read_config(options.config) if options.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    import logging

    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    main()
