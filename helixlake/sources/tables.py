"""Tables with declared schemas, and sinks that publish once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import save

RANKS = ("phylum", "class", "order", "family", "genus", "species")


def read_tsv(spark: SparkSession, path: str, columns: list[str], optional: bool = False) -> DataFrame:
    """Strings, blank as "". A missing optional table is empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", enforceSchema=False).na.fill("")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (id, lineage) lines; lines without a tab are skipped and the last line of an id wins (of several files,
    that of the last by name)."""
    # splits of a file are read in its order, and rows of a split in theirs
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(place.alias("pos"), F.col("value").alias("line"))
    cut = lines.filter(F.col("line").contains("\t")).select("pos", F.split("line", "\t", 2).alias("x"))
    return cut.groupBy(F.trim(F.col("x")[0]).alias("id")).agg(F.max_by(F.trim(F.col("x")[1]), "pos").alias("lineage"))


def read_fields(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headerless table of tab-separated fields, such as a clustering result; a line with other than so many is an error."""
    fields = F.split("value", "\t", -1)
    wrong = F.raise_error(F.concat(F.lit(f"a line has other than {len(columns)} fields: "), F.col("value")))
    checked = F.when(F.size(fields) == len(columns), fields).otherwise(wrong)
    return spark.read.text(path).select(checked.alias("x")).select(*[F.col("x")[i].alias(c) for i, c in enumerate(columns)])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """An aligner's table with header: (left, right, ani, af_left, af_right), self hits left out."""
    names = {"Ref_file": "left", "Query_file": "right", "ANI": "ani", "Align_fraction_ref": "af_left", "Align_fraction_query": "af_right"}
    rows = spark.read.csv(path, sep="\t", header=True)
    kinds = [F.col(c).cast("string" if n in ("left", "right") else "double").alias(n) for c, n in names.items()]
    return rows.select(*kinds).filter("left <> right")


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A chunk table as CSV with header, gzip by suffix; columns are checked by name."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, escape='"', multiLine=False)


def keyed(table: DataFrame, key: str) -> DataFrame:
    """Rows with a key; a key that repeats is an error."""
    rows = table.filter(F.trim(F.col(key)) != "")
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")  # a sound table has none, so no row is moved for it
    checked = F.when(F.col("_n").isNotNull(), F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key)))).otherwise(F.col(key))
    return rows.join(again, key, "left").select(*[checked.alias(c) if c == key else F.col(c) for c in table.columns])


def publish(df: DataFrame, path: str, *partition_by: str, force: bool = False) -> None:
    """Write once: an existing output is an error unless forced. Spark's commit protocol makes it appear at once."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def publish_version(df: DataFrame, folder: str) -> str:
    """Write a new version below folder, then make it the current one: readers see the old table or the new one."""
    spark = df.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), conf)
    stream = path(folder).getFileSystem(conf).create(path(f"{folder}/_{name}"))
    stream.write(bytearray(name.encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(path(f"{folder}/_{name}"), path(f"{folder}/_CURRENT"), options)
    return name


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a published table."""
    stream = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_CURRENT"))
    name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return spark.read.parquet(f"{folder}/{name}")


def split_outputs(df: DataFrame, condition, path: str, other: str) -> None:
    """Side output: rows that meet the condition to one table, the others (null among them) to a second; df is computed once."""
    once = save(df.withColumn("_main", F.coalesce(condition, F.lit(False))), "both-outputs")
    publish(once.filter("_main").drop("_main"), path)
    publish(once.filter("NOT _main").drop("_main"), other)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def reports(df: DataFrame, *keys: str) -> DataFrame:
    """A document per row, as JSON, at the edge."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("report"))
