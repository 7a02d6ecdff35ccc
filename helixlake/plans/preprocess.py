"""The preprocessing run: from FASTA records and their labels to chunks whose splits share nothing.

    python -m helixlake preprocess FASTA_FOLDER METADATA_TSV OUTPUT

Tables below the output folder, each written once by Spark and then read by the steps that follow:

    manifest        records with ids, hashes, labels and the first reason to leave them out
    similarity      edges between groups that share exact or near fragments
    exclusions      records that share a fragment with a record of another class
    components      groups joined by edges and equal records
    assignments     the split of each component
    final           the manifest with component, split and reason
    chunks/split=S  pieces of the kept records with their weights
    checks          keys that cross splits and label conflicts; any is an error
    lineage/table=T what each table was made from: digests of its inputs and settings, its rows and its own digest

A table whose lineage names the same inputs and settings, and which still is what was written, is taken as it is. So a run
that was stopped goes on where it stopped, and a changed input remakes the tables that follow from it, and no others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import sequence as S
from ..operators import chunks, manifest, qc, similarity, splits
from ..session import save, ship
from ..sources import fasta, tables

METADATA = ("source", "filename", "main_label", "sub_label", "votu", "uvig", "record_type", "lineage")
#: Of the tables below the output; those of another one are made again.
LAYOUT = 2


@dataclass
class Run:
    """Tables below a folder, remade only where what they were made from has changed."""

    spark: SparkSession
    output: str
    settings: Settings
    made: list[str] = field(default_factory=list)
    digests: dict[str, str] = field(default_factory=dict)

    def source(self, name: str, table: DataFrame) -> DataFrame:
        """An input that the run does not write."""
        self.digests[name] = self._digest(table)[1]
        return table

    def table(self, name: str, build: Callable[[], DataFrame], inputs: tuple[str, ...], uses: tuple[str, ...] = (), by: tuple[str, ...] = (), check: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """The table made by build from the named inputs and settings; what check raises leaves it without lineage."""
        settings = {k: v for k, v in asdict(self.settings).items() if k in uses}
        key = hashlib.sha256(json.dumps([LAYOUT, name, {i: self.digests[i] for i in inputs}, settings], sort_keys=True).encode()).hexdigest()
        path, known = f"{self.output}/{name}", self._known(name)
        found = self._read(path)
        if known is None or known["key"] != key or found is None or self._digest(found) != (known["rows"], known["digest"]):
            frame = build()
            writer = frame.write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).option("compression", "zstd").parquet(path)  # ids and hashes in hex
            found = self.spark.read.schema(frame.schema).parquet(path)
            if check:
                check(found)
            rows, digest = self._digest(found)
            line = self.spark.createDataFrame([(key, rows, digest, json.dumps(settings), name)], "key string, rows long, digest string, settings string, table string")
            line.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table").parquet(f"{self.output}/lineage")
            self.made.append(name)
            known = {"digest": digest}
        self.digests[name] = known["digest"]
        return found

    def _known(self, name: str):
        lineage = self._read(f"{self.output}/lineage")
        return lineage and lineage.filter(F.col("table") == name).first()

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    @staticmethod
    def _digest(table: DataFrame) -> tuple[int, str]:
        row = qc.fingerprint(table, *sorted(c for c, kind in table.dtypes if "<" not in kind), *sorted(c for c, kind in table.dtypes if "<" in kind)).first()
        return row["rows"], f"{row['total']}-{row['parity']}"


def run(spark: SparkSession, records: DataFrame, metadata: DataFrame, output: str, settings: Settings | None = None, reasons: DataFrame | None = None, exact: DataFrame | None = None, provisional: DataFrame | None = None) -> Run:
    """records: (source, filename, path, pos, header, sequence); metadata and the rest as ``build_manifest`` takes them."""
    ship(spark)
    use = settings or Settings()
    r = Run(spark, output, use)
    texts = "array<string>"
    none = spark.createDataFrame([], f"source string, raw_genome string, ranks {texts}")
    reasons = reasons if reasons is not None else spark.createDataFrame([], f"source string, filename string, host_reasons {texts}")
    r.source("records", records.select("source", "filename", "path", "pos", "header", "sequence"))
    r.source("metadata", metadata), r.source("reasons", reasons)
    exact, provisional = r.source("exact labels", none if exact is None else exact), r.source("provisional labels", none if provisional is None else provisional)

    rows = r.table("manifest", lambda: manifest.build_manifest(records, metadata, reasons, exact, provisional, use.n_fraction_limit), ("records", "metadata", "reasons", "exact labels", "provisional labels"), ("n_fraction_limit",), check=_unique)
    named = records.select(S.stable_id(F.col("source"), F.col("header"), prefix="REC_").alias("record_id"), S.normalize_dna(F.col("sequence")).alias("sequence"))
    sizes = ("chunk_size", "minimum_tail")

    def fragments() -> DataFrame:
        """(id, sequence) of the pieces of the records that are not excluded. Those that are come from a table, so that few
        of them are broadcast and no sequence is shuffled."""
        out = save(rows.filter("exclusion_reason IS NOT NULL").select("record_id"), "excluded")
        cut = chunks.explode_chunks(named.join(out, "record_id", "left_anti"), use.chunk_size, use.minimum_tail)
        return cut.select(F.concat_ws(":", "record_id", "start").alias("id"), F.col("piece").alias("sequence"))

    kinds = ("identity", "coverage", "kmers_per_fragment")
    near = r.table("near", lambda: similarity.near_clusters(fragments(), use.identity, use.coverage, keep=use.kmers_per_fragment), ("records", "manifest"), (*sizes, *kinds))

    @cache
    def links() -> tuple[DataFrame, DataFrame]:
        """Only fragments that are not alone in their class give edges or clashes, and they are found once for both."""
        told = rows.select("record_id", F.col("base_group_id").alias("grp"), splits.class_label().alias("label"), "source_path", F.col("pos").alias("place"))
        some = near.filter("copies > 1 OR links > 0").select(F.substring_index("id", ":", 1).alias("record_id"), F.substring_index("id", ":", -1).cast("long").alias("start"), F.col("class").alias("component"), "first", "copies")
        members = save(some.join(told, "record_id"), "members")
        edges, clash = similarity.exact_edges(members.filter("copies > 1").select("record_id", "grp", "label", F.struct("source_path", "place", "start").alias("pos"), "first"), "first")
        close, mixed = similarity.member_edges(members)
        return edges.unionByName(close), clash.unionByName(mixed)

    inputs = ("records", "manifest", "near")
    edges = r.table("similarity", lambda: links()[0], inputs, sizes)
    gone = r.table("exclusions", lambda: links()[1].groupBy("record_id").agg(F.min("reason").alias("reason")), inputs, sizes)
    equal = cache(lambda: splits.equal_records(rows))
    conflicts = cache(lambda: save(splits.label_conflicts(equal(), "canonical_sha256", "_class"), "conflicts"))
    components = r.table("components", lambda: splits.build_components(rows, edges, equal()), ("manifest", "similarity"))

    def assigned() -> DataFrame:
        left = rows.filter("exclusion_reason IS NULL").join(gone, "record_id", "left_anti").join(conflicts(), "canonical_sha256", "left_anti").join(components, "base_group_id")
        each = left.select(F.col("similarity_component").alias("component"), F.col("sequence_length").alias("bases"), "genome_id", "source", splits.class_label().alias("label"), F.struct("source_path", "pos").alias("pos"))
        numbered = save(each.withColumn("pos", F.xxhash64("pos")), "placed-records")  # any fixed order of first sight
        stats = save(splits.component_stats(numbered), "component-stats")
        return splits.allocate(stats, use.ratios, use.seed)

    assignments = r.table("assignments", assigned, ("manifest", "exclusions", "components"), ("train", "validation", "inference", "seed"))
    final = r.table("final", lambda: splits.final_manifest(rows, components, assignments, conflicts(), gone), ("manifest", "exclusions", "components", "assignments"))
    table = r.table("chunks", lambda: chunks.chunk_table(named, final, use.chunk_size, use.minimum_tail, use.n_fraction_limit), ("records", "final"), (*sizes, "n_fraction_limit"), ("split",))

    def checks() -> DataFrame:
        """Keys that cross splits, and chunks under several labels, by one aggregate."""
        seen = qc.observations(table.withColumn("chunk_hash", S.canonical_hash(F.col("sequence"))))
        differ = lambda c: F.min(c) < F.max(c)
        keys = seen.groupBy("kind", "key").agg(differ("split").alias("crosses"), differ("label").alias("several"))
        found = F.array(F.when(F.col("crosses"), "crosses splits"), F.when(F.col("several") & (F.col("kind") == "chunk_hash"), "several labels"))
        return keys.filter("crosses OR several").select(F.explode(F.array_compact(found)).alias("problem"), "kind", "key")

    problems = r.table("checks", checks, ("chunks",))
    if n := problems.count():
        raise RuntimeError(f"{n} keys cross splits or have several labels: see {output}/checks")
    return r


def _unique(rows: DataFrame) -> None:
    """An id that repeats is an error."""
    repeated = manifest.repeated_ids(rows)
    repeated.select(F.raise_error(F.concat(F.lit("record id repeats: "), "record_id"))).collect()


def run_folder(spark: SparkSession, folder: str, metadata: str, output: str, settings: Settings | None = None) -> Run:
    """FASTA files and a table that says for each of them what it is (METADATA; lineage is '|'-separated)."""
    told = tables.read_tsv(spark, metadata, list(METADATA))
    label = lambda c: F.nullif(F.col(c), F.lit("")).cast("int").alias(c)
    meta = told.select("source", "filename", F.when(F.col("lineage") != "", S.lineage_ranks(F.col("lineage"))).alias("snapshot"), "votu", "uvig", label("main_label"), label("sub_label"), "record_type")
    records = fasta.read_fasta(spark, folder).join(meta.select("source", "filename"), "filename")
    return run(spark, records, meta, output, settings)
