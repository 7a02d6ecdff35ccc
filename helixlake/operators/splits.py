"""Group-preserving splits: components, their statistics, and the stratified greedy allocation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..session import save
from .components import connected_components
from .similarity import shared

RATIOS = {"train": 0.8, "validation": 0.1, "inference": 0.1}


def class_label(main: str = "main_label", sub: str = "sub_label") -> Column:
    return F.concat_ws("/", F.col(main).cast("string"), F.coalesce(F.col(sub).cast("string"), F.lit("")))


def equal_records(manifest: DataFrame) -> DataFrame:
    """The manifest's rows (their identity, group and class) whose canonical hash other rows share, or very nearly only those."""
    rows = manifest.select("canonical_sha256", "base_group_id", "split", "source_path", "pos", class_label().alias("_class"))
    return save(shared(rows, "canonical_sha256"), "equal-records")


def build_components(manifest: DataFrame, edges: DataFrame, equal: DataFrame | None = None) -> DataFrame:
    """(base_group_id, similarity_component): groups joined by edges and by equal records of one class.

    Equal records link to the first of their hash only, if the classes agree. Quarantined records are left out; records
    excluded later (pre-split exclusions, conflicting hashes) still count. Edges may bring groups that the manifest
    lacks; blank ends are dropped. A component is named by a hash of its smallest group. equal: ``equal_records``, if known.
    """
    kept = "split IS NULL OR split <> 'quarantine'"
    groups, rows = manifest.filter(kept).select(F.col("base_group_id").alias("node")), (equal_records(manifest) if equal is None else equal).filter(kept)
    firsts = rows.groupBy("canonical_sha256").agg(F.min_by(F.struct("base_group_id", "_class"), F.struct("source_path", "pos")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    equal = rows.join(firsts, "canonical_sha256").filter("_class = f._class AND base_group_id <> f.base_group_id")
    links = edges.select(F.trim("left_group").alias("u"), F.trim("right_group").alias("v")).filter("u <> '' AND v <> ''")
    links = links.unionByName(equal.select(F.col("base_group_id").alias("u"), F.col("f.base_group_id").alias("v")))
    loose = links.select(F.explode(F.array("u", "v")).alias("node"))  # ends of edges to themselves are vertices, too
    found = connected_components(links, vertices=groups.unionByName(loose))
    return found.select(F.col("node").alias("base_group_id"), S.stable_id(F.col("component"), prefix="SIM_").alias("similarity_component"))


def label_conflicts(rows: DataFrame, hash_col: str, label: str) -> DataFrame:
    return rows.groupBy(hash_col).agg(F.countDistinct(label).alias("labels")).filter("labels > 1")


def component_stats(rows: DataFrame, component: str = "component", bases: str = "bases", genome: str = "genome_id", source: str = "source", label: str = "label", order: str = "pos") -> DataFrame:
    """One row per component: bases, contigs, genomes, and the source and label that hold most bases (ties: first seen)."""
    total = rows.groupBy(component).agg(F.sum(bases).cast("long").alias("bases"), F.count("*").alias("contigs"), F.countDistinct(genome).alias("genomes"))
    for name in (source, label):
        part = rows.groupBy(component, name).agg(F.sum(bases).alias("_b"), F.min(order).alias("_o"))
        total = total.join(part.groupBy(component).agg(F.max_by(name, F.struct("_b", -F.col("_o"))).alias(f"main_{name}")), component)
    return total


def allocate(stats: DataFrame, ratios: dict[str, float] | None = None, seed: int = 0, group: str = "component", strata: tuple[str, ...] = ("main_source", "main_label")) -> DataFrame:
    """(group, split): within each stratum groups go, largest first, to the split that is least filled after taking them.

    The fill is bases over target plus genomes over target; ties go by a hash of seed, group and split. The fold is
    sequential by nature, so a stratum is one task; its rows come sorted from the engine and pass one after the other,
    and what is kept of them is the fill of the splits.
    """
    ratios = dict(ratios or RATIOS)
    names = list(ratios)
    kind = stats.schema[group].dataType.simpleString()
    totals = stats.groupBy(*[F.col(c).alias(f"_of_{c}") for c in strata]).agg(F.sum("bases").cast("double").alias("_bases"), F.sum("genomes").cast("double").alias("_genomes"))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    tie = lambda *parts: S.tie_hash(F.lit(seed), F.col(group), *map(F.lit, parts))
    keyed = stats.select(group, "bases", "genomes", *strata).join(totals, same).withColumns({"_order": tie("order"), "_stratum": F.to_json(F.struct(*strata), {"ignoreNullFields": "false"})})
    sorted_rows = keyed.repartition("_stratum").sortWithinPartitions("_stratum", F.desc("bases"), "_order")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stratum, goal, used = None, {}, {}
        for batch in batches:
            out = []
            for now, b, n, bases, genomes, *ties in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if now != stratum:
                    stratum, goal, used = now, {s: (max(bases * r, 1), max(genomes * r, 1)) for s, r in ratios.items()}, {s: [0, 0] for s in ratios}
                best = min(((used[s][0] + b) / goal[s][0] + (used[s][1] + n) / goal[s][1], t, s) for s, t in zip(names, ties, strict=True))[2]
                used[best][0] += b
                used[best][1] += n
                out.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [group, "split"])

    return sorted_rows.select(group, "_stratum", "bases", "genomes", "_bases", "_genomes", *[tie(s) for s in names]).mapInArrow(fold, f"`{group}` {kind}, split string")


def final_manifest(manifest: DataFrame, components: DataFrame, assignment: DataFrame, conflicts: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Fill in component, split and reason. A conflicting hash overrides a pre-split exclusion, which overrides the
    manifest's own reason."""
    clash = conflicts.select("canonical_sha256", F.lit("conflicting_labels_for_identical_sequence").alias("_c")).distinct()
    early = exclusions.groupBy("record_id").agg(F.max("reason").alias("_x"))
    placed = components.join(assignment.select(F.col("component").alias("similarity_component"), F.col("split").alias("_s")), "similarity_component", "left")  # narrow rows
    joined = manifest.join(clash, "canonical_sha256", "left").join(early, "record_id", "left").join(placed, "base_group_id", "left")
    joined = joined.withColumn("exclusion_reason", F.coalesce("_c", "_x", "exclusion_reason")).drop("_c", "_x", "split")
    return joined.withColumns({"split": F.when(F.col("exclusion_reason").isNotNull(), "quarantine").otherwise(F.col("_s")), "split_group": F.col("similarity_component")}).drop("_s")


def group_assignments(manifest: DataFrame) -> DataFrame:
    kept = manifest.filter("split <> 'quarantine'")
    return kept.groupBy("split_group", "split").agg(
        F.sum("sequence_length").cast("long").alias("bases"), F.countDistinct("genome_id").alias("genomes"), F.count("*").alias("contigs"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_set(F.col("main_label").cast("string"))), ",").alias("labels"),
    ).orderBy("split_group")
