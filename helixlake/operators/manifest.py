"""Ingest: records with identity, hashes, labels, taxonomy and quarantine reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.tables import RANKS


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], value: str, alias: str) -> DataFrame:
    """The value of the first row of each key in a declared order: an aggregate, so it combines before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(alias))


def last_by(df: DataFrame, keys: list[str], order: list[Column | str], value: str, alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(alias))


def inventory_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def taxonomy_cascade(records: DataFrame, exact: DataFrame, provisional: DataFrame, key: str = "raw_genome") -> DataFrame:
    """Add taxonomy (array by rank), taxonomy_source and taxonomy_confidence: the record's own metadata (column
    ``snapshot``, null if it has none), else the exact id's labels, else the provisional ones, else missing.

    exact and provisional: (source, raw_genome, ranks).
    """
    named = lambda t, c: t.select("source", key, F.col("ranks").alias(c))
    seen = records.join(named(exact, "_e"), ["source", key], "left").join(named(provisional, "_p"), ["source", key], "left")
    blank = F.array(*[F.lit("")] * len(RANKS))
    pick = lambda a, b, c, d: F.when(F.col("snapshot").isNotNull(), a).when(F.col("_e").isNotNull(), b).when(F.col("_p").isNotNull(), c).otherwise(d)
    return seen.withColumns({
        "taxonomy": pick(F.col("snapshot"), F.col("_e"), F.col("_p"), blank),
        "taxonomy_source": pick(*map(F.lit, ("snapshot_metadata", "gv_labels", "provisional", "missing"))),
        "taxonomy_confidence": pick(*map(F.lit, ("curated", "exact_id", "majority_derived", "missing"))),
    }).drop("_e", "_p")


def host_overlaps(genomes: DataFrame, viral_hosts: DataFrame, host_species: DataFrame, phage_source: str = "PHAGE") -> DataFrame:
    """Cellular genomes that are hosts: one row per match.

    genomes: (source, filename, assembly_accession, species_name, organism_name); viral_hosts: (viral_source, host);
    host_species: (taxonomy) with ';'-separated ranks.
    """
    hosts = viral_hosts.select("viral_source", S.canonical_accession(F.col("host")).alias("match_value")).filter("match_value <> ''").groupBy("viral_source", "match_value").agg(F.count("*").alias("matching_viral_records"))
    species = host_species.select(F.explode(S.species_of(F.col("taxonomy"))).alias("match_value")).groupBy("match_value").agg(F.count("*").alias("matching_viral_records")).withColumn("viral_source", F.lit(phage_source))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    accession = F.array(S.canonical_accession(F.col("assembly_accession")), S.canonical_accession(F.when(stem.contains("__"), F.substring_index(stem, "__", -1)).otherwise(stem)))
    names = F.array(S.canonical_taxon(F.col("species_name")), S.canonical_taxon(F.col("organism_name")))

    def matched(keys: Column, side: DataFrame, kind: str) -> DataFrame:
        probe = genomes.withColumn("match_value", F.explode(F.array_distinct(F.filter(keys, lambda x: x != ""))))
        return probe.join(side, "match_value").withColumn("match_type", F.lit(kind))

    both = matched(accession, hosts, "exact_assembly_accession").unionByName(matched(names, species, "exact_host_species_name"))
    return both.select("source", "filename", "assembly_accession", "organism_name", F.col("viral_source").alias("matched_viral_source"), "match_type", "match_value", "matching_viral_records")


def overlap_reasons(matches: DataFrame) -> DataFrame:
    return matches.groupBy("source", "filename").agg(F.array_sort(F.collect_set(F.concat_ws(":", "matched_viral_source", "match_type"))).alias("host_reasons"))


def build_manifest(records: DataFrame, metadata: DataFrame, reasons: DataFrame, exact: DataFrame, provisional: DataFrame, n_limit: float = 0.2) -> DataFrame:
    """The manifest of FASTA records (source, filename, path, pos, header, sequence) with their per-source labels.

    metadata: (source, filename, snapshot, votu, uvig, main_label, sub_label, record_type). Sequences are hashed and
    measured before any join, and left out of every shuffle.
    """
    clean = records.withColumn("sequence", S.normalize_dna(F.col("sequence"))).filter(F.length("sequence") > 0)  # empty_records counts the others
    seq = F.col("sequence")
    slim = clean.select(
        "source", "filename", "path", "pos", "header", S.parse_header(F.col("source"), F.col("header"), F.col("filename")).alias("h"),
        F.length(seq).cast("long").alias("sequence_length"), S.n_fraction(seq).alias("n_fraction"), S.sequence_hash(seq).alias("sequence_sha256"), S.canonical_hash(seq).alias("canonical_sha256"),
    ).select("*", "h.*").drop("h")
    joined = slim.join(metadata, ["source", "filename"], "left").join(reasons, ["source", "filename"], "left")
    joined = joined.withColumn("raw_genome", F.coalesce(F.nullif("uvig", F.lit("")), "raw_genome"))
    taxa = taxonomy_cascade(joined, exact, provisional)
    ranks = {f"taxonomy_{r}": F.get("taxonomy", F.lit(i)) for i, r in enumerate(RANKS)}
    reason = S.exclusion_reason(F.col("host_reasons"), F.col("n_fraction"), F.col("source"), F.get("taxonomy", F.lit(0)), n_limit)
    return taxa.withColumns(ranks).select(
        S.stable_id(F.col("source"), F.col("header"), prefix="REC_").alias("record_id"), "source", F.col("source").alias("prefix"), F.col("path").alias("source_path"), "pos",
        F.col("header").alias("source_record_id"), "genome_id", "contig_id", "record_type", F.col("host").alias("host_assembly_id"), "votu", "main_label", "sub_label", *ranks,
        "taxonomy_source", "taxonomy_confidence", "sequence_length", "n_fraction", "sequence_sha256", "canonical_sha256",
        S.base_group(F.col("source"), F.col("taxonomy_genus"), F.col("host"), F.col("votu"), F.col("genome_id")).alias("base_group_id"),
        F.when(reason.isNotNull(), F.lit("quarantine")).alias("split"), reason.alias("exclusion_reason"),
    )


def repeated_ids(manifest: DataFrame) -> DataFrame:
    """Record ids that are not unique; a sound manifest has none."""
    return manifest.groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1")


def select_sources(df: DataFrame, known: list[str], wanted: list[str] | None = None, source: str = "source") -> DataFrame:
    """Rows of the wanted sources (all known ones if none are named); an unknown name is an error."""
    if unknown := sorted(set(wanted or []) - set(known)):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return df.filter(F.col(source).isin(*(wanted or known)))


def empty_records(records: DataFrame) -> DataFrame:
    """(source, empty): FASTA records that the manifest leaves out as nothing is left of their sequence."""
    nothing = F.length(F.regexp_replace(F.coalesce("sequence", F.lit("")), r"\s", "")) == 0
    return records.groupBy("source").agg(F.count_if(nothing).alias("empty"))


def source_summary(records: DataFrame, source: str = "source", genome: str = "genome_id", bases: str = "sequence_length", excluded: str = "exclusion_reason") -> DataFrame:
    return records.groupBy(source).agg(
        F.count("*").alias("records"), F.countDistinct(genome).alias("genomes"), F.sum(bases).cast("long").alias("bases"),
        F.count_if(F.col(excluded).isNotNull()).alias("quarantined"), F.count_if(F.col(bases) == 0).alias("empty"),
    )


def unchanged(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records whose sequence is not that of the manifest, or that it lacks: (record_id, problem)."""
    now = records.select("record_id", S.sequence_hash(F.col("sequence")).alias("now"))
    both = now.join(manifest.select("record_id", "sequence_sha256"), "record_id", "full_outer")
    problem = F.when(F.col("now").isNull(), "no sequence").when(F.col("sequence_sha256").isNull(), "not in manifest").when(F.col("now") != F.col("sequence_sha256"), "changed")
    return both.select("record_id", problem.alias("problem")).filter("problem is not null")

