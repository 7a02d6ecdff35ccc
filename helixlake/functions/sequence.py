"""Expressions on nucleotide sequences, identifiers, headers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that say a genus is not known.
UNKNOWN_GENUS = ("", "na", "nan", "none", "unknown", "unclassified", "(미분류)", "mirus_unclassified", "mirus", "ncldv", "g_")
#: Names that say a taxon of any rank is not known.
UNKNOWN_TAXON = ("", "na", "unknown", "unclassified", "(미분류)", "mirus", "ncldv", "c_", "o_", "f_", "g_")
#: Header prefix by source.
HEADER_PREFIX = {
    "ARC": "ARC__",
    "BAC": "BAC__",
    "EUK": "EUK__",
    "NCLDV": "NCLDV__",
    "MIRUS": "MIRUS__",
    "PHAGE": "PHAGE__",
    "EVE_NCLDV": "EVE-NCLDV__",
    "EVE_MIRUS": "EVE-MIRUS__",
}


def normalize_dna(s: Column) -> Column:
    """Upper case, U as T, other IUPAC codes as N; anything else is an error."""
    upper = F.upper(s)
    clean = F.regexp_replace(F.translate(upper, "U", "T"), "[^ACGTN]", "N")
    return F.when(upper.rlike("[^ACGTURYSWKMBDHVN]"), F.raise_error(F.lit("not an IUPAC nucleotide sequence"))).otherwise(clean)


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGTN", "TGCAN")


def sequence_hash(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def canonical_hash(s: Column) -> Column:
    """The same for both strands."""
    return F.sha2(F.least(s, reverse_complement(s)).cast("binary"), 256)


def stable_id(*parts: Column, prefix: str = "", length: int = 20) -> Column:
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined.cast("binary"), 256), 1, length))


def n_fraction(s: Column) -> Column:
    return F.try_divide(F.length(s) - F.length(F.translate(s, "N", "")), F.length(s))


def canonical_accession(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def canonical_taxon(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "_", " "), r"\s+", " ")))


def usable_genus(x: Column) -> Column:
    token = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return ~token.isin(*UNKNOWN_GENUS) & ~token.contains("unclassified")


def usable_taxon(x: Column) -> Column:
    token = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return ~token.isin(*UNKNOWN_TAXON) & ~token.contains("unclassified")


def parse_header(source: Column, header: Column, filename: Column) -> Column:
    """struct(raw_genome, genome_id, contig_id, host) of a FASTA header; a header of another source is an error."""
    token = F.get(F.split(F.trim(header), r"\s+"), F.lit(0))
    left, second = F.get(F.split(token, r"\|"), F.lit(0)), F.get(F.split(token, r"\|"), F.lit(1))
    organelle = source.isin("MITO", "PLASTID")
    expected = F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in HEADER_PREFIX.items()])
    raw = F.when(organelle, token).otherwise(F.substring(left, F.length(expected) + 1, F.length(left)))
    host = F.when(source.startswith("EVE_"), F.regexp_replace(F.regexp_replace(raw, "_eves$", ""), "[_.]", "-")).otherwise(F.lit(""))
    genome = F.concat(source, F.lit("__"), F.when(source.startswith("EVE_"), host).otherwise(raw))
    contig = F.when(organelle, genome).otherwise(F.concat(source, F.lit("__"), F.coalesce(second, left)))
    good = F.when(organelle, filename == F.concat(source, F.lit("__"), token, F.lit(".fna"))).otherwise(left.startswith(expected))
    found = F.struct(raw.alias("raw_genome"), genome.alias("genome_id"), contig.alias("contig_id"), host.alias("host"))
    return F.when(F.coalesce(good, F.lit(False)), found).otherwise(F.raise_error(F.concat(F.lit("header of another source: "), header)))


def lineage_ranks(lineage: Column) -> Column:
    """array of phylum .. species of a '|' lineage, blanks where it is shorter."""
    parts = F.split(lineage, r"\|")
    return F.array(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(1, 7)])


def species_of(taxonomy: Column) -> Column:
    """array of the species parts of a ';' taxonomy, canonical."""
    parts = F.filter(F.split(F.coalesce(taxonomy, F.lit("")), ";"), lambda x: x.startswith("s__"))
    return F.filter(F.transform(parts, lambda x: canonical_taxon(F.regexp_replace(x, "^s__", ""))), lambda x: x != "")


def genus_or_selected(genus: Column, selected: Column) -> Column:
    return F.coalesce(F.nullif(genus, F.lit("")), selected, F.lit(""))


def exclusion_reason(host_reasons: Column, fraction: Column, source: Column, phylum: Column, limit: float = 0.2) -> Column:
    """The first reason that holds, or null."""
    return (
        F.when(F.size(F.coalesce(host_reasons, F.array().cast("array<string>"))) > 0, F.concat(F.lit("cellular_genome_is_viral_host:"), F.array_join(F.array_sort(host_reasons), ",")))
        .when(fraction > limit, F.lit(f"n_fraction_above_{limit}"))
        .when((source == "PHAGE") & phylum.isin("Nucleocytoviricota", "Mirusviricota"), F.lit("ncldv_or_mirus_in_phage_source"))
    )


def base_group(source: Column, genus: Column, host: Column, votu: Column, genome: Column) -> Column:
    return (
        F.when((source == "NCLDV") & usable_genus(genus), F.concat(F.lit("NCLDV_GENUS::"), genus))
        .when(source.startswith("EVE_"), F.concat(F.lit("EVE_HOST::"), host))
        .when((source == "PHAGE") & (F.coalesce(votu, F.lit("")) != ""), F.concat(F.lit("PHAGE_VOTU::"), votu))
        .otherwise(F.concat(F.lit("GENOME::"), genome))
    )


def relative_path(path: Column, root: str) -> Column:
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.right(path, F.length(path) - len(top))).otherwise(path)


def chunk_ranges(length: Column, size: int = 5000, min_tail: int = 500) -> Column:
    """array<struct<start,end>> that tiles [0, length): steps of size; a remainder below min_tail is shared with the last
    step, split in two. Closed form, so no rows are made before the explode."""
    full, rest = F.floor(length / size).cast("long"), length % size
    short = (rest > 0) & (rest < min_tail)
    steps = F.when(length <= size, F.lit(0)).when(short, full - 1).otherwise(full).cast("long")
    begin = steps * size
    middle = begin + F.floor((size + rest) / 2).cast("long")
    piece = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    fixed = F.transform(F.sequence(F.lit(0).cast("long"), steps), lambda i: piece(i * size, (i + 1) * size))
    rest_pieces = (
        F.when((length > size) & short, F.array(piece(begin, middle), piece(middle, length)))
        .when(begin < length, F.array(piece(begin, length)))
        .otherwise(F.slice(F.array(piece(begin, length)), F.lit(1), F.lit(0)))
    )
    return F.concat(F.slice(fixed, F.lit(1), steps.cast("int")), rest_pieces)


def tie_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)


def sample_weight(length: Column, genome_bp: Column) -> Column:
    return length / F.greatest(genome_bp, F.lit(1))


def piece_kind(length: Column, start: Column, total: Column, size: int = 5000, min_tail: int = 500) -> Column:
    rest = total % size
    return (
        F.when(length == size, F.lit("full_5kb"))
        .when(total <= size, F.lit("short_contig"))
        .when((rest > 0) & (rest < min_tail), F.lit("rebalanced"))
        .otherwise(F.lit("tail"))
    )


def length_band(length: Column, low: int = 500, high: int = 5000) -> Column:
    return F.when(length < low, F.lit(f"<{low}")).when(length < high, F.lit(f"{low}-{high - 1}")).otherwise(F.lit(f">={high}"))


def fine_band(length: Column) -> Column:
    # Limits and names of the bands
    return (
        F.when(length < 500, F.lit("1–499")).when(length < 1000, F.lit("500–999")).when(length < 2000, F.lit("1,000–1,999"))
        .when(length < 3000, F.lit("2,000–2,999")).when(length < 4000, F.lit("3,000–3,999")).when(length < 5000, F.lit("4,000–4,999"))
        .otherwise(F.lit("5,000"))
    )


def random_strand(s: Column, seed: int, epoch: Column, key: Column, probability: float = 0.5) -> Column:
    """Reverse complement with the probability, fixed by seed, epoch and key."""
    draw = F.conv(F.substring(tie_hash(F.lit(seed), epoch, key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return F.when(draw < probability, reverse_complement(s)).otherwise(s)
