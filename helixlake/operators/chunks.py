"""Chunks: bounded pieces of records with balanced weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.binding import bind


def explode_chunks(records: DataFrame, size: int = 5000, min_tail: int = 500, sequence: str = "sequence", keep: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, *keep, start, end, piece): ranges are closed-form, so this is one narrow step without a shuffle.

    Where every character is one byte, as in nucleotide sequences, pieces are slices of the record's bytes: one copy of the
    record, and then each piece costs its own length. Other texts are cut by one pass from start to end; only a short
    remainder and the piece before it are cut anew.
    """
    cut = records.filter(F.length(sequence) > 0).select("record_id", *keep, F.col(sequence).alias("_s"), F.length(sequence).alias("_n"))
    plain = F.octet_length("_s") == F.col("_n")
    rest = F.col("_n") % size
    short = (F.col("_n") > size) & (rest > 0) & (rest < min_tail)

    def pieces(each: Column) -> Column:
        last, middle = F.concat(F.element_at(each, -2), F.element_at(each, -1)), F.floor((size + rest) / 2).cast("int")
        halves = F.array(F.substring(last, F.lit(1), middle), F.substring(last, middle + 1, F.length(last)))
        return F.when(short, F.concat(F.slice(each, F.lit(1), F.size(each) - 2), halves)).otherwise(each)

    each = F.regexp_extract_all("_s", F.lit(f"(?s).{{1,{int(size)}}}"), F.lit(0))
    # all that is long is ready before the explode, so that no row of it copies or scans the record
    ready = cut.select("record_id", *keep, S.chunk_ranges(F.col("_n"), size, min_tail).alias("_r"), F.when(plain, F.col("_s").cast("binary")).alias("_b"), F.when(~plain, bind(each, pieces)).alias("_p"))
    rows = ready.select("record_id", *keep, "_b", "_p", F.posexplode("_r").alias("_i", "r"))
    slice_ = F.substring("_b", (F.col("r.start") + 1).cast("int"), (F.col("r.end") - F.col("r.start")).cast("int")).cast("string")
    return rows.select("record_id", *keep, "r.start", "r.end", F.coalesce(slice_, F.get("_p", F.col("_i"))).alias("piece"))


def chunk_table(records: DataFrame, manifest: DataFrame, size: int = 5000, min_tail: int = 500, n_limit: float = 0.2) -> DataFrame:
    """The chunk table of all kept records, for one write partitioned by split; the sub task is its rows with a sub label.

    records: (record_id, sequence). Sequences are compared with the manifest; a change is an error.
    """
    kept = manifest.filter("split IN ('train', 'validation', 'inference')")
    bp = F.sum("sequence_length").over(Window.partitionBy("genome_id"))
    info = kept.withColumn("genome_total_bp", bp).select("record_id", "source", "genome_id", "contig_id", "split_group", "split", "main_label", "sub_label", "genome_total_bp", F.unhex("sequence_sha256").alias("_sha"), "n_fraction")
    joined = records.join(info, "record_id")
    checked = joined.withColumn("sequence", F.when(F.unhex(S.sequence_hash(F.col("sequence"))) == F.col("_sha"), F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("sequence changed: "), "record_id")))).filter(F.col("n_fraction") <= n_limit)
    keep = ("source", "genome_id", "contig_id", "split_group", "split", "main_label", "sub_label", "genome_total_bp")
    cut = explode_chunks(checked, size, min_tail, keep=keep)
    return cut.select(
        F.col("piece").alias("sequence"), F.col("main_label").alias("labels"), F.col("sub_label").alias("sub_labels"), "record_id", "source", "genome_id", "contig_id", "split_group",
        S.stable_id(F.col("record_id"), F.col("start"), F.col("end"), prefix="CHK_").alias("chunk_id"), F.col("start").alias("chunk_start_0based"), F.col("end").alias("chunk_end_exclusive"),
        (F.col("end") - F.col("start")).alias("valid_length"), "genome_total_bp", S.sample_weight(F.col("end") - F.col("start"), F.col("genome_total_bp")).alias("sample_weight"), "split",
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks, bases and genomes per task and split, with totals (split null)."""
    tasks = chunks.withColumn("task", F.explode(F.when(F.col("sub_labels").isNotNull(), F.array(F.lit("main"), F.lit("sub"))).otherwise(F.array(F.lit("main")))))
    measures = [F.count("*").alias("chunks"), F.sum("valid_length").cast("long").alias("bases"), F.countDistinct("genome_id").alias("genomes")]
    return tasks.groupingSets([["task", "split"], ["task"]], "task", "split").agg(*measures)
