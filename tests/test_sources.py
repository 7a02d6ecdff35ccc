import gzip
import io

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixlake.operators import manifest
from helixlake.sources import fasta, tables

TEXT = ">ARC__g1|c1 first\nACGT\nacgu\n\n>ARC__g1|c2\nNNRY\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.fna").write_text(TEXT)
    with gzip.open(tmp_path / "b.fna.gz", "wt") as f:
        f.write(">BAC__g2|c9\nTTTT\nGG\n")
    (tmp_path / "notes.txt").write_text("no sequence")
    return tmp_path


def test_fasta_source(spark, folder):
    fasta.register(spark)
    rows = spark.read.format("fasta").load(f"file://{folder}").orderBy("filename", "pos").collect()
    assert [(r.filename, r.pos, r.header, r.sequence) for r in rows] == [("a.fna", 0, "ARC__g1|c1 first", "ACGTacgu"), ("a.fna", 1, "ARC__g1|c2", "NNRY"), ("b.fna.gz", 0, "BAC__g2|c9", "TTTTGG")]
    only = spark.read.format("fasta").option("headersOnly", "true").option("prefix", "BAC").load(f"file://{folder}").collect()
    assert [(r.header, r.sequence) for r in only] == [("BAC__g2|c9", None)]


def test_native_reader_agrees(spark, folder):
    (folder / "notes.txt").unlink()
    rows = fasta.read_fasta_native(spark, f"file://{folder}").collect()
    assert {(r.filename, r.header, r.sequence) for r in rows} == {("a.fna", "ARC__g1|c1 first", "ACGTacgu"), ("a.fna", "ARC__g1|c2", "NNRY"), ("b.fna.gz", "BAC__g2|c9", "TTTTGG")}
    assert {r.header for r in fasta.headers(spark, f"file://{folder}").collect()} == {"ARC__g1|c1 first", "ARC__g1|c2", "BAC__g2|c9"}


def test_sequence_before_header():
    with pytest.raises(ValueError):
        list(fasta.parse(io.BytesIO(b"ACGT\n")))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_records_do_not_depend_on_the_blocks_read(monkeypatch, block):
    monkeypatch.setattr(fasta, "BLOCK", block)
    text = b"\n\n>a one\r\nAC\r\nGT\n\n>b\n>c >d\nA>C\n T \n>" + b"e" * 20 + b"\n" + b"ACGT\n" * 9
    want = [(0, "a one", "ACGT"), (1, "b", ""), (2, "c >d", "A>CT"), (3, "e" * 20, "ACGT" * 9)]
    assert list(fasta.parse(io.BytesIO(text))) == want
    assert list(fasta.parse(io.BytesIO(text), True)) == [(i, h, None) for i, h, _ in want]
    assert list(fasta.parse(io.BytesIO(b""))) == []


def test_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("k\tv\na\t1\nb\t\n")
    rows = tables.read_tsv(spark, f"file://{tmp_path}/m.tsv", ["k", "v"])
    assert sorted(map(tuple, rows.collect())) == [("a", "1"), ("b", "")]
    assert tables.read_tsv(spark, f"file://{tmp_path}/none.tsv", ["k"], optional=True).count() == 0
    (tmp_path / "l.tsv").write_text("x\troot|p|c\nno tab\nx\troot|q\n")
    assert [tuple(r) for r in tables.read_labels(spark, f"file://{tmp_path}/l.tsv").collect()] == [("x", "root|q")]
    (tmp_path / "order.tsv").write_text("".join(f"k{i % 7}\tv{i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many splits of one file
    last = {r.id: r.lineage for r in tables.read_labels(spark, f"file://{tmp_path}/order.tsv").collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert last == {f"k{i % 7}": f"v{i}" for i in range(4000)}
    (tmp_path / "c.tsv").write_text("r\tm\nr\tn\n")
    assert sorted(map(tuple, tables.read_fields(spark, f"file://{tmp_path}/c.tsv", ["representative", "member"]).collect())) == [("r", "m"), ("r", "n")]
    with pytest.raises(PySparkException):
        tables.read_fields(spark, f"file://{tmp_path}/c.tsv", ["representative"]).collect()
    (tmp_path / "h.tsv").write_text("Ref_file\tQuery_file\tANI\tAlign_fraction_ref\tAlign_fraction_query\tx\na\tb\t99.5\t90\t80\tz\na\ta\t100\t100\t100\tz\n")
    assert [tuple(r) for r in tables.read_hits(spark, f"file://{tmp_path}/h.tsv").collect()] == [("a", "b", 99.5, 90.0, 80.0)]
    with gzip.open(tmp_path / "k.csv.gz", "wt") as f:
        f.write('sequence,labels\n"A,C",1\nGG,0\n')
    assert sorted(map(tuple, tables.read_chunks(spark, f"file://{tmp_path}/k.csv.gz", "sequence string, labels int").collect())) == [("A,C", 1), ("GG", 0)]
    for n in (1, 2):
        tables.publish_version(spark.range(n), f"file://{tmp_path}/versions")
        assert tables.read_version(spark, f"file://{tmp_path}/versions").count() == n
    assert tables.keyed(rows, "k").count() == 2
    with pytest.raises(PySparkException):
        tables.keyed(rows.unionByName(rows), "k").collect()
    tables.publish(rows, f"file://{tmp_path}/out")
    with pytest.raises(PySparkException):
        tables.publish(rows, f"file://{tmp_path}/out")
    tables.publish(rows, f"file://{tmp_path}/out", force=True)
    tables.split_outputs(rows, F.col("k") == "a", f"file://{tmp_path}/one", f"file://{tmp_path}/two")
    assert spark.read.parquet(f"file://{tmp_path}/two").count() == 1
    import hashlib

    sums = tables.file_sha256(spark, f"file://{tmp_path}/m.tsv").first()
    assert sums.sha256 == hashlib.sha256((tmp_path / "m.tsv").read_bytes()).hexdigest()


def test_manifest_end_to_end(spark, folder):
    fasta.register(spark)
    records = spark.read.format("fasta").load(f"file://{folder}").withColumn("source", F.substring("header", 1, 3))
    assert {r.source: r.empty for r in manifest.empty_records(records.unionByName(records.limit(1).withColumn("sequence", F.lit(" ")))).collect()} == {"ARC": 1, "BAC": 0}
    assert manifest.select_sources(records, ["ARC", "BAC"], ["BAC"]).count() == 1 and manifest.select_sources(records, ["ARC", "BAC"]).count() == 3
    with pytest.raises(ValueError, match="XYZ"):
        manifest.select_sources(records, ["ARC", "BAC"], ["XYZ"])
    six = "array<string>"
    meta = spark.createDataFrame([("ARC", "a.fna", ["p", "c", "o", "f", "g", "s"], "", "", 0, None, "genome"), ("BAC", "b.fna.gz", None, "", "", 0, None, "genome")], f"source string, filename string, snapshot {six}, votu string, uvig string, main_label int, sub_label int, record_type string")
    reasons = spark.createDataFrame([("BAC", "b.fna.gz", ["PHAGE:y", "EVE:x"])], "source string, filename string, host_reasons array<string>")
    none = spark.createDataFrame([], f"source string, raw_genome string, ranks {six}")
    rows = {r.source_record_id: r for r in manifest.build_manifest(records, meta, reasons, none, none).collect()}
    assert rows["ARC__g1|c1 first"].sequence_length == 8 and rows["ARC__g1|c1 first"].exclusion_reason is None and rows["ARC__g1|c1 first"].taxonomy_genus == "g"
    assert rows["ARC__g1|c2"].exclusion_reason == "n_fraction_above_0.2" and rows["ARC__g1|c2"].n_fraction == 1.0
    assert rows["BAC__g2|c9"].exclusion_reason == "cellular_genome_is_viral_host:EVE:x,PHAGE:y" and rows["BAC__g2|c9"].taxonomy_source == "missing"
    assert rows["ARC__g1|c1 first"].record_id == "REC_" + __import__("hashlib").sha256(b"ARC\x1fARC__g1|c1 first").hexdigest()[:20]
    assert rows["ARC__g1|c2"].base_group_id == "GENOME::ARC__g1"
