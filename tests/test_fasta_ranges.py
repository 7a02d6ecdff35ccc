"""FASTA in ranges: the same records and places whatever the ranges, and filters that reach the scan."""

import contextlib
import gzip
import io
import random
import zlib

import pytest

from helixlake.sources import fasta

TEXT = b"\n\n>a one\r\nAC\r\nGT\n\n>b\n>c >d\nA>CT\n T \n>" + b"e" * 20 + b"\n" + b"ACGT\n" * 9 + b">\n>last\nAC"


def bgzf(data: bytes, size: int) -> bytes:
    """Blocks of about ``size`` bytes, and the empty one at the end."""
    out = []
    for i in [*range(0, len(data), size), None]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = b"" if i is None else data[i : i + size]
        body = packer.compress(part) + packer.flush()
        out.append(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
    return b"".join(out)


def big(n: int, seed: int = 1) -> bytes:
    rnd = random.Random(seed)
    return b"".join(b">ARC__g%d|c%d x\n%s\n" % (i % 7, i, b"\n".join(bytes(rnd.choices(b"ACGT", k=rnd.randint(0, 60))) for _ in range(rnd.randint(0, 4)))) for i in range(n))


def in_ranges(data: bytes, split: int, kind) -> list:
    out = []
    n = max(1, -(-len(data) // split))
    for i in range(n):
        stream = kind(io.BytesIO(data), i * split, (i + 1) * split if i < n - 1 else None)
        out.append([(h, s) for _, h, s in fasta.parse(stream, begin=i == 0)])
    return out


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_every_cut_gives_the_same_records(monkeypatch, block):
    monkeypatch.setattr(fasta, "BLOCK", block)
    for data in (TEXT, big(40), b"", b">x", b"\n"):
        want = [(h, s) for _, h, s in fasta.parse(io.BytesIO(data))]
        for split in (1, 2, 3, 5, 17, 100, 1000):
            assert [r for part in in_ranges(data, split, fasta.Plain) for r in part] == want, split


@pytest.mark.parametrize("size", [1, 7, 50, 4000])
def test_block_compressed_files_are_cut_at_their_blocks(size):
    for data in (TEXT, big(60)):
        want = [(h, s) for _, h, s in fasta.parse(io.BytesIO(data))]
        packed = bgzf(data, size)
        assert gzip.decompress(packed) == data
        for split in (30, 100, 777, 10**6):
            parts = in_ranges(packed, split, fasta.Blocks)
            assert [r for part in parts for r in part] == want
        if size == 50 and data != TEXT:
            assert sum(bool(p) for p in in_ranges(packed, 777, fasta.Blocks)) > 3


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("fasta")
    (top / "one.fna").write_bytes(big(3000))
    (top / "two.fna.gz").write_bytes(bgzf(big(2000, 2), 3000))
    (top / "three.fna.gz").write_bytes(gzip.compress(big(500, 3)))
    (top / "empty.fna").write_bytes(b"")
    return top


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def test_one_file_in_many_tasks_has_the_same_places(spark, folder):
    whole = fasta.read_fasta(spark, f"file://{folder}", split_bytes=1 << 30)
    cut = fasta.read_fasta(spark, f"file://{folder}", split_bytes=4000)
    key = lambda r: (r.path, r.pos)
    rows = sorted(cut.collect(), key=key)
    assert rows == sorted(whole.collect(), key=key) and len(rows) == 5500
    for name, n in (("one.fna", 3000), ("two.fna.gz", 2000), ("three.fna.gz", 500)):
        assert [r.pos for r in rows if r.filename == name] == list(range(n))
    source = spark.read.format("fasta").option("splitBytes", 4000).load(f"file://{folder}")
    parts = {r["filename"]: r["max(range)"] + 1 for r in source.groupBy("filename").agg({"range": "max"}).collect()}
    assert parts["one.fna"] > 20 and parts["two.fna.gz"] > 5 and parts["three.fna.gz"] == 1
    assert source.rdd.getNumPartitions() > 25


def test_filters_reach_the_scan(spark, folder):
    cut = fasta.read_fasta(spark, f"file://{folder}", split_bytes=4000)
    some = cut.filter("header LIKE 'ARC__g3%' AND startswith(header, 'ARC__g3') AND filename = 'one.fna'")
    rows = {(r.header, r.pos) for r in some.collect()}
    assert rows == {(f"ARC__g3|c{i} x", i) for i in range(3, 3000, 7)}
    only = spark.read.format("fasta").load(f"file://{folder}")
    narrow = only.filter("startswith(header, 'ARC__g3') AND filename IN ('one.fna', 'none.fna')")
    pushed = next(line for line in plan(narrow).splitlines() if line.startswith("PushedFilters"))
    assert "StringStartsWith(header,ARC__g3)" in pushed and "In(filename" in pushed
    assert "Filter (" not in plan(narrow)  # nothing of it is left to Spark
    assert narrow.count() == len(rows) and narrow.rdd.getNumPartitions() == 1


def test_left_out_files_and_sequences_are_not_read(folder):
    """What the scan does with the filters, seen from its reader."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(fasta.SCHEMA)
    reader = fasta.FastaReader({"path": f"file://{folder}", "splitbytes": "4000"}, schema)
    left = GreaterThan(("pos",), 3)
    assert list(reader.pushFilters([StringStartsWith(("header",), "ARC__g5"), EqualTo(("filename",), "two.fna.gz"), left])) == [left]
    parts = reader.partitions()
    assert {p.path.rsplit("/", 1)[-1] for p in parts} == {"two.fna.gz"} and len(parts) > 5
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert {r["header"] for r in rows} == {f"ARC__g5|c{i} x" for i in range(5, 2000, 7)}
    names = fasta.FastaReader({"path": f"file://{folder}"}, StructType.fromDDL("header string"))
    assert names.headers_only and [b.schema.names for b in names.read(names.partitions()[1])] == [["header"]]


def test_content_before_the_first_header_is_an_error_in_any_range(spark, tmp_path):
    (tmp_path / "bad.fna").write_bytes(b"ACGT\n" * 100 + big(50))
    for split in (100, 1 << 30):
        with pytest.raises(Exception, match="before its first header"):
            fasta.read_fasta(spark, f"file://{tmp_path}", split_bytes=split).count()
