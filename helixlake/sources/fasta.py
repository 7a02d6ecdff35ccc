"""FASTA as a Spark data source: files in ranges of bytes, gzip by suffix, filters on names and headers pushed down.

A range begins anywhere: it has the records whose header line follows a line end inside it. Plain files are split anywhere,
block-compressed gzip files (BGZF) at their blocks; other gzip files have one range.
"""

from __future__ import annotations

import gzip
import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

SCHEMA = "path string, filename string, range int, pos long, header string, sequence string"
#: Names that count as FASTA files.
SUFFIXES = (".fa", ".fna", ".fasta", ".fa.gz", ".fna.gz", ".fasta.gz")
#: How a gzip member with one extra field begins, and the field of a BGZF block: its name and length.
MEMBER, BLOCK_FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"

#: Bytes read at once, and about the bytes of a batch of rows.
BLOCK = 1 << 22


class _Range(InputPartition):
    def __init__(self, path: str, number: int, start: int, end: int | None):
        self.path, self.number, self.start, self.end = path, number, start, end


class Plain:
    """Bytes of a file from ``start`` on. limit: how many of them are the range's own (None: all)."""

    def __init__(self, file, start: int = 0, end: int | None = None):
        file.seek(start)
        self.file, self.limit = file, None if end is None else end - start

    def read(self, n: int) -> bytes:
        return self.file.read(n)


def block_size(head: bytes) -> int | None:
    """The bytes of the BGZF block that begins with head, or None if none does."""
    if head[:4] == MEMBER and head[12:16] == BLOCK_FIELD and len(head) >= 18:
        return int.from_bytes(head[16:18], "little") + 1
    return None


class Blocks:
    """Unpacked bytes of a BGZF file, from the first block at ``start`` or later on; the blocks that begin before ``end``
    are the range's own."""

    def __init__(self, file, start: int = 0, end: int | None = None):
        self.file, self.end, self.given, self.limit = file, end, 0, None
        self.at = start and self._first(start)

    def _first(self, start: int) -> int:
        """A block is no longer than 64 KiB. What looks like its head counts if another block or the end follows it."""
        self.file.seek(start)
        data = self.file.read(4 << 16)
        at = data.find(MEMBER)
        while at >= 0:
            if size := block_size(data[at : at + 18]):
                if at + size >= len(data) or block_size(data[at + size : at + size + 18]):
                    return start + at
            at = data.find(MEMBER, at + 1)
        return start + len(data)

    def read(self, n: int) -> bytes:
        out, held = [], 0
        while held < n:
            if self.limit is None and self.end is not None and self.at >= self.end:
                self.limit = self.given
            self.file.seek(self.at)
            size = block_size(head := self.file.read(18))
            if not size:
                if head:
                    raise ValueError("a block-compressed file has something else between its blocks")
                break
            plain = zlib.decompress(head + self.file.read(size - 18), 31)
            self.at, self.given, held = self.at + size, self.given + len(plain), held + len(plain)
            out.append(plain)
        return b"".join(out)


def _cut(stream, begin: bool = True) -> Iterator[bytes]:
    """What lies before the first line start with '>', and then what follows each of the range's own up to the next.

    A record is the range's own if the line end before it is; the start of a file counts as one.
    """
    parts, carry, base = [], b"\n" if begin else b"", -1 if begin else 0  # base: place of the data's first byte
    while block := stream.read(BLOCK):
        data = carry + block
        carry = b"\n" if data.endswith(b"\n") else b""
        first, *more = data[: len(data) - len(carry)].split(b"\n>")
        parts.append(first)
        place = base + len(first)  # of the line end before the next record
        for piece in more:
            yield b"".join(parts)
            if (limit := getattr(stream, "limit", None)) is not None and place >= limit:
                return
            parts = [piece]
            place += 2 + len(piece)
        base += len(data) - len(carry)
    yield b"".join(parts)


def parse(stream, headers_only: bool = False, begin: bool = True, prefix: bytes = b"") -> Iterator[tuple[int, str, str | None]]:
    """(position, header, sequence) of the records of a range whose header begins with the prefix; anything but blanks
    before the first of a file is an error."""
    records = _cut(stream, begin)
    if next(records).strip() and begin:
        raise ValueError("a FASTA file has sequence before its first header")
    for pos, entry in enumerate(records):
        header, _, body = entry.partition(b"\n")
        header = header.strip()
        if header.startswith(prefix):
            yield pos, header.decode(), None if headers_only else b"".join(map(bytes.strip, body.split(b"\n"))).decode()


class FastaReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.folder = options.get("path")
        self.columns = schema.fieldNames()
        self.headers_only = str(options.get("headersonly", "false")).lower() == "true" or "sequence" not in self.columns
        self.prefix = options.get("prefix", "")
        self.suffixes = tuple(options["suffixes"].split(",")) if options.get("suffixes") else SUFFIXES
        self.split = int(options.get("splitbytes", 0))
        self.names: list[tuple[str, tuple]] = []  # conditions on path or filename

    def pushFilters(self, filters: list[Filter]):
        """Prefixes of headers, and names: no byte of a file that is left out is read, and of other records no sequence."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("header",) and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
                self.prefix = max(self.prefix, f.value, key=len)
            elif isinstance(f, StringStartsWith) and f.attribute in (("path",), ("filename",)):
                self.names.append((f.attribute[0], ("prefix", f.value)))
            elif isinstance(f, (EqualTo, In)) and f.attribute in (("path",), ("filename",)):
                self.names.append((f.attribute[0], ("in", *(f.value if isinstance(f, In) else (f.value,)))))
            elif isinstance(f, IsNotNull) and f.attribute[0] != "sequence":
                continue  # they never are
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        of = {"path": path, "filename": path.rsplit("/", 1)[-1]}
        return all(of[name].startswith(values[0]) if kind == "prefix" else of[name] in values for name, (kind, *values) in self.names)

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith(self.suffixes)]
        out = []
        for path, size in sorted({(x.path, x.size) for x in found if self._wanted(x.path)}):
            n = math.ceil(size / self.split) if self.split and size > self.split else 1
            if n > 1 and path.endswith(".gz"):
                with store.open_input_file(path) as file:
                    n = n if block_size(file.read(18)) else 1
            out += [_Range(path, i, i * self.split if i else 0, (i + 1) * self.split if i < n - 1 else None) for i in range(n)]
        return out

    def _stream(self, store, partition: _Range):
        file = store.open_input_file(partition.path)
        if not partition.path.endswith(".gz"):
            return file, Plain(file, partition.start, partition.end)
        if block_size(file.read(18)):
            return file, Blocks(file, partition.start, partition.end)
        file.seek(0)
        return file, Plain(gzip.open(file))

    def read(self, partition: _Range):
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        name = partition.path.rsplit("/", 1)[-1]
        kinds = {"path": pa.string(), "filename": pa.string(), "range": pa.int32(), "pos": pa.int64(), "header": pa.string(), "sequence": pa.string()}
        schema = pa.schema([(c, kinds[c]) for c in self.columns])

        def batch(rows):
            pos, header, sequence = zip(*rows, strict=True) if rows else ((), (), ())
            fixed = {"path": partition.path, "filename": name, "range": partition.number}
            values = {"pos": pos, "header": header, "sequence": sequence}
            return pa.RecordBatch.from_arrays([pa.array(values[c] if c in values else [fixed[c]] * len(rows), kinds[c]) for c in self.columns], schema=schema)

        file, stream = self._stream(store, partition)
        with file:
            held, size = [], 0
            for row in parse(stream, self.headers_only, partition.number == 0, self.prefix.encode()):
                held.append(row)
                size += len(row[1]) + len(row[2] or "") + 16
                if size >= BLOCK:
                    yield batch(held)
                    held, size = [], 0
            if self.columns:
                yield batch(held)


class FastaSource(DataSource):
    """spark.read.format("fasta").option("splitBytes", ...).option("headersOnly", ...).option("prefix", ...).load(path)

    Columns are those of the given schema, or all; without ``sequence`` among them no sequence is decoded. With splitBytes
    a file is cut into ranges, and ``pos`` counts within the range; ``read_fasta`` gives places in the file.
    """

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastaReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)


def read_fasta(spark: SparkSession, path: str, sequence: bool = True, split_bytes: int = 64 << 20, **options: str) -> DataFrame:
    """(path, filename, pos, header, sequence): files in ranges of split_bytes, with the place of each record in its file.

    A first scan counts the records of each range by their headers; what lies before a range is added to the places in it.
    Filters on path, filename and the start of header reach the scan, and places count all records all the same.
    """
    register(spark)
    columns = ["path string", "filename string", "range int", "pos long", "header string", *(["sequence string"] if sequence else [])]
    source = lambda kinds: spark.read.format("fasta").schema(", ".join(kinds)).option("splitBytes", split_bytes).options(**options).load(path)
    counts = source(columns[:1] + columns[2:3]).groupBy("path", "range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.select("path", "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = source(columns).join(offsets, ["path", "range"])
    return rows.withColumn("pos", F.col("pos") + F.col("_before")).drop("range", "_before").select("path", "filename", "pos", "header", *(["sequence"] if sequence else []))


def read_fasta_native(spark: SparkSession, path: str) -> DataFrame:
    """The same records by Spark's text reader, for any store that Spark reads: one record per '\\n>' block.

    Positions follow the byte order of blocks within a file; sequences keep their case.
    """
    files = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").text(path)
    block = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    header = F.trim(F.substring_index(block, "\n", 1))
    body = F.regexp_replace(F.right(block, F.length(block) - F.length(F.substring_index(block, "\n", 1))), r"\s+", "")
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"), header.alias("header"), body.alias("sequence"))
    return named.filter(F.col("header") != "")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Header lines alone, without parsing sequences."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.filter(F.col("value").startswith(">")).select(F.col("_metadata.file_name").alias("filename"), F.trim(F.regexp_replace("value", "^>", "")).alias("header"))
