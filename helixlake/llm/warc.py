"""WARC: dictionary-compressed writer and reader.

An archive starts with a skippable Zstandard frame that holds a dictionary built from records of that archive (evenly
spaced ones, ``sample_bytes`` at most); then every record is a frame of its own, compressed with the dictionary, so
archives can be cut and joined at records. Of records with equal payloads of at least ``least`` bytes, that with the
largest id is a response and the others are revisits that refer to it.

Names of archives carry the task's attempt, and the manifest lists those that count: an attempt that was lost or came
second leaves files that nobody reads.

Defined results: ids are integers or strings; a null payload is an empty one; a null url leaves out the target; rows that repeat an id with the
same payload have the same record type; a null id sorts below all others; a record larger than ``bytes_per_file`` is
the last of its archive; columns other than id, url and payload are not looked at; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, save
from .common import table
from .files import contents, create, put

#: The frame magic that the WARC-Zstandard convention sets aside for dictionaries.
DICTIONARY_MAGIC = 0x184D2A5D
#: zstd needs a few samples to train on; below this, the samples themselves are the dictionary.
FEW = 16


def _id(value) -> str:
    return "<urn:x-no-record>" if value is None else f"<urn:x-record:{quote(str(value), safe='')}>"


def _value(text: str, kind: pa.DataType):
    if text == "<urn:x-no-record>":
        return None
    body = unquote(text.removeprefix("<urn:x-record:").removesuffix(">"))
    return int(body) if pa.types.is_integer(kind) else body


def record(kind: str, key, url, payload: bytes, date: str, refers_to=None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and the digest of its payload, not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int, sample_bytes: int):
    import zstandard

    total, step = sum(map(len, records)), 1
    while total // step > sample_bytes and step < len(records):
        step += 1
    samples = records[::step]
    if len(samples) >= FEW:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:  # samples without anything in common
            pass
    return zstandard.ZstdCompressionDict(b"".join(x[: size // len(samples)] for x in samples), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], size: int = 1 << 16, sample_bytes: int = 1 << 21, level: int = 3) -> bytes:
    import zstandard

    held = build_dictionary(records, size, sample_bytes)
    press = zstandard.ZstdCompressor(level=level, dict_data=held)
    raw = held.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(press.compress, records)])


def read_archive(data: bytes):
    """(headers, block) of each record."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    assert magic == DICTIONARY_MAGIC, "no dictionary frame"
    held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=held).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True), 1 << 16)
    while version := stream.readline():
        assert version == b"WARC/1.1\r\n", version
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        assert stream.read(4) == b"\r\n\r\n", "a record's end is missing"
        yield head, block


def plan_records(pages: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """(key, url, payload, refers_to): refers_to is null for responses."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    firsts = rows.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("id").alias("first"), F.count("*").alias("c"))
    firsts = save(firsts.filter("c > 1").drop("c"), "repeated-payloads")
    # written apart: a payload that very many rows share can then be split over tasks
    seen = rows.join(firsts, ["digest", "n"], "left")
    return seen.select("id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", bytes_per_file: int = 32 << 20) -> DataFrame:
    """Write archives below folder; the manifest: file, n_records, one row per archive."""
    create(folder)

    def write(batches):
        from pyspark import TaskContext

        part, attempt, made, held, size = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, [], 0
        schema = pa.schema([("file", pa.string()), ("n_records", pa.int64())])

        def flush():
            nonlocal made, size
            name = f"part-{part:07d}-{made:05d}-{attempt}.warc.zst"
            put(folder, name, archive(held))
            row = pa.RecordBatch.from_pylist([{"file": name, "n_records": len(held)}], schema)
            made, size = made + 1, 0
            held.clear()
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                k, u, body, other = (batch.column(c)[i].as_py() for c in range(4))
                held.append(record("response" if other is None else "revisit", k, u, body.encode(), date, other))
                size += len(held[-1])
                if size >= bytes_per_file:
                    yield flush()
        if held:
            yield flush()

    return save(plan_records(pages, key, url, payload, least).mapInArrow(write, "file string, n_records long"), "warc-manifest")


def read_warc(folder: str, manifest: DataFrame, key: str = "page_id", kind: str = "long") -> DataFrame:
    """One row per record of the archives: key (of type kind), payload_bytes, payload_digest, record_type, refers_to, file."""
    names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
    ids = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    schema = pa.schema(list(zip(names, [ids, pa.int64(), pa.string(), pa.string(), ids, pa.string()], strict=True)))

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for head, block in read_archive(data.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        assert length == len(payload) and digest == base64.b32encode(hashlib.sha1(payload).digest()).decode(), "a payload is damaged"
                    other = head.get("warc-refers-to")
                    rows.append((_value(head["warc-record-id"], ids), length, digest, head["warc-type"], other and _value(other, ids), name))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return contents(manifest.sparkSession, folder, manifest).mapInArrow(read, f"{key} {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, file string")


def op4_warc(spark, sf_dir):
    folder = new_folder(spark, "warc")
    return read_warc(folder, write_warc(table(spark, sf_dir, "pages"), folder)).drop("file")


#: Base 32 has 5 bits a letter, so 5 digits of the hexadecimal SHA-1 make 4 letters.
OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(digest, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h
"""
