"""Token-ID / binary output: fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary. A file is

    magic (8 bytes) | uint32 header: bits, ids per block, blocks, index bytes | uint64 block offsets (blocks + 1)
    | index (an Arrow stream: key, start, n_tokens per document) | blocks

Every block starts on a byte, so any document is read from the few blocks that hold it, and a block is unpacked by
numpy at once. Documents are written in ascending order of their key, over files in ascending order of their name.

Defined results: a null text is an empty one (the end id only); null keys come first; rows with equal keys are
separate documents, in the order of their text's hash; a very long text is encoded by one task and never cut over two
files; an empty table gives no files.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, save
from .common import prefix_sums, table, tidy
from .files import contents, create, put

MAGIC = b"HLXTOK01"
#: Ids per block; a multiple of 8, so that every width fills whole bytes.
BLOCK = 1 << 14


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, lowest bit first, in ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_file(keys: pa.Array, counts: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    bits = max(1, int(vocab - 1).bit_length())
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    index = pa.table({"key": keys, "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, index.schema) as out:
        out.write_table(index)
    head = np.array([bits, BLOCK, len(blocks), sink.tell()], "<u4").tobytes()
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes()
    return b"".join([MAGIC, head, offsets, sink.getvalue(), *blocks])


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        assert bytes(self.data[:8]) == MAGIC, "not a token file"
        self.bits, self.block, n, size = map(int, np.frombuffer(self.data, "<u4", 4, 8))
        self.offsets = np.frombuffer(self.data, "<u8", n + 1, 24).astype(np.int64)
        at = 24 + 8 * (n + 1)
        self.index = pa.ipc.open_stream(self.data[at : at + size]).read_all()
        self.body = at + size
        self.starts, self.counts = (self.index[c].to_numpy() for c in ("start", "n_tokens"))

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count of the file, unpacked from the blocks that hold them only."""
        first, last = start // self.block, -(-(start + count) // self.block)
        parts = []
        for b in range(first, last):
            a, z = self.offsets[b], self.offsets[b + 1]
            parts.append(unpack(self.data[self.body + a : self.body + z], self.bits, min(self.block, (z - a) * 8 // self.bits)))
        whole = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        return whole[start - first * self.block :][:count]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))


def byte_level() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (x for x in range(256) if x not in plain)
    return {x: 256 + i for i, x in enumerate(others)}


BYTE_LEVEL = byte_level()
SPACE = chr(BYTE_LEVEL[32])


#: Bytes of text that are cut into pieces at once: few enough for a processor's cache.
SLICE = 1 << 18
#: A stop or comma that does not follow a letter or digit; white space other than spaces and newlines.
LOOSE_STOP = re.compile(r"[.,](?<![^\W_][.,])")
OTHER_BLANK = re.compile(r"[^\S \n]")
#: Marks the cuts of a text; a text that has it is encoded whole.
CUT = "\x1f"


class Pieces(dict):
    """Ids of pieces, each found when it is first asked for; emptied when it holds ``keep``."""

    def __init__(self, find, keep: int):
        self.find, self.keep = find, keep

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        self[piece] = ids = self.find(piece)
        return ids


class Encoder:
    """Ids of texts, by the tokenizers library.

    With a byte-level pre-tokenizer no token runs across certain places: before a single space, before a stop or comma
    that follows a letter or digit, around a newline that stands alone. Texts are cut there, and each distinct piece
    is encoded once while it stays in a bounded cache. Other texts (with adjacent spaces or an added token's string),
    and all texts under other pre-tokenizers, are encoded whole.
    """

    KEEP = 700_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("truncation")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.vocab = self.tokenizer.get_vocab_size()
        self.tokenize = self.tokenizer.model.tokenize
        self.known = Pieces(self._find, self.KEEP)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        if not self.pieces or "  " in text or CUT in text or any(x in text for x in self.added):
            return [text]
        cut = text
        if not LOOSE_STOP.search(text):
            cut = cut.replace(".", CUT + ".").replace(",", CUT + ",")
        if "\n" in text and not ("\n\n" in text or " \n" in text or "\n " in text or OTHER_BLANK.search(text)):
            cut = cut.replace("\n", CUT + "\n" + CUT)
        return cut.replace(" ", CUT + " ").split(CUT)

    def _find(self, piece: str) -> bytes:
        """Letters, with or without a space before them, are one word to the pre-tokenizer and go to the model at once."""
        if (piece[1:] if piece[:1] == " " else piece).isalpha():
            plain = piece.replace(" ", SPACE) if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LEVEL)
            return array("I", [x.id for x in self.tokenize(plain)]).tobytes()
        return self._encode([piece])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        cuts = [self._cut(x) for x in texts]
        self.known.keep, known = self.KEEP, self.known.__getitem__
        whole = iter(self._encode([c[0] for c in cuts if len(c) == 1]))
        return [next(whole) if len(c) == 1 else b"".join(map(known, c)) for c in cuts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array):
    """Ranges of rows of about SLICE bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
        yield a, z
        a = z


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text", ids_per_file: int = 1 << 22) -> DataFrame:
    """Write docs as token files below folder; the manifest: file, part, n_docs, n_tokens, one row per file."""
    create(folder)
    tail = np.array([end_id], "<u4").tobytes()

    def write(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        code, part, attempt, made = encoder(path), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        keys, counts, parts, held = [], [], [], 0

        def flush():
            nonlocal made, held
            name = f"part-{part:07d}-{made:05d}-{attempt}.tok"  # in the order of keys
            ids = np.frombuffer(b"".join(parts), "<u4")
            put(folder, name, write_file(pa.chunked_array(keys).combine_chunks(), np.array(counts, np.int64), ids, max(code.vocab, end_id + 1)))
            row = pa.RecordBatch.from_pylist([{"file": name, "part": part, "n_docs": len(counts), "n_tokens": len(ids)}], schema)
            made, held = made + 1, 0
            keys.clear(), counts.clear(), parts.clear()
            return row

        schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            for a, z in slices(batch.column(1)):
                some = batch.slice(a, z - a)
                coded = code.encode([x or "" for x in some.column(1).to_pylist()])
                keys.append(some.column(0))
                for x in coded:
                    parts += (x, tail)
                    counts.append(len(x) // 4 + 1)
                    held += counts[-1]
                if held >= ids_per_file:
                    yield flush()
        if counts:
            yield flush()

    order = [F.col(key).asc_nulls_first(), F.col("_t")]
    ordered = docs.select(F.col(key), F.col(text), F.xxhash64(F.col(text)).alias("_t")).repartitionByRange(*order).sortWithinPartitions(*order)
    return save(ordered.select(key, text).mapInArrow(tidy(write), "file string, part int, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(docs_type, folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(file, key, start within the file, n_tokens, ids_crc32) of every document in the files."""

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(data.as_buffer())
                ids = f.ids(0, int(f.counts.sum())).astype("<u4")
                sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(f.starts.tolist(), f.counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums)), f.index["key"].combine_chunks(), pa.array(f.starts), pa.array(f.counts), pa.array(sums, pa.int64())], ["file", key, "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    return contents(spark, folder, manifest).mapInArrow(tidy(read), f"file string, {key} {docs_type}, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files, read them back: key, start over all files, n_tokens, ids_crc32, file."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, path, folder, end_id, key, text)
    files, last = manifest.agg(F.count("*"), F.max("part")).first()
    placed = manifest.select("file", "n_tokens", (F.col("part") / F.lit((last or 0) + 1)).alias("_u"))
    sums = prefix_sums(placed, [], "_u", [F.col("file")], F.col("n_tokens"), "_end", files)
    firsts = sums.select("file", (F.col("_end") - F.col("n_tokens")).alias("_first"))
    found = read_tokens(docs.schema[key].dataType.simpleString(), folder, manifest, key)
    return found.join(firsts, "file").select(key, (F.col("_first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "file")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark, sf_dir):
    return token_digest(table(spark, sf_dir, "documents"), default_vocabulary())
