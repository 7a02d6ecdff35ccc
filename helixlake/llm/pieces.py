"""SentencePiece encoding and decoding by a table of distinct chunks.

A model whose pieces never have a whitespace marker after another character cannot join what stands on both sides of a
run of markers, so a text is segmented chunk by chunk: a chunk is a run of markers and what follows it, up to the next.

1. Documents are dealt into packs as they lie in the table; a pack holds its distinct chunks once, and the place of each
   chunk of each document.
2. The chunk table is dealt into buckets by a hash of the chunk. Packs ask each bucket for their chunks of it; the bucket
   segments each chunk once, by the sentencepiece library, and answers pack by pack.
3. Packs put the ids of the answers back by position. The bodies of packs (keys and codes) wait in files below the shared
   folder, so only questions and answers are shuffled.

A chunk is asked for once a pack, however often it occurs, so no chunk is hot. Questions pass a bucket one after the
other; it holds its own chunks only. Packs are some megabytes. Files left by lost attempts are not read.

The library normalises each whole text before it is cut, with the model's own rules. A model whose pieces do cross
markers, or which is not of the BPE kind, gets each whole text as one chunk.

Defined results: a null text is an empty one, which has the end id only; rows with equal keys are separate documents,
null keys as well; a text without spaces is one chunk of any length; other columns are not looked at; an empty table
gives no rows. A pack is worked on by one task, a very long text with it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder, save
from .common import table, tidy, trim
from .files import create, get, put
from .packs import PACK, PIECE, expand, expand_planes, number, packed, restored_keys, squeeze, squeeze_planes, stored_keys

#: What the library writes for a space.
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Where a long text may be cut: at the first marker of a run.
EDGE = re.compile(f"(?<!{MARK}){MARK}")
CROSSING = re.compile(f"[^{MARK}]{MARK}")


class Model:
    """The library's processor, and one that takes chunks as they are (normalised, with their markers)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = sentencepiece_model_pb2.ModelProto()
        plain.ParseFromString(self.whole.serialized_model_proto())
        bpe = plain.trainer_spec.model_type == plain.trainer_spec.BPE
        self.by_chunk = bpe and not any(CROSSING.search(p.piece) for p in plain.pieces)
        rules = plain.normalizer_spec
        rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces = b"", False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=plain.SerializeToString())
        self.end = self.whole.eos_id()

    def chunks(self, text: str):
        """Lists of the chunks of a text, in order."""
        text = self.whole.normalize(text)
        if not self.by_chunk:
            yield [text] if text else []
            return
        a = 0
        while len(text) - a > PIECE and (edge := EDGE.search(text, a + PIECE)):
            yield CHUNK.findall(text, a, edge.start())
            a = edge.start()
        yield CHUNK.findall(text, a)

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.plain.encode(chunks, num_threads=1)]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


#: Text for each bucket of the chunk table, and the most buckets: a pack asks each bucket at most once.
BUCKET, BUCKETS = 2 << 20, 1 << 16
BODY = -1
PACKED = "pack long, bucket int, file string, chunks binary"
BODIES = pa.schema([("keys", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("place", pa.binary())])


def _strings(chunks: list[str]) -> bytes:
    raw = [x.encode() for x in chunks]
    return squeeze(np.frombuffer(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw), np.uint8))


def _unstrings(data) -> list[str]:
    raw = expand(data, np.uint8)
    n = int(raw[:4].view("<u4")[0])
    ends = np.cumsum(raw[4 : 4 + 4 * n].view("<u4"), dtype=np.int64)
    body = raw[4 + 4 * n :].tobytes()
    return [body[a:z].decode() for a, z in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True)]


def _packs(docs: DataFrame, path: str, folder: str, key: str, text: str, pack_bytes: int, buckets: int) -> DataFrame:
    """A row for each pack (bucket BODY and the file of its body: keys, chunks of each document by code, place of each
    code in the answers), and one for each bucket of the chunk table that it asks (chunks)."""
    schema = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("file", pa.string()), ("chunks", pa.binary())])

    def pack(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for made, (keys, found) in enumerate(packed(batches, model(path).chunks, pack_bytes)):
            chunks, codes, at = list(found.known), np.frombuffer(found.codes, np.uint32), number(made)
            often = np.argsort(-np.bincount(codes, minlength=len(chunks)), kind="stable")  # frequent chunks get small codes
            rank = np.empty(len(chunks), np.uint32)
            rank[often] = np.arange(len(chunks))
            bucket = np.array([zlib.crc32(chunks[i].encode()) % buckets for i in often.tolist()], np.int64)
            asked = np.argsort(bucket, kind="stable")
            place = np.empty(len(chunks), np.uint32)
            place[asked] = np.arange(len(chunks))
            sizes = np.frombuffer(found.sizes, np.uint64).astype(np.uint32)
            body = [stored_keys(keys), *map(squeeze_planes, (sizes, rank[codes], place))]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, BODIES) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in body], schema=BODIES))
            put(folder, name := f"pack-{at}-{attempt}.arrow", sink.getvalue())
            rows = [{"pack": at, "bucket": BODY, "file": name}]
            first = np.flatnonzero(np.diff(bucket[asked], prepend=-1))
            for a, z in zip(first.tolist(), np.append(first, len(asked))[1:].tolist(), strict=True):
                rows.append({"pack": at, "bucket": int(bucket[asked[a]]), "chunks": _strings([chunks[often[i]] for i in asked[a:z].tolist()])})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return save(docs.select(key, text).mapInArrow(tidy(pack), PACKED), "packs")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", pack_bytes: int = 2 * PACK, bucket_bytes: int = BUCKET) -> DataFrame:
    """(key, ids): the little-endian uint32 ids of each text with the end id, one row per document."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    folder = create(new_folder(docs.sparkSession, "pieces"))
    packs = _packs(docs, path, folder, key, text, pack_bytes, min(BUCKETS, total // bucket_bytes + 1))

    def segment(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The answers of a bucket of the table, which segments each of its chunks as it is first asked for."""
        known: dict[str, np.ndarray] = {}
        for batch in frames:
            answers = []
            for asked in batch["chunks"]:
                chunks = _unstrings(asked.as_buffer())
                new = [x for x in chunks if x not in known]
                known.update(zip(new, model(path).segment(new), strict=True))
                ids = [known[x] for x in chunks]
                answers.append((squeeze_planes(np.array([len(x) for x in ids], np.uint32)), squeeze_planes(np.concatenate(ids))))
            yield pa.RecordBatch.from_arrays([batch["pack"], batch["bucket"], *(pa.array(x, pa.binary()) for x in zip(*answers, strict=True))], ["asker", "bucket", "sizes", "ids"])
        trim()

    def place(packs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, documents, end_id = [], [], np.array([model(path).end], np.uint32)
        answers = answers.sort_by("bucket")
        both = [np.concatenate([expand_planes(x.as_buffer()) for x in answers[n]]) if len(answers) else np.empty(0, np.uint32) for n in ("sizes", "ids")]
        sizes, ids = both[0].astype(np.int64), both[1]
        starts = np.cumsum(sizes) - sizes
        for name in packs["file"].to_pylist():  # one
            row = pa.ipc.open_stream(get(folder, name)).read_all().to_pylist()[0]
            at = expand_planes(row["place"])[expand_planes(row["codes"])]
            ends = np.cumsum(expand_planes(row["sizes"]), dtype=np.int64)
            keys.append(restored_keys(row["keys"]))
            for a, z in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True):
                parts = [ids[_ranges(starts[mine], sizes[mine])] for i in range(a, z, PIECE) if len(mine := at[i : min(z, i + PIECE)])]
                documents.append(b"".join([*(x.tobytes() for x in parts), end_id.tobytes()]))
        trim()
        return pa.table({key: pa.chunked_array(keys).combine_chunks(), "ids": pa.array(documents, pa.binary())})

    asked = packs.filter(F.col("bucket") != BODY).select("pack", "bucket", "chunks")
    answers = asked.groupBy("bucket").applyInArrow(segment, "asker long, bucket int, sizes binary, ids binary")
    bodies = packs.filter(F.col("bucket") == BODY).select("pack", "file")
    return bodies.groupBy("pack").cogroup(answers.groupBy("asker")).applyInArrow(place, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): what the library decodes from the ids of each row; null ids give an empty text."""
    kind = coded.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [model(path).whole.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return coded.select(key, ids).mapInArrow(tidy(run), f"`{key}` {kind}, text string")


def digests(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of the rows of ``encode``, each decoded by the library."""
    kind = coded.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):
                ids = np.frombuffer(x.as_buffer(), "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model(path).whole.decode(ids).encode()).hexdigest()))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.select(key, "ids").mapInArrow(tidy(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark, sf_dir):
    return digests(encode(table(spark, sf_dir, "documents"), default_model()), default_model())
