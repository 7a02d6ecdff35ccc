"""Packs: some megabytes of documents, their texts coded by the distinct chunks that occur in them.

A pack holds each chunk once and, for each document, the places of its chunks in that list. Texts pass through Python
once, in the order they lie in the table; packs are bounded in bytes (a longer text is a pack of its own).
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text in a pack, and characters or bytes of a long text that are cut at once.
PACK = 8 << 20
PIECE = 1 << 18


class Codes:
    """The distinct chunks seen so far, and codes of texts by them."""

    def __init__(self):
        self.known: dict = {}
        self.codes = array("I")
        self.sizes = array("Q")

    def add(self, chunks: Iterable[list]) -> None:
        """One more text, given as lists of chunks."""
        known, codes, before = self.known, self.codes, len(self.codes)
        for some in chunks:
            codes.extend([known.setdefault(x, len(known)) for x in some])
        self.sizes.append(len(codes) - before)


def packed(batches: Iterable[pa.RecordBatch], cut: Callable[[str], Iterable[list]], size: int = PACK) -> Iterator[tuple[pa.Array, Codes]]:
    """(keys, codes) of packs of the rows (key, text) of a task; a null text is an empty one."""
    held, keys, found = 0, [], Codes()
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            if held and held + len(text) > size:
                yield pa.chunked_array(keys).combine_chunks(), found
                held, keys, found = 0, [], Codes()
            keys.append(batch.column(0).slice(i, 1))
            found.add(cut(text))
            held += len(text) + 1
    if keys:
        yield pa.chunked_array(keys).combine_chunks(), found


def number(made: int) -> int:
    """An id for a task's pack number ``made``, unique over all tasks of a stage. It is final once the stage is written."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + made


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expand(data, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def squeeze_planes(x: np.ndarray) -> bytes:
    """uint32 numbers byte plane by byte plane: the high bytes of small numbers are alike."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def expand_planes(data) -> np.ndarray:
    return np.ascontiguousarray(expand(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def stored_keys(keys: pa.Array) -> bytes:
    """A column of keys of any type as an Arrow stream."""
    sink = pa.BufferOutputStream()
    table = pa.table({"key": keys})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def restored_keys(data) -> pa.Array:
    return pa.ipc.open_stream(data).read_all()["key"].combine_chunks()
