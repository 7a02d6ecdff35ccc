import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from helixlake.llm import token_files, warc
from helixlake.session import new_folder


@pytest.mark.parametrize("vocab", [2, 3, 256, 1000, 50257, 65537])
def test_packing_round_trip(vocab):
    rng = np.random.default_rng(0)
    bits = (vocab - 1).bit_length()
    ids = rng.integers(0, vocab, 40_003).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (token_files.unpack(packed, bits, len(ids)) == ids).all()
    counts = np.array([0, 1, 40_000, 2])
    import pyarrow as pa

    f = token_files.TokenFile(token_files.write_file(pa.array([3, None, 5, 6]), counts, ids, vocab))
    assert f.bits == bits and f.index["key"].to_pylist() == [3, None, 5, 6]
    assert (f.ids(0, len(ids)) == ids).all()
    assert (f.document(2) == ids[1:40_001]).all() and (f.document(3) == ids[-2:]).all() and len(f.document(0)) == 0
    for _ in range(50):
        a = rng.integers(0, len(ids))
        n = rng.integers(0, len(ids) - a)
        assert (f.ids(int(a), int(n)) == ids[a : a + n]).all()


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_vocabulary())
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_cuts_change_nothing(edge_rows):
    rnd = random.Random(2)
    odd = ["a  b", "a   b", " a", "a ", "a\n  b", "a \n b", "it's 'll <|endoftext|> x", "\n\n a", "a\t b", " ", "", "a b", "  ", "x\n y", "a.b, c.\nD 1.5, x,y", "é f", "  a", "日本語 テスト。", "a.\nb", "ß. ö,"]
    mixed = ["".join(rnd.choice(["a", "Bc", " ", "  ", "\n", ".", ",", "é", "1", "'s", "\t", " ", "日"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts = [*odd, *mixed, *[r[1] or "" for r in edge_rows]]
    code = token_files.Encoder(token_files.default_vocabulary())
    assert code.encode(texts) == direct(texts)
    code.KEEP = 10  # a cache that overflows all the time
    assert code.encode(texts) == direct(texts)


def test_slices_have_every_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "SLICE", 10)
    for texts in ([], [None], ["x" * 50, None, "", "abc", "é" * 4, "y" * 9, "z" * 30, None]):
        found = list(token_files.slices(pa.array(texts, pa.string())))
        assert [i for a, z in found for i in range(a, z)] == list(range(len(texts)))
        assert all(z - a == 1 or sum(len((x or "").encode()) for x in texts[a:z]) <= 10 for a, z in found)


def test_token_digest(spark, edge, edge_rows, empty):
    rows = token_files.token_digest(edge, token_files.default_vocabulary()).orderBy("start").collect()
    ids = direct([r[1] or "" for r in edge_rows])
    end = np.array([2], "<u4").tobytes()
    want = Counter((r[0], len(x) // 4 + 1, zlib.crc32(x + end)) for r, x in zip(edge_rows, ids, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in rows if r.doc_id is not None]
    assert keys == sorted(keys)
    assert token_files.token_digest(empty, token_files.default_vocabulary()).count() == 0


def test_archives(spark, tmp_path):
    long = "<p>" + "x" * 50_000 + "</p>"
    rows = [(i, f"http://a.example/{i}?é", f"<html><body>page {i % 7} of a site</body></html>") for i in range(60)]
    rows += [(60, None, None), (61, "u", ""), (None, "u", "<html>x</html>"), (62, "u", long), (62, "u", long), (63, "u", "<html>x</html>"), (64, "line\r\nbreak", "Content-Length: 3\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least in (0, 40):
        folder = new_folder(spark, "t")
        manifest = warc.write_warc(pages, folder, least=least, bytes_per_file=60_000)
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(folder, manifest).collect())
        last = {}
        for i, _, html in rows:
            body = (html or "").encode()
            if i is not None and len(body) >= least:
                last[body] = max(last.get(body, -1), i)
        want = Counter()
        for i, _, html in rows:
            body = (html or "").encode()
            first = last.get(body) if len(body) >= least else None
            revisit = first is not None and first != i
            want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
        assert got == want
    assert warc.read_warc(folder, warc.write_warc(pages.limit(0), folder)).count() == 0


def test_archives_of_other_keys_and_columns(spark):
    """String ids (odd ones too), columns whose names clash, records above the bound of a file, leftovers of lost attempts."""
    from pyspark.sql import functions as F

    rows = [("a>b\r\nc", "u", "x" * 5000), ("none", "u", "same"), (None, "u", "same"), ("é %3E", None, None), ("z", "u", "same")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").withColumns({c: F.lit("x") for c in ("id", "payload", "digest", "n", "first", "refers_to")})
    folder = new_folder(spark, "t")
    manifest = warc.write_warc(pages, folder, bytes_per_file=1000)
    from helixlake.llm.files import put

    put(folder, "part-0000000-00000-999999.warc.zst", warc.archive([warc.record("response", "ghost", "u", b"x", "2000-01-01T00:00:00Z")]))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(folder, manifest, kind="string").collect()}
    assert got == {("a>b\r\nc", 5000, "response", None), ("none", 4, "revisit", "z"), (None, 4, "revisit", "z"), ("é %3E", 0, "response", None), ("z", 4, "response", None)}


def test_archive_format():
    import io

    import zstandard

    records = [warc.record("response", i, f"http://a/{i}", f"<html>body {i} with words in common</html>".encode(), "2000-01-01T00:00:00Z") for i in range(200)]
    for some in (records, records[:3]):
        data = warc.archive(some)
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC
        assert [head["warc-record-id"] for head, _ in warc.read_archive(data)] == [f"<urn:x-record:{i}>" for i in range(len(some))]
        held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        frame = zstandard.ZstdDecompressor(dict_data=held).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=False)
        assert frame.read(1 << 20) == some[0]  # each record is a frame of its own


def test_the_cache_of_pieces_is_bounded_and_asked_once_a_piece():
    words = [f"{a}{b}rn" for a in "bcdfgh" for b in "aeiou"]
    texts = [" ".join(words), " ".join(reversed(words)) + ", 12."]
    code = token_files.Encoder(token_files.default_vocabulary())
    found, asked = code.known.find, Counter()
    code.known.find = lambda piece: asked.update([piece]) or found(piece)
    assert code.encode(texts * 3) == direct(texts * 3)
    assert set(asked.values()) == {1} and len(asked) == len(code.known)
    code = token_files.Encoder(token_files.default_vocabulary())
    code.KEEP = 10  # fewer than a text has
    assert code.encode(texts) == direct(texts) and len(code.known) <= 10
