import hashlib
import math
import random
import re
from collections import Counter
from itertools import chain

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixlake.llm import pieces, ranked
from helixlake.session import ship

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


# ---- sentencepiece ----------------------------------------------------------------------------------------------


def odd_texts(n: int = 300) -> list[str]:
    rnd = random.Random(5)
    parts = [" ", "  ", "▁", "\n", "\t", "the", "Haus", "été", "日本", "🙂", "\x00", "</s>", "<0x41>", "x1,", "don't", "ﬁ", "a" * 40, "  ", "é"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", " ", "   ", "▁", "x" * 5000, " ".join(["word"] * 3000)]


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_chunks_are_segmented_as_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(pieces, "PIECE", piece)
    model = pieces.model(pieces.default_model())
    assert model.by_chunk
    for text in odd_texts():
        chunks = list(chain.from_iterable(model.chunks(text)))
        assert "".join(chunks) == model.whole.normalize(text)
        assert list(chain.from_iterable(x.tolist() for x in model.segment(chunks))) == model.whole.encode(text), repr(text)


def library(text: str | None) -> tuple:
    model = pieces.model(pieces.default_model()).whole
    ids = model.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_encoding_equals_the_library(spark, edge, edge_rows, empty):
    ship(spark)
    path = pieces.default_model()
    rows = [*((r[0], r[1]) for r in edge_rows), *enumerate(odd_texts(), 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pack", F.lit(1)).withColumn("ids", F.lit("x")).repartition(5)
    want = Counter((k, *library(t)) for k, t in rows)
    for pack_bytes in (1, 500, 8 << 20):
        assert Counter(map(tuple, pieces.digests(pieces.encode(docs, path, pack_bytes=pack_bytes, bucket_bytes=pack_bytes), path).collect())) == want
    decoded = pieces.decode(pieces.encode(docs, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in decoded) == Counter((k, pieces.model(path).whole.decode(pieces.model(path).whole.encode(t or ""))) for k, t in rows)
    assert pieces.digests(pieces.encode(empty, path), path).count() == 0


def test_op11_whole_table(spark, sf):
    want = Counter((r.doc_id, *library(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    found = pieces.op11_sentencepiece(spark, sf)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, found.collect())) == want


# ---- ranked search ----------------------------------------------------------------------------------------------


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(UPPER))


def brute_force(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counts = [(key, Counter(terms(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    total, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for key, c in counts:
            m = 10 + 90 * sum(c.values()) * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            scores += [(-s, key is not None, key, s)] if s > 0 else []
        out += [(item, rank, key, s) for rank, (_, _, key, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words, pack_bytes, first, query_bytes", [(1, 1, 1, 1 << 20), (40, 600, 1, 200), (200, 3000, 4, 1 << 20), (1 << 14, 8 << 20, 4, 1 << 20)])
def test_search_equals_brute_force(spark, edge, edge_rows, block_words, pack_bytes, first, query_bytes):
    ship(spark)
    rnd = random.Random(9)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    more = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 50)))) for i in range(300, 500)]
    rows = [*((r[0], r[1]) for r in edge_rows), *more, *more[:20]]  # some repeat each other
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pack", F.lit(1)).withColumn("score", F.lit("x")).repartition(3)
    items = [(1, "Alpha1 beta2 GÄMMA3"), (2, None), (3, ""), (None, "word w1"), (4, "nothing-matches-this qqq"), (5, more[3][1]), (5, more[4][1]), (6, "日本語"), (7, "w2 w2 W3"), (7, "w2 w2 W3")]
    index = ranked.build_index(docs, block_words=block_words, pack_bytes=pack_bytes)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0)).withColumn("w", F.lit(0))
    for k in (1, 10):
        found = ranked.search(index, asked, k=k, first=first, query_bytes=query_bytes)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows, items, k)


def test_search_of_empty_tables(spark, edge, empty):
    ship(spark)
    none = spark.createDataFrame([], "item_id string, text string")
    one = spark.createDataFrame([("a", "alpha1")], none.schema)
    for docs, items in ((empty, one), (edge, none), (empty, none)):
        assert ranked.search(ranked.build_index(docs), items).count() == 0


def test_blocks_below_the_threshold_are_not_scored():
    """One document holds all the query's rare terms; the bounds of blocks without them rule these out."""
    texts = [f"common{i % 5} filler{i}" for i in range(1000)]
    texts[700] = "alpha beta gamma delta"
    found = ranked.Codes()
    for text in texts:
        found.add(ranked._terms(text))
    made = ranked._indexed(0, pa.array(range(1000)), found, 1000, 2003, 20)
    queries = ranked._gather(pa.table({"item": pa.array([1] * 5), "term": pa.array([b"alpha", b"beta", b"gamma", b"delta", b"common1"]), "w": pa.array([7000, 7000, 7000, 7000, 1600])}))
    pack = ranked.Pack(made, queries)
    places, weight = pack.own(0)
    documents, scores, done = ranked.Forward(made, pack).best(places, weight, pack.bounds(places, weight), 1, 1)
    assert documents.tolist() == [700] and len(pack.first) > 90 and done == 1


def test_op12_equals_brute_force(spark, sf):
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()]
    found = ranked.op12_ranked_search(spark, sf)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
