import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixlake.llm import token_files, toxicity

from .test_native import fill
from .test_text import near, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, edge_rows):
    """labels and benchmark with nulls, repeated rows and odd labels, for the rows of edge."""
    top = tmp_path_factory.mktemp("tables")
    labels = [(i, 1, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 0, 5), (100, 1, 0), (5, 1, 0), (5, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).write.parquet(f"{top}/labels.parquet")
    long = words(next(r[1] for r in edge_rows if r[0] == 105))
    items = [(1, " ".join(long[10:40])), (2, None), (None, ""), (3, "lonely text here"), (3, "lonely text here")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "mixing", "tokens"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, edge, edge_rows, folder):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names pass through all stages."""
    docs = edge
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == edge.columns, name
        rows = Counter(after.collect())
        before = Counter(docs.collect())
        assert set(rows) <= set(before), name  # rows come out as they went in
        assert all(n <= before[r] * (2 if name == "mixing" else 1) for r, n in rows.items()), name
        docs = spark.createDataFrame([r for r, n in rows.items() for _ in range(n)], edge.schema)
        sizes.append(docs.count())
        if name == "jaccard":
            kept = [r for r in rows.elements() if words(r.text)]
            assert len({r.doc_id for r in kept}) >= len(kept) - 1  # two null ids
            assert sum(r.doc_id == 108 for r in kept) <= 1  # of rows that repeat each other, one
        if name == "decontamination":
            assert not any(r.text == "lonely text here" for r in rows)
    assert sizes[1] > 0 and sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs.collect())
    assert sorted(r.start for r in out)[0] == 0 and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_stages_take_empty_tables(spark, empty, edge, folder, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
    for n in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    for name in ("toxicity", "decontamination"):
        assert dict(corpus_pipeline.STAGES)[name](spark, edge, str(tmp_path)).count() == edge.count()


def test_pipeline_brute_force(spark, sf):
    """The whole run against plain loops; only the scores of the toxicity model are taken as they are."""
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    docs = {r.doc_id: (r.text, r.source) for r in read("documents").collect()}
    model = toxicity.fit(read("documents"), read("labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(read("documents"), model).collect()}
    left = sorted(i for i in docs if scores[i] < 0.7)
    _, links = near([docs[i][0] for i in left])
    seen, one = set(), []
    for i in range(len(left)):
        if i not in seen:
            one.append(left[i])
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    todo += links[j]
    grams = set()
    for r in read("benchmark").collect():
        w = words(r.text)
        grams |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for i in one:
        w, hit = words(docs[i][0]), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(i)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", docs[i][0] or "")) for i in clean}
    total = Counter()
    for i in clean:
        total[docs[i][1]] += size[i]
    target = fill(total)
    place = lambda i: (hashlib.md5(f"17:{i}:{hashlib.md5((docs[i][0] or '').encode()).hexdigest()}".encode()).hexdigest()[:13], i)
    sent, copies = Counter(), []
    for i in sorted(clean, key=place):
        s = docs[i][1]
        sent[s] += size[i]
        copies += [(i, e, e * total[s] + sent[s], target[s]) for e in (0, 1)]
    words_sent, cut = 0, 0.0
    for finish, i in sorted((at / t, i) for i, _, at, t in copies if t):
        words_sent += size[i]
        if words_sent >= 1.5 * sum(total.values()):
            cut = finish
            break
    taken = sorted(i for i, _, at, t in copies if at - size[i] / 2 <= cut * t)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    want, start = Counter(), 0
    for i in taken:
        ids = np.array([*tokenizer.encode(docs[i][0] or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    got = Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and len(taken) > len(clean)
