import random

import numpy as np

from helixlake.llm import repeats, suffix_array


def test_suffix_array():
    rnd = random.Random(0)
    for n in (1, 2, 7, 60, 300):
        codes = np.array([rnd.randint(0, 3) for _ in range(n)])
        order, lcp = suffix_array.suffix_array(codes)
        want = sorted(range(n), key=lambda i: codes[i:].tolist())
        assert order.tolist() == want
        for i in range(1, n):
            a, b, k = want[i - 1], want[i], 0
            while max(a, b) + k < n and codes[a + k] == codes[b + k]:
                k += 1
            assert lcp[i] == k


def every_maximal(texts, length):
    where = {}
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + length, len(x) + 1):
                where.setdefault(x[i:j], []).append((t, i))
    out = set()
    for s, at in where.items():
        left = {texts[t][i - 1 : i] if i else ("start", t) for t, i in at}
        right = {texts[t][i + len(s) : i + len(s) + 1] or ("end", t) for t, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(s), tuple(sorted(at))))
    return out


def test_maximal_repeats_and_cover():
    rnd = random.Random(1)
    for _ in range(40):
        parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(2, 9))) for _ in range(3)]
        texts = ["".join(rnd.choice(parts) if rnd.random() < 0.6 else rnd.choice("abc") for _ in range(rnd.randint(0, 6))).encode() for _ in range(5)]
        found = suffix_array.maximal_repeats(texts, 4)
        assert {(n, tuple(at)) for n, at in found} == every_maximal(texts, 4)
        # the bytes that maximal repeats cover are those that repeated strings of the least length cover
        for t, (removed, _, _) in enumerate(repeats.brute_force(texts, 4)):
            covered = {p for n, at in found for u, i in at if u == t for p in range(i, i + n)}
            assert len(covered) == removed
            spans = suffix_array.repeated_spans(texts, 4)[t]
            assert {p for a, z in zip(spans[::2], spans[1::2], strict=True) for p in range(a, z)} == covered


def test_sorted_suffixes():
    rnd = random.Random(3)
    for _ in range(30):
        texts = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 30))) for _ in range(6)]
        row, start, lcp = suffix_array.sorted_suffixes(texts, 3)
        found = [texts[r][i:] for r, i in zip(row.tolist(), start.tolist(), strict=True)]
        assert found == sorted(t[i:] for t in texts for i in range(len(t) - 2))
        for a, b, n in zip(found, found[1:], lcp[1:].tolist(), strict=False):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or n == min(len(a), len(b))


def test_repeat_groups(spark, empty):
    rows = [("a", 1, "xx" + "hello world " * 2), ("a", 2, "yy hello world zz"), ("b", 3, "hello world "), ("a", 4, None), (None, 5, "q" * 30)]
    docs = spark.createDataFrame(rows, "site string, doc_id long, text string")
    got = suffix_array.repeat_groups(docs, "site", 10).collect()
    assert {(r.site, r.doc_id) for r in got} == {("a", 1), ("a", 2), (None, 5)}
    text = {r[1]: (r[2] or "").encode() for r in rows}
    strings = {}
    for r in got:
        strings.setdefault((r.site, r.repeat), set()).add(text[r.doc_id][r.start : r.start + r.n_bytes])
    assert all(len(s) == 1 for s in strings.values())
    assert suffix_array.repeat_groups(empty.withColumn("site", empty["source"]), "site").count() == 0
