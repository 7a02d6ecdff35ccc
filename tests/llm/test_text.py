import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixlake.llm import exact, jaccard, lm_score, repeats, toxicity


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_groups(edge, edge_rows, block):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in edge_rows:
        groups[body(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i, id_ in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            want[id_, keep, len(ids), i == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    rows = exact.exact_groups(edge, block=block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, rows)) == want


def test_exact_groups_survive_checksum_collisions(spark, monkeypatch):
    """Names, not checksums, decide: with every checksum equal the groups stay the same."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *a: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "ab"), (4, "cc")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(docs, block=1).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1)}


def test_exact_groups_empty(empty):
    assert exact.exact_groups(empty).count() == 0


def test_repeats_brute_force(spark, edge, edge_rows, empty):
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    parts = [noise(rnd.randint(15, 80)) for _ in range(8)]
    rows = [(i, "".join(rnd.choice([*parts, noise(9)]) if rnd.random() < 0.7 else noise(rnd.randint(1, 60)) for _ in range(rnd.randint(0, 5)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, rows[5][1]), (153, "ab" * 60), (154, "x" * 100), (155, "é" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, length=20, bytes_per_group=2000).collect()}
    want = repeats.brute_force([(t or "").encode() for _, t in rows], 20)
    assert got == {i: (len((t or "").encode()), *w) for (i, t), w in zip(rows, want, strict=True)}
    got = Counter((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(edge, bytes_per_group=30_000).collect())
    want = repeats.brute_force([(r[1] or "").encode() for r in edge_rows], 200)
    assert got == Counter((r[0], *w) for r, w in zip(edge_rows, want, strict=True))
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("options", [{"crowd": 2}, {"bucket_bytes": 200}, {"bytes_per_group": 300}])
def test_repeats_in_crowds_buckets_and_pieces(spark, monkeypatch, options):
    """Anchors of many contexts, tiny buckets, and long texts cut into pieces among runs of several sizes change nothing."""
    monkeypatch.setattr(repeats, "CHUNK", 64)
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh\0é") for _ in range(n))
    passage, other = noise(60), noise(33)
    rows = [(i, noise(rnd.randint(0, 30)) + passage[rnd.randint(0, 9) :] + noise(rnd.randint(0, 30)) + (other if i % 3 else "")) for i in range(60)]
    rows += [(60, noise(3000) + passage + noise(500) + passage), (61, passage), (62, passage + "x"), (63, noise(700)), (64, "z" * 900), (65, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, length=20, **options).collect()}
    assert got == dict(zip([i for i, _ in rows], repeats.brute_force([(t or "").encode() for _, t in rows], 20), strict=True))


def test_anchors_do_not_depend_on_the_run():
    import numpy as np

    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 100, 500).astype(np.uint8)
    seen = {}
    for before, after in ((0, 0), (7, 3000), (100_000, 11), (3, 300_000)):
        raw = np.concatenate((rnd.integers(97, 100, before).astype(np.uint8), text, rnd.integers(97, 100, after).astype(np.uint8)))
        x = repeats.Anchored(raw, np.array([0, len(raw)]), 50, 25)
        for a, z, g in zip(x.first.tolist(), x.last.tolist(), x.g.tolist(), strict=True):
            for i in range(max(a, before), min(z, before + 450) + 1):
                assert seen.setdefault(i - before, g) == g
    assert len(seen) == 451


def backoff(texts, order, alpha):
    every = [words(t) for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for w in every), Counter()) for n in range(1, order + 1)]
    n_all = sum(map(len, every))
    out = []
    for w in every:
        own = [grams(w, n) for n in range(1, order + 1)]
        left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            have = min(order, i + 1)
            for n in range(have, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                score += math.log(alpha) * (n < have)
                if left(g) > 0:
                    score += math.log(left(g) / (left(g[:-1]) if n > 1 else n_all - len(w)))
                    break
            else:
                score += math.log(1 / (n_all - len(w) + 1))
        out.append(score)
    return out


@pytest.mark.parametrize("by_rows", [False, True])
@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_score_brute_force(edge, edge_rows, empty, order, by_rows):
    rows = lm_score.score(edge, order=order, bytes_per_group=20_000, rows=by_rows).collect()
    want = backoff([r[1] for r in edge_rows], order, 0.4)
    expected = sorted((str(r[0]), len(words(r[1])), round(x, 6) if words(r[1]) else None) for r, x in zip(edge_rows, want, strict=True))
    assert sorted((str(r.doc_id), r.n_words, None if r.log_score is None else round(r.log_score, 6)) for r in rows) == expected
    assert lm_score.score(empty, order=order, rows=by_rows).count() == 0


def near(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]):
                links[i].add(j), links[j].add(i)
    return sets, links


@pytest.mark.parametrize("blocks", [1024, 3])
def test_jaccard_brute_force(spark, edge, edge_rows, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", blocks)
    rnd = random.Random(8)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(80)] for _ in range(6)]
    rows = [(r[0], r[1]) for r in edge_rows]
    for k in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "zz"
        rows.append((1000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, links = near([t for _, t in rows])
    seen, label = set(), {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = [], [i]
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    group.append(j)
                    todo += links[j]
            name = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            label |= {j: name for j in group}
    want = Counter((rows[i][0], label[i], len(links[i])) for i in range(len(rows)))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(docs).collect())
    missing = sum((want - got).values())
    assert missing <= 2, (want - got, got - want)  # banding reaches 99.8 % of links at the threshold
    kept = jaccard.keep_one(docs).collect()
    alone = sum(1 for i in range(len(rows)) if not words(rows[i][1])) + len({(label[i], rows[i][1] if label[i] is None else "") for i in range(len(rows)) if words(rows[i][1])})
    assert abs(len(kept) - alone) <= 2


def test_jaccard_empty(empty):
    assert jaccard.jaccard_classes(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_bands_reach_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        bands, rows = jaccard.bands_for(threshold, 0.99, 256)
        assert 1 - (1 - threshold**rows) ** bands >= 0.99 and bands * rows <= 256


def test_maximal_segments_match_definition():
    rnd = random.Random(1)
    for _ in range(300):
        s = [rnd.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rnd.randint(1, 14))]
        run = [0]
        for x in s:
            run.append(run[-1] + x)
        at = [i for i, x in enumerate(s) if x > 0]
        got = {(a, b) for a, b, _ in toxicity.maximal_segments(at, [run[i] for i in at], [run[i + 1] for i in at])}

        # the definition: segments whose proper parts score less, and which no greater such segment holds
        n = len(s)
        total = lambda i, j: run[j + 1] - run[i]  # noqa: B023, E731
        proper = [(i, j) for i in range(n) for j in range(i, n) if all(total(a, b) < total(i, j) for a in range(i, j + 1) for b in range(a, j + 1) if (a, b) != (i, j)) and total(i, j) > 0]
        want = {(i, j) for i, j in proper if not any((a, b) != (i, j) and a <= i and j <= b for a, b in proper)}
        assert got == want


def test_toxicity(spark, edge, edge_rows, empty):
    rnd = random.Random(4)
    plain = [f"p{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), "nasty" + rnd.choice("abcdef"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    truth = dict(labels)
    scored = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.held]
    assert 200 < len(held) < 400
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    hit = next(r for r in held if r.predicted)
    text = words(dict(rows)[hit.doc_id])
    assert any(w.startswith("nasty") for p in hit.passages for w in text[p["first"] : p["last"] + 1])
    found = toxicity.score(edge, model, passages=False).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in edge_rows)
    kept = toxicity.drop_toxic(edge, marks, fit_on=docs)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted == 0 for r in found)
    assert toxicity.score(empty, model).count() == 0
    flat = toxicity.fit(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(edge, flat).collect()} == {0.0}


def test_toxicity_ignores_held_out_labels(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id") % 7).alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()}
    assert a == b
