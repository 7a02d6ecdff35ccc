import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from helixlake.llm import decontamination, mixing, queries, sharding
from helixlake.llm.common import prefix_sums


def same_as_sql(spark, name, sf):
    frame = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(map(str, r)) for r in cursor.fetchall())
    got = sorted(tuple(str(r[c]) for c in names) for r in frame.collect())
    assert sorted(names) == sorted(frame.columns)
    assert got == want


def test_queries_match_sql(spark, sf):
    for name in queries.SQL:
        same_as_sql(spark, name, sf)


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def test_decontamination_brute_force(spark, edge, edge_rows, empty):
    long = words(next(r[1] for r in edge_rows if r[0] == 105))
    items = [(1, " ".join(long[10:40])), (2, "Word"), (3, None), (4, " ,,, "), (5, "nothing like this occurs"), (2, "Word"), (None, " ".join(long[50:63])), (7, "gämma1 über")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {(str(i) if i is not None else "", tuple(x[k : k + min(13, len(x))])) for i, t in items for x in [words(t)] if x for k in range(len(x) - min(13, len(x)) + 1)}
    for limit in (64 << 20, 4000):  # the second broadcasts in blocks
        got = Counter(tuple(r) for r in decontamination.decontaminate(edge, bench, broadcast_bytes=limit).drop("_t").collect())
        want = Counter()
        for r in edge_rows:
            w = words(r[1])
            hit, ids = set(), set()
            for item, gram in grams:
                for k in range(len(w) - len(gram) + 1):
                    if tuple(w[k : k + len(gram)]) == gram:
                        hit |= set(range(k, k + len(gram)))
                        ids.add(item)
            want[r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
        assert got == want
    kept = decontamination.drop_contaminated(edge, bench)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if not k[5])
    assert decontamination.decontaminate(empty, bench).count() == 0
    none = decontamination.decontaminate(edge, bench.limit(0)).collect()
    assert len(none) == len(edge_rows) and not any(r.contaminated for r in none)


def test_sharding_laws(spark, edge, edge_rows, empty):
    rows = sharding.shard(edge).collect()
    assert len(rows) == len(edge_rows)
    by_key = defaultdict(set)
    slots = defaultdict(list)
    for r in rows:
        by_key[r.doc_id].add((r.shard, r.grown_shard))
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    assert all(len(x) == 1 for x in by_key.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    assert sharding.shard(empty).count() == 0


def test_sharding_follows_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r.shard for r in sharding.shard(docs, weights=[1, 1, 2]).select("shard").collect())
    assert abs(n[2] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02


def fill(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark, edge, edge_rows, empty):
    rows = mixing.plan(edge).collect()
    assert len(rows) == len(edge_rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in edge_rows:
        sizes[r[3]] += size(r[1])
    want = fill(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r["_from"]]
        assert abs(r.target - want[r["_from"]]) < 1e-6 and r.taken <= 2 * r["_size"]
        taken[r["_from"]] += r.taken
        largest[r["_from"]] = max(largest[r["_from"]], r["_size"])
    assert Counter((r["_key"], r["_from"], r["_size"]) for r in rows) == Counter((r[0], r[3], size(r[1])) for r in edge_rows)
    # all copies in the order of their virtual finish, by a plain loop
    queues = {}
    for r in sorted(rows, key=lambda r: r["_cum"]):
        queues.setdefault(r["_from"], []).append(r)
    copies = [((e * sizes[s] + r["_cum"]) / want[s], r["_size"]) for s, q in queues.items() for e in (0, 1) for r in q if r["_size"]]
    sent, cut = 0, 0.0
    for finish, n in sorted(copies):
        sent += n
        if sent >= 1.5 * sum(sizes.values()):
            cut = finish
            break
    for r in rows:
        s = r["_from"]
        assert r.copies == sum(e * sizes[s] + r["_cum"] - r["_size"] / 2 <= cut * want[s] + 1e-9 for e in (0, 1))
    for s in sizes:
        assert abs(taken[s] - cut * want[s]) <= largest[s] / 2 + 1e-6 or taken[s] == 2 * sizes[s]
    again = mixing.plan(edge.repartition(7)).select("_key", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r["_key"], r.taken) for r in rows)
    for ordered in (True, False):
        stream = mixing.mix(edge, ordered=ordered).collect()
        assert Counter(r.doc_id for r in stream) == Counter(i for r in rows for i in [r["_key"]] * r.copies)
        assert not ordered or [r.finish for r in stream] == sorted(r.finish for r in stream)
    assert mixing.mix(empty).count() == 0 and mixing.plan(empty).count() == 0
    only = mixing.plan(spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.taken) for r in only] == [(0.0, 0), (0.0, 0)]


def test_mixing_breaks_ties_by_text(spark):
    """Of rows with one key and size, the same are taken whatever the partitions."""
    rows = [(i % 5, f"{'abcdefgh'[i % 8]} {i}", "s") for i in range(200)]
    runs = []
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        runs.append(Counter((r.doc_id, r.text) for r in mixing.mix(docs, weights=[1], share=0.5, max_epochs=1).collect()))
    assert runs[0] == runs[1] and sum(runs[0].values()) == 100


def test_prefix_sums_through_many_levels(spark):
    rows = [(i % 3, (i * 7919 % 10007) / 10007, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, u double, v long")
    for keys in (["g"], []):
        got = {r.v: r.s for r in prefix_sums(df, keys, "u", [F.col("v")], F.col("v"), "s", 3000, per_bucket=4, fan=5).collect()}
        run, want = Counter(), {}
        for g, _, v in sorted(rows, key=lambda r: r[1:]):
            run[g if keys else 0] += v
            want[v] = run[g if keys else 0]
        assert got == want
