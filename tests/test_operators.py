import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixlake.functions import numeric as N
from helixlake.functions import sequence as S
from helixlake.operators import calibrate, chunks, evaluate, qc, similarity, splits, weights
from helixlake.operators.components import connected_components


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ranges(length, size, tail):
    out, at = [], 0
    if 0 < length <= size:
        return [(0, length)]
    while at < length:
        rest = length - at
        if size < rest < size + tail:
            middle = at + rest // 2
            return [*out, (at, middle), (middle, length)]
        out.append((at, min(at + size, length)))
        at += size
    return out


def test_fixtures(spark):
    dna = lambda s: S.normalize_dna(F.lit(s))
    assert one(spark, dna("acgu")) == "ACGT"
    assert one(spark, dna("ACGTNNRY")) == "ACGTNNNN"
    assert one(spark, S.reverse_complement(F.lit("GATTACA"))) == "TGTAATC"
    with pytest.raises(PySparkException):
        one(spark, dna("ACGX"))
    assert one(spark, S.canonical_hash(F.lit("AAAA")))[:12] == one(spark, S.canonical_hash(F.lit("TTTT")))[:12] == "63c1dd951ffe"
    assert one(spark, S.sequence_hash(F.lit("TTTT")))[:12] == "3fd8b2c4aea7"
    assert one(spark, S.stable_id(F.lit("ARC"), F.lit("ARC__g1|c1"))) == "d03e2851bcf89f4c70d9"
    assert one(spark, S.n_fraction(dna("ACGTNNRY"))) == 0.5
    assert abs(N.smoothing_floor(0.05, 2) - 0.1169068491) < 1e-9
    assert one(spark, N.hms(F.lit(3725))) == "01:02:05" and one(spark, N.human_bytes(F.lit(1536))) == "1.50 KiB"
    assert N.memory_limit("48G") == "48G"
    with pytest.raises(ValueError):
        N.memory_limit("0G")


def test_chunk_ranges(spark):
    cases = [300, 5000, 5001, 5499, 5500, 10000, 10201, 12000, 12300, 0, 1]
    rows = spark.createDataFrame([(n,) for n in cases], "n long").select("n", S.chunk_ranges(F.col("n")).alias("r")).collect()
    lengths = {r.n: [x["end"] - x["start"] for x in r.r] for r in rows}
    assert lengths[5001] == [2500, 2501] and lengths[5499] == [2749, 2750] and lengths[10201] == [5000, 2600, 2601] and lengths[0] == []
    rows = spark.range(0, 2600).select("id", S.chunk_ranges(F.col("id"), 100, 15).alias("r")).collect()
    assert all([(x["start"], x["end"]) for x in r.r] == ranges(r.id, 100, 15) for r in rows)


def test_round1(spark):
    values = [0.35, 1.15, -0.35, 2.05, *[i / 20 for i in range(200)], *[random.Random(1).random() * 9 for _ in range(200)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.round1(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 1) for r in rows)


def test_canonical_hash_ignores_strand(spark):
    rnd = random.Random(0)
    rows = [("".join(rnd.choice("ACGTN") for _ in range(30)),) for _ in range(50)]
    df = spark.createDataFrame(rows, "s string").select(S.canonical_hash(F.col("s")).alias("a"), S.canonical_hash(S.reverse_complement(F.col("s"))).alias("b"))
    assert df.filter("a <> b").count() == 0


def union_find(edges, nodes=()):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for x in nodes:
        find(x)
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(250)]
    for some in (edges, [(b, a) for a, b in reversed(edges)], edges + edges):
        df = spark.createDataFrame(some, "u long, v long")
        alone = spark.createDataFrame([(5000,), (2000,)], "node long")
        got = {r.node: r.component for r in connected_components(df, vertices=alone).collect()}
        want = union_find([e for e in some if e[0] != e[1]], [5000, 2000])
        assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_edges_depend_on_first(spark):
    row = lambda *r: spark.createDataFrame(list(r), "record_id string, grp string, label string, hash string, pos long")
    edges, gone = similarity.exact_edges(row(("A1", "g1", "a", "h", 1), ("A2", "g2", "a", "h", 2), ("B", "g3", "b", "h", 3)))
    assert [(r.left_group, r.right_group) for r in edges.collect()] == [("g1", "g2")]
    assert {r.record_id for r in gone.collect()} == {"A1", "B"}
    edges, gone = similarity.exact_edges(row(("B", "g3", "b", "h", 1), ("A1", "g1", "a", "h", 2), ("A2", "g2", "a", "h", 3)))
    assert edges.count() == 0 and {r.record_id for r in gone.collect()} == {"A1", "A2", "B"}
    _, gone = similarity.exact_edges(row(("A1", "g1", "a", "h", 1), ("A2", "g2", "a", "h", 2), ("B", "g3", "b", "h", 3)), strict=True)
    assert gone.count() == 3


def test_near_clusters_find_planted(spark):
    table = similarity.planted(40, 300, 0.02, 1)
    classes = {r.id: r["class"] for r in similarity.near_clusters(spark.createDataFrame(table)).collect()}
    assert sum(classes[2 * i] == classes[2 * i + 1] for i in range(40)) >= 38
    assert len(set(classes.values())) >= 40


def test_genome_identity(spark):
    rng = np.random.default_rng(0)
    a = "".join(rng.choice(list("ACGT"), 6000))
    rows = [("a", a), ("b", similarity.mutate(a, 0.01, 1)), ("c", "".join(rng.choice(list("ACGT"), 6000)))]
    windows = [(g, w, s[w * 500 : w * 500 + 520]) for g, s in rows for w in range(12)]
    frame = spark.createDataFrame([(f"{g}:{w}", s) for g, w, s in windows], "id string, sequence string")
    sketch = similarity.kmer_sketch(frame, 21, 10_000).select(F.split("id", ":")[0].alias("genome"), F.split("id", ":")[1].alias("window"), "kmer")
    sizes = spark.createDataFrame([(g, len(s)) for g, s in rows], "genome string, bp long")
    found = similarity.ani_edges(sketch, sizes).collect()
    assert [(r.left_genome, r.right_genome) for r in found] == [("a", "b")] and 0.98 < found[0].ani < 1 and found[0].af_shorter > 0.9


def test_greedy_split_keeps_ratios_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i}", int(rng.integers(1, 1000)), int(rng.integers(1, 5)), f"s{i % 3}", 0) for i in range(300)]
    stats = spark.createDataFrame(rows, "component string, bases long, genomes long, main_source string, main_label int")
    got = {r.component: r.split for r in splits.allocate(stats).collect()}
    assert got == {r.component: r.split for r in splits.allocate(stats.repartition(7)).collect()} and len(got) == 300
    for s in ("s0", "s1", "s2"):
        part = [r for r in rows if r[3] == s]
        total, largest = sum(r[1] for r in part), max(r[1] for r in part)
        for split, ratio in splits.RATIOS.items():
            have = sum(r[1] for r in part if got[r[0]] == split)
            assert abs(have - ratio * total) <= 2 * largest


def test_split_chunk_qc_end_to_end(spark):
    rnd = random.Random(7)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    shared = dna(900)
    rows = [(f"r{i}", dna(rnd.randint(50, 2500)), f"s{i % 2}", f"g{i // 2}", i % 2) for i in range(80)]
    rows += [("x1", shared, "s0", "gx", 0), ("x2", shared, "s0", "gy", 0), ("y1", shared[:300], "s0", "gz", 0), ("y2", shared[:300], "s1", "gw", 1)]
    base = spark.createDataFrame(rows, "record_id string, sequence string, source string, genome_id string, main_label int")
    man = base.select(
        "record_id", "source", "genome_id", F.col("record_id").alias("contig_id"), "main_label", F.when(F.col("main_label") == 1, 0).alias("sub_label"), F.length("sequence").cast("long").alias("sequence_length"),
        F.lit(0.0).alias("n_fraction"), S.sequence_hash(F.col("sequence")).alias("sequence_sha256"), S.canonical_hash(F.col("sequence")).alias("canonical_sha256"), F.concat(F.lit("GENOME::"), "genome_id").alias("base_group_id"),
        F.lit("p").alias("source_path"), F.monotonically_increasing_id().alias("pos"), F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("exclusion_reason"),
    ).cache()
    edges = spark.createDataFrame([], "left_group string, right_group string, reason string")
    comp = splits.build_components(man, edges)
    names = {r.base_group_id: r.similarity_component for r in comp.collect()}
    assert names["GENOME::gx"] == names["GENOME::gy"] == "SIM_" + hashlib.sha256(b"GENOME::gx").hexdigest()[:20]
    conflicts = splits.label_conflicts(man, "canonical_sha256", "main_label")
    rows = man.join(comp, "base_group_id").select(F.col("similarity_component").alias("component"), F.col("sequence_length").alias("bases"), "genome_id", "source", F.col("main_label").alias("label"), "pos")
    assigned = splits.allocate(splits.component_stats(rows).withColumnRenamed("main_label", "main_label"))
    final = splits.final_manifest(man, comp, assigned, conflicts, spark.createDataFrame([("r0", "early")], "record_id string, reason string")).cache()
    why = {r.record_id: r.exclusion_reason for r in final.collect()}
    assert why["y1"] == why["y2"] == "conflicting_labels_for_identical_sequence" and why["r0"] == "early" and why["r1"] is None
    table = chunks.chunk_table(base.select("record_id", "sequence"), final, 500, 50).withColumn("chunk_hash", S.canonical_hash(F.col("sequence"))).cache()
    assert qc.qc_report(table).first().passed
    totals = table.groupBy("genome_id").agg(F.sum("sample_weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-9 for r in totals)
    weighted = weights.normalised_weights(table, weights.class_weights(weights.dataset_stats(table)))
    assert all(abs(r.m - 1) < 1e-9 for r in weighted.groupBy("split").agg(F.avg("loss_weight").alias("m")).collect())
    leak = table.limit(1).withColumn("split", F.when(F.col("split") == "train", "inference").otherwise("train"))
    assert not qc.qc_report(table.unionByName(leak)).first().passed
    changed = base.select("record_id", F.when(F.col("record_id") == "r1", F.lit("ACGT")).otherwise(F.col("sequence")).alias("sequence"))
    with pytest.raises(PySparkException):
        chunks.chunk_table(changed, final, 500, 50).collect()
    assert splits.group_assignments(final).count() == final.filter("split <> 'quarantine'").select("split_group").distinct().count()


def test_metrics_golden(spark):
    rows = [(0, 0)] * 315 + [(1, 0)] * 19 + [(1, 1)] * 2001
    df = spark.createDataFrame(rows, "truth int, predicted int")
    r = evaluate.summary(evaluate.class_metrics(evaluate.confusion(df, 2))).first()
    assert abs(r.accuracy - 0.991863) < 1e-6 and abs(r.macro_f1 - 0.982999) < 1e-6
    conf = spark.createDataFrame([(0.95, 1, 1), (0.92, 0, 1), (0.55, 1, 1), (0.65, 1, 1)], "confidence double, predicted int, truth int")
    assert abs(evaluate.ece(evaluate.reliability(conf)).first().ece - 0.4175) < 1e-9
    pr = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.4), (0, 0.1)], "y int, s double")
    ap = evaluate.average_precision(evaluate.precision_recall(pr, F.col("s"), F.col("y") == 1)).first()
    assert abs(ap.average_precision - 0.8055555556) < 1e-9 and abs(ap.pr_auc - 0.8472222222) < 1e-9
    none = evaluate.average_precision(evaluate.precision_recall(pr, F.col("s"), F.col("y") == 7)).first()
    assert none.average_precision is None
    frame = spark.createDataFrame([(1, "g", [0.9, 0.1], 5000, 0), (2, "g", [0.2, 0.8], 1000, 0)], "chunk_id int, genome_id string, p array<double>, valid_length int, truth int")
    assert np.allclose(evaluate.aggregate_level(frame, ["genome_id"], 2).first().p, [0.83201439, 0.16798561])
    w = weights.class_weights(spark.createDataFrame([(0, 100), (1, 25)], "labels int, genomes int")).orderBy("labels").collect()
    assert np.allclose([r.weight for r in w], [2 / 3, 4 / 3])


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(int(t), int(t) if rng.random() < 0.8 else 1 - int(t), f"k{i % 20}") for i, t in enumerate(rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "truth int, predicted int, split_group string")
    hashed = evaluate.bootstrap_hashed(df, 2, 50, seed=3).first()
    names = sorted({g for *_, g in rows})
    scores = []
    for rep in range(50):
        picked = [names[int(hashlib.sha256(f"3|{rep}|{d}".encode()).hexdigest()[:8], 16) % 20] for d in range(20)]
        some = [(t, p) for name in picked for t, p, g in rows if g == name]
        f1 = lambda c: 2 * sum(t == p == c for t, p in some) / sum((t == c) + (p == c) for t, p in some)  # noqa: B023, E731
        scores.append((f1(0) + f1(1)) / 2)
    assert np.allclose([hashed.low, hashed.high], np.quantile(scores, [0.025, 0.975])) and hashed.groups == 20


def test_chunks_of_long_records_take_linear_time(spark):
    import time

    letters = "ACGTé𐐀"
    rows = [(str(n), "".join(letters[(i * 7 + i // 5) % 6] for i in range(n))) for n in (1, 99, 100, 101, 114, 115, 200, 214, 215, 1000, 1014)]
    got = {(r.record_id, r.start): r.piece for r in chunks.explode_chunks(spark.createDataFrame(rows, "record_id string, sequence string"), 100, 15).collect()}
    assert got == {(k, a): s[a:z] for k, s in rows for a, z in ranges(len(s), 100, 15)}
    took = []
    for n in (2 << 20, 4 << 20, 8 << 20, 16 << 20, 96 << 20):
        letters = F.when(F.col("id") >= 0, "ACGT").otherwise("N")  # not a constant, which would be computed in the plan
        one = spark.range(1).select(F.lit("r").alias("record_id"), F.repeat(letters, n // 4).alias("sequence"))
        began = time.perf_counter()
        assert chunks.explode_chunks(one).agg(F.sum(F.length("piece"))).first()[0] == n
        took.append(time.perf_counter() - began)
    assert took[3] < 5 and took[4] < 10 * max(took[3], 0.5)  # six times the length


def test_kmers_of_all_places(spark):
    rows = spark.createDataFrame([("a", "ACGTNACGTA"), ("b", "AC"), ("c", "")], "id string, sequence string")
    got = {}
    for r in similarity.kmer_sketch(rows, 4, 100).groupBy("id").agg(F.collect_set("kmer").alias("k")).collect():
        got[r.id] = set(r.k)
    canon = lambda x: min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))
    words = {k: {canon(s[i : i + 4]) for i in range(max(1, len(s) - 3))} for k, s in (("a", "ACGTNACGTA"), ("b", "AC"), ("c", ""))}
    hashes = {x: spark.range(1).select(F.xxhash64(F.lit(x))).first()[0] for s in words.values() for x in s}
    assert got == {k: {hashes[x] for x in s} for k, s in words.items()}


def test_shared_split(spark):
    main = spark.createDataFrame([("train", "c1", "AC", 1, 0), ("train", "c2", "GG", 0, None), ("inference", "c3", "TT", 1, 2)], "split string, chunk_id string, sequence string, labels int, sub_labels int")
    sub = main.filter("labels = 1").withColumn("labels", F.col("sub_labels"))
    assert {r.split: r.shared for r in qc.shared_split(main, sub).collect()} == {"train": True, "inference": True}
    assert {r.split: r.shared for r in qc.shared_split(main, sub.withColumn("labels", F.lit(0))).collect()} == {"train": True, "inference": False}


def test_history(spark):
    rows = [("a", i, e) for i, e in enumerate([2.0, 2.1, 2.2, 2.0, 2.1])]
    kept = calibrate.repair_history(spark.createDataFrame(rows, "run string, pos int, epoch double"), 2.1).orderBy("pos").collect()
    assert [(r.pos, r.epoch) for r in kept] == [(0, 2.0), (4, 2.1)]
    stops = calibrate.early_stop(spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 1.5, 1.9, 2.0, 3.0])] + [("b", i, float(i)) for i in range(5)], "run string, pos int, m double"), "m", 3, 1.0)
    assert {r.run: r.stop for r in stops.collect()} == {"a": 4, "b": None}


def test_lineage_and_fingerprint(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "artifact string, sha256 string")
    then = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "artifact string, sha256 string")
    assert {(r.artifact, r.problem) for r in qc.verify_lineage(now, then).collect()} == {("b", "changed"), ("c", "missing")}
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert qc.fingerprint(df, "id", "x").first() == qc.fingerprint(df.repartition(9), "id", "x").first() != qc.fingerprint(df.limit(99), "id", "x").first()
