"""Genome identity: all pairs that reach it, by plain loops; errors on planted genomes; chains."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.operators import genome_batches as batches
from helixlake.operators import similarity


def brute(rows, sizes, k, ani, fraction):
    """Pairs by containment over all pairs: (l, r) -> ANI; windows are left to the chain tests."""
    kmers = defaultdict(set)
    for g, _, h in rows:
        kmers[g].add(h)
    out = {}
    for a in kmers:
        for b in kmers:
            if a < b:
                value = (len(kmers[a] & kmers[b]) / min(len(kmers[a]), len(kmers[b]))) ** (1 / k)
                if value >= ani:
                    out[a, b] = value
    return out


@pytest.mark.parametrize("postings", [1, 3, 256])
def test_every_pair_is_found(spark, postings):
    """Random sketches with shared cores, clones and k-mers that all genomes have; the prefixes lose no pair."""
    rnd = random.Random(postings)
    cores = [[rnd.getrandbits(40) for _ in range(60)] for _ in range(5)]
    rows = []
    for g in range(60):
        core = cores[g % 5]
        own = rnd.sample(core, rnd.randint(15, 60)) + [rnd.getrandbits(40) for _ in range(rnd.randint(0, 60))] + [7, 8, 9]
        rows += [(g, i // 10, h) for i, h in enumerate(own)] + [(g, 99, own[0])]  # one k-mer twice
    rows += [(100, 0, 7), (101, 0, 8), (101, 0, 7)]  # nothing but common k-mers
    frame = spark.createDataFrame(rows, "genome long, window long, kmer long").repartition(5)
    sizes = spark.createDataFrame([(g, 1000 + g) for g in range(102)], "genome long, bp long")
    for ani in (0.95, 0.99):
        found = {(r.left_genome, r.right_genome): r.ani for r in similarity.ani_edges(frame, sizes, 21, ani, 0.0, postings).collect()}
        want = brute(rows, None, 21, ani, 0.0)
        assert found.keys() == want.keys() and len(want) > 20
        assert all(abs(found[p] - want[p]) < 1e-12 for p in want)


def test_no_kmer_is_one_task(spark):
    """2,000 genomes share a k-mer: it meets in blocks, and as it is the most common one, hardly any prefix has it."""
    rnd = random.Random(1)
    rows = [(g, 0, h) for g in range(2000) for h in (5, *(rnd.getrandbits(50) for _ in range(9)))]
    frame = spark.createDataFrame(rows, "genome long, window long, kmer long")
    sizes = frame.groupBy("genome").agg(F.count("*").alias("k"))
    assert similarity._candidates(frame.select("genome", "kmer"), sizes, 0.34, 100).count() == 0  # it is no genome's prefix
    few = similarity._candidates(frame.select("genome", "kmer").filter("genome < 300"), sizes, 0.01, 16)
    assert few.count() == 300 * 299 // 2


def test_errors_on_planted_genomes(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ACGT"), 20_000))
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    planted = {"a": (base, 1.0, 1.0)}
    for name, rate in (("b", 0.005), ("c", 0.01), ("d", 0.02)):
        planted[name] = (similarity.mutate(base, rate, 5), 1 - 0.75 * rate, 1.0)
    planted["e"] = (turned(similarity.mutate(base, 0.01, 6)), 1 - 0.0075, 1.0)
    planted["f"] = (similarity.mutate(base, 0.005, 7)[:18_000] + "".join(rng.choice(list("ACGT"), 2000)), None, 0.9)
    blocks = [base[i : i + 1000] for i in range(0, 20_000, 1000)]
    rng.shuffle(blocks)
    planted["g"] = ("".join(blocks), None, None)  # all of it, in another order
    step = 500
    windows = [(f"{g}:{w}", s[w * step : w * step + step + 20]) for g, (s, *_) in planted.items() for w in range(len(s) // step)]
    frame = spark.createDataFrame(windows, "id string, sequence string")
    sketch = similarity.kmer_sketch(frame, 21, 10_000).select(F.split("id", ":")[0].alias("genome"), F.split("id", ":")[1].cast("int").alias("window"), "kmer")
    sizes = spark.createDataFrame([(g, len(s)) for g, (s, *_) in planted.items()], "genome string, bp long")
    found = {(r.left_genome, r.right_genome): r for r in similarity.ani_edges(sketch, sizes, 21, 0.9, 0.0).collect()}
    for name, (_, ani, af) in planted.items():
        if name != "a":
            r = found["a", name]
            assert ani is None or abs(r.ani - ani) < 0.002, (name, r.ani, ani)
            assert af is None or abs(r.af_shorter - af) < 0.03, (name, r.af_shorter, af)
    assert found["a", "g"].ani > 0.99 and found["a", "g"].af_shorter < 0.6  # shared, but not in order
    assert found["a", "e"].af_shorter > 0.97  # the other strand is a backward chain


def test_chains():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = rng.integers(0, 6, 9), rng.integers(0, 6, 9)
        chain = similarity._heaviest_chain(x, y)
        assert sorted(set(chain.tolist())) == sorted(chain.tolist())
        best = 0
        for mask in range(1 << 9):
            some = [i for i in range(9) if mask >> i & 1]
            pts = sorted((x[i], y[i]) for i in some)
            if all(a[1] <= b[1] for a, b in zip(pts, pts[1:], strict=False)):
                best = max(best, len(some))
        assert len(chain) == best
    assert len(similarity._heaviest_chain(np.empty(0, int), np.empty(0, int))) == 0 and Counter() == {}


def shuffled(spark, run) -> int:
    """Rows that run writes into shuffles."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def total() -> int:
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_the_sketches_are_shuffled_once(spark):
    """80 k-mers a genome, of which pairs share 70: the rows go to the k-mers once, and matches to their pair; with random
    k-mers that meet by chance, no more."""
    rnd = random.Random(8)
    rows = []
    for g in range(0, 200, 2):
        own = [rnd.getrandbits(50) for _ in range(90)]
        rows += [(g + side, i // 10, h) for side in (0, 1) for i, h in enumerate(own[10 * side : 80 + 10 * side])]
    frame = spark.createDataFrame(rows, "genome long, window long, kmer long")
    sizes = spark.createDataFrame([(g, 1000 + g) for g in range(200)], "genome long, bp long")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = []
    moved = shuffled(spark, lambda: found.extend(similarity.ani_edges(frame, sizes).collect()))
    assert len(found) == 100 and moved < 2.5 * len(rows), moved / len(rows)


def test_frequent_kmers_add_to_the_others(spark):
    """Pairs that reach the threshold only with k-mers that all genomes have, only by them, and not at all."""
    rnd = random.Random(9)
    common = [rnd.getrandbits(40) for _ in range(30)]
    rows = []
    for g in range(40):
        pair = random.Random(1000 + g // 2)
        own = [pair.getrandbits(40) for _ in range(10)] if g < 20 else []
        other = [rnd.getrandbits(40) for _ in range(25 if g < 20 else 5 if g < 30 else 60)]
        rows += [(g, i // 10, h) for i, h in enumerate(common + own + other)]
    frame = spark.createDataFrame(rows, "genome long, window long, kmer long")
    sizes = spark.createDataFrame([(g, 1000 + g) for g in range(40)], "genome long, bp long")
    for postings in (1, 16, 10_000):
        found = {(r.left_genome, r.right_genome): r.ani for r in similarity.ani_edges(frame, sizes, 21, 0.97, 0.0, postings).collect()}
        want = brute(rows, None, 21, 0.97, 0.0)
        assert found.keys() == want.keys() and {(0, 1), (20, 21)} <= want.keys() and (0, 2) not in want
        assert all(abs(found[p] - want[p]) < 1e-12 for p in want)


def test_chance_matches_are_not_shuffled(spark):
    """Each of 1,000 genomes has 5 of 50 k-mers that 100 genomes have: 250,000 matches of genomes that are nothing alike."""
    rnd = random.Random(10)
    pool = [rnd.getrandbits(50) for _ in range(50)]
    rows = [(g, i // 10, h) for g in range(1000) for i, h in enumerate([rnd.getrandbits(50) for _ in range(40)] + rnd.sample(pool, 5))]
    frame = spark.createDataFrame(rows, "genome long, window long, kmer long")
    sizes = spark.createDataFrame([(g, 1000) for g in range(1000)], "genome long, bp long")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = []
    moved = shuffled(spark, lambda: found.extend(similarity.ani_edges(frame, sizes).collect()))
    assert not found and moved < 4 * len(rows), moved / len(rows)


@pytest.mark.parametrize("k", [1, 2, 15, 21, 27, 31])
def test_kmers_of_both_strands(k):
    rnd = random.Random(k)
    text = "".join(rnd.choice("ACGTN") for _ in range(300)) + "A" * 40
    turned = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    codes = lambda s: np.array(["ACGTN".index(c) for c in s], np.uint8)
    found, back = batches.canonical_kmers(codes(text), k), batches.canonical_kmers(codes(turned), k)
    assert found.tolist() == back[::-1].tolist()
    words = [min(text[i : i + k], turned[len(text) - i - k : len(text) - i]) for i in range(len(text) - k + 1)]
    assert len(dict(zip(words, found.tolist(), strict=True))) == len(set(found.tolist())) == len(set(words)) == len(set(zip(words, found.tolist(), strict=True)))


def test_sequences_as_windows_of_kmers(spark):
    """Whole sequences give what their sketched windows give; short, null, repeated and several sequences of a genome."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(0, 60, 3):
        base = "".join(rng.choice(list("ACGTN"), int(rng.integers(90, 400)), p=[0.24] * 4 + [0.04]))
        rows += [(f"g{g}", base), (f"g{g + 1}", similarity.mutate(base, 0.01, g)[::-1].translate(str.maketrans("ACGT", "TGCA"))), (f"g{g + 2}", similarity.mutate(base, 0.04, g))]
    rows += [("poly", "A" * 200), ("poly2", "T" * 150)]
    k, step = 15, 32
    windows = [((g, a), s[a : a + step + k - 1]) for g, s in rows for a in range(0, len(s) - k + 1, step)]
    frame = spark.createDataFrame(windows, "id struct<g: string, a: int>, sequence string")
    sketch = similarity.kmer_sketch(frame, k, step).select(F.col("id.g").alias("genome"), F.col("id.a").alias("window"), "kmer")
    want = similarity.ani_edges(sketch, spark.createDataFrame([(g, len(s)) for g, s in rows], "genome string, bp long"), k, 0.95, 0.5).collect()
    odd = rows + rows[:3] + [("short", "ACG"), ("none", None), (None, rows[0][1])]
    for postings in (1, 16, 256):
        found = similarity.genome_identity(spark.createDataFrame(odd, "genome string, sequence string"), k, step, 0.95, 0.5, postings).collect()
        assert len(want) > 30 and sorted(found) == sorted(want)
    two = spark.createDataFrame([("a", rows[0][1]), ("a", rows[3][1]), ("b", rows[3][1]), ("b", rows[0][1])], "genome string, sequence string")
    assert [(r.ani, r.af_shorter, r.left_bp) for r in similarity.genome_identity(two, k, step).collect()] == [(1.0, 1.0, len(rows[0][1]) + len(rows[3][1]))]
    with pytest.raises(Exception, match="not normalised"):
        similarity.genome_identity(two.withColumn("sequence", F.lit("acgu" * 9)), k, step).collect()


@pytest.mark.parametrize("cells", [0, 24, 1000])
def test_chains_side_by_side(monkeypatch, cells):
    """As pair by pair, and where cells are too many to be chained so."""
    monkeypatch.setattr(batches, "CELLS", cells)
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 30, 200)
    pair = rng.permutation(np.repeat(np.arange(200), sizes))
    x, y = rng.integers(0, 5, len(pair)), rng.integers(0, 5, len(pair)) * 10**rng.integers(0, 2)
    found = batches.chain_hits(pair, x, y, 200)
    for p in range(200):
        xs, ys = x[pair == p], y[pair == p]
        chain = max((similarity._heaviest_chain(xs, side) for side in (ys, -ys)), key=len)
        assert found[p].tolist() == [len(set(xs[chain].tolist())), len(set(ys[chain].tolist()))]
