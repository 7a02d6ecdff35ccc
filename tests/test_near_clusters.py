"""Near-duplicate classes against local alignment of all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixlake.operators import similarity

TURN = str.maketrans("ACGT", "TGCA")


def turned(s: str) -> str:
    return s[::-1].translate(TURN)


def local_alignment(x: str, y: str) -> tuple[float, float, float]:
    """(identity, coverage of x, coverage of y) of the best local alignment: +1 for a match, -3 for anything else."""
    a, b = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
    h = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    at = np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        row = np.maximum(0, h[i - 1] - 3)
        row[1:] = np.maximum(row[1:], h[i - 1, :-1] + np.where(b == a[i - 1], 1, -3))
        h[i] = np.maximum.accumulate(row + 3 * at) - 3 * at
    i, j = np.unravel_index(np.argmax(h), h.shape)
    end, matches, columns = (i, j), 0, 0
    while h[i, j]:
        same = i and j and a[i - 1] == b[j - 1]
        if i and j and h[i, j] == h[i - 1, j - 1] + (1 if same else -3):
            i, j, matches = i - 1, j - 1, matches + bool(same)
        elif i and h[i, j] == h[i - 1, j] - 3:
            i -= 1
        else:
            j -= 1
        columns += 1
    return matches / max(columns, 1), (end[0] - i) / len(a), (end[1] - j) / len(b)


def near(x: str, y: str) -> bool:
    return any(s >= 0.95 and min(c, d) >= 0.85 for s, c, d in (local_alignment(x, y), local_alignment(x, turned(y))))


def changed(rnd: random.Random, s: str, rate: float, indels: int, shift: float) -> str:
    """Substitutions, insertions and deletions, and a window moved by up to ``shift`` of the length, on either strand."""
    out = [rnd.choice("ACGT") if rnd.random() < rate else c for c in s]
    for _ in range(indels):
        at = rnd.randrange(len(out))
        if rnd.random() < 0.5:
            del out[at]
        else:
            out.insert(at, rnd.choice("ACGT"))
    cut = int(rnd.random() * shift * len(s))
    text = "".join(out)
    text = text[cut:] + "".join(rnd.choice("ACGT") for _ in range(cut)) if rnd.random() < 0.5 else "".join(rnd.choice("ACGT") for _ in range(cut)) + text[: len(text) - cut]
    return turned(text) if rnd.random() < 0.5 else text


@pytest.mark.parametrize("rate, indels, shift", [(0.015, 0, 0.0), (0.005, 4, 0.0), (0.005, 1, 0.08), (0.0, 0, 0.12)])
def test_classes_of_many_members(spark, rate, indels, shift):
    rnd = random.Random(int(1000 * rate + 10 * indels + 100 * shift))
    rows, family = [], {}
    for f in range(8):
        base = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(300, 420)))
        for _ in range(9):
            family[len(rows)] = f
            rows.append((len(rows), changed(rnd, base, rate, indels, shift)))
    rows += [(len(rows) + i, turned(rows[i][1])) for i in range(5)]  # equal on the other strand
    family |= {72 + i: family[i] for i in range(5)}
    found = {r.id: r for r in similarity.near_clusters(spark.createDataFrame(rows, "id long, sequence string").repartition(5)).collect()}
    assert sorted(found) == sorted(family)
    text, want, hit = dict(rows), 0, 0
    for i in range(72):
        for j in range(i):
            if family[i] == family[j] and near(text[i], text[j]):
                want += 1
                hit += found[i]["class"] == found[j]["class"]
    assert want > 100 and hit / want >= 0.9, (hit, want)
    members = defaultdict(set)
    for i, r in found.items():
        members[r["class"]].add(i)
        if r.centre != i and text[r.centre] not in (text[i], turned(text[i])):  # the alignment is what it says; its span is the longest that reaches the identity
            s, c, d = local_alignment(text[i] if r.strand == "+" else turned(text[i]), text[r.centre])
            assert s >= r.identity - 0.02 and abs(c - r.coverage) < 0.1 and abs(d - r.centre_coverage) < 0.1 and r.identity >= 0.95 - 1e-9 and min(r.coverage, r.centre_coverage) >= 0.85
    for name, group in members.items():
        assert name == min(group) and len({family[i] for i in group}) == 1  # never two families in a class
    for i in range(5):
        a, b = found[i], found[72 + i]
        assert a["class"] == b["class"] and a.copies == b.copies >= 2 and a.links == b.links and a.strand != b.strand


def test_links_count_both_ends_and_odd_rows_have_classes(spark):
    rnd = random.Random(4)
    base = "".join(rnd.choice("ACGT") for _ in range(200))
    other = base[:100] + ("A" if base[100] != "A" else "C") + base[101:]
    rows = [(1, base), (2, other), (3, None), (4, ""), (5, "ACGT"), (6, "ACGT"), (7, "ACGA"), (8, base + "ACGT" * 100)]
    got = {r.id: (r["class"], r.centre, r.links, r.copies) for r in similarity.near_clusters(spark.createDataFrame(rows, "id long, sequence string")).collect()}
    assert got == {1: (1, 2, 1, 1), 2: (1, 2, 1, 1), 3: (3, 3, 0, 2), 4: (3, 3, 0, 2), 5: (5, 5, 0, 2), 6: (5, 5, 0, 2), 7: (7, 7, 0, 1), 8: (8, 8, 0, 1)}
    assert similarity.near_clusters(spark.createDataFrame([], "id long, sequence string")).count() == 0


def test_a_common_kmer_gives_as_many_pairs_as_it_has_fragments(spark):
    """A letter run that all fragments share, and its edges that many do: candidates grow with the fragments (a k-mer has
    one centre), not with their square (44,850)."""
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(150)) + "A" * 30 + "".join(rnd.choice("ACGT") for _ in range(150)), 330) for i in range(300)]
    seeds = similarity.seeds(spark.createDataFrame(rows, "id long, s string, n int"), 21, 400)
    pairs = similarity.diagonals(seeds, 21, 32)
    assert Counter(r.right for r in pairs.collect()).most_common(1) == [(299, 299)] and pairs.count() < 10 * 300


def test_seeds_are_shuffled_once_to_their_centres(spark):
    """Frequent k-mers (all fragments have them) find their centres as the others do, and no row goes to them twice."""
    from .test_genome_identity import shuffled

    rnd = random.Random(7)
    run = "".join(rnd.choice("ACGT") for _ in range(40))
    rows = []
    for i in range(300):
        own = "".join(rnd.choice("ACGT") for _ in range(120))
        for j in range(2):
            s = own[: 60 + j] + (run if i % 2 else turned(run)) + own[60 + j :]
            rows.append((2 * i + j, s, len(s)))
    seeds = similarity.seeds(spark.createDataFrame(rows, "id long, s string, n int"), 21, 400).cache()
    plain = seeds.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    pairs = {}
    moved = shuffled(spark, lambda: pairs.update({(r.left, r.right): r for r in similarity.diagonals(seeds, 21, 32).collect()}))
    holders = defaultdict(list)
    for r in plain:
        holders[r.kmer].append((r.n, r.id))
    want = {(i, max(of)[1]) for of in holders.values() for _, i in of if i != max(of)[1]}
    assert pairs.keys() == want and max(map(len, holders.values())) == 600
    assert moved < 2.5 * len(plain), moved / len(plain)


def test_seeds_that_pair_up_are_not_joined_by_shuffles(spark):
    from .test_genome_identity import shuffled

    rnd = random.Random(3)
    base = ["".join(rnd.choice("ACGT") for _ in range(120)) for _ in range(100)]
    rows = [(2 * i + j, s[j:], 120 - j) for i, s in enumerate(base) for j in range(2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seeds = similarity.seeds(spark.createDataFrame(rows, "id long, s string, n int"), 21, 400).cache()
        n = seeds.count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        moved = shuffled(spark, lambda: similarity.diagonals(seeds, 21, 32).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved < 1.9 * n, moved / n


def test_seeds_travel_by_numbers_and_classes_have_the_names_of_ids(spark, monkeypatch):
    """Ids are long texts, in another order than their rows: numbers take their place among the seeds and keep their order."""
    rnd = random.Random(9)
    rows, want = [], {}
    for i in range(40):
        base = "".join(rnd.choice("ACGT") for _ in range(120))
        other = base[:60] + ("A" if base[60] != "A" else "C") + base[61:]
        ids = sorted(f"REC_{rnd.getrandbits(80):020x}:{rnd.randrange(9)}" for _ in range(3))
        two = rnd.sample(ids, 2)  # of one sequence; the third is near them
        rows += [(x, (base if x == two[0] else turned(base)) if x in two else other) for x in ids]
        one, third = min(two), next(x for x in ids if x not in two)
        top = max(one, third)
        want |= {x: (ids[0], top, 1, 2 if x in two else 1, one if x in two else third) for x in ids}
    rnd.shuffle(rows)
    kinds, whole = [], similarity.seeds
    monkeypatch.setattr(similarity, "seeds", lambda fragments, *given: kinds.append(fragments.schema["id"].dataType.simpleString()) or whole(fragments, *given))
    found = similarity.near_clusters(spark.createDataFrame(rows, "id string, sequence string").repartition(5)).collect()
    assert {r.id: (r["class"], r.centre, r.links, r.copies, r["first"]) for r in found} == want
    assert kinds == ["bigint"]
