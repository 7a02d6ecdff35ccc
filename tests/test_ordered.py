"""Running sums, ranks, folds and slice reports against plain loops, and the shape of their plans."""

import contextlib
import hashlib
import io
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixlake.functions import numeric as N
from helixlake.operators import calibrate, evaluate, splits
from helixlake.operators.ordered import ranks, running_sums
from helixlake.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("simple")
    return out.getvalue()


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_sums(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([0.5, 0.25, rnd.random()]), i, rnd.choice([None, 1, 2, 5])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, score double, id long, n long").withColumn("_x", F.lit(7)).repartition(6)
    got = {r.id: (r.total, r.place, r._x) for r in running_sums(df, [F.col("score").desc(), F.col("id")], {"total": F.col("n"), "place": F.lit(1)}, ["k"], ranges).collect()}
    want, total, place = {}, defaultdict(int), defaultdict(int)
    for k, _, i, n in sorted(rows, key=lambda r: (-r[1], r[2])):
        total[k] += n or 0
        place[k] += 1
        want[i] = (total[k], place[k], 7)
    assert got == want
    every = {r.id: r.rank for r in ranks(df, [F.col("score"), F.col("id")], ranges=ranges).collect()}
    assert every == {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    assert ranks(df.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("name", ["a27_average_precision", "a28_bootstrap_ci", "o3_group_order", "a16_w5_vocabulary", "a29_slice_reports"])
def test_windows_are_cut_into_ranges(spark, name):
    """A window goes over the rows of one range, or over one row for each range; never over all rows or a whole class."""
    windows = re.findall(r"Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", plan(catalog.QUERIES[name](spark, SF)))
    for by, order in windows:
        assert "_range#" in by or order.startswith("_range#"), (by, order)
    if name in ("a27_average_precision", "o3_group_order", "a16_w5_vocabulary"):
        assert windows


def test_ranges_share_a_hot_class(spark):
    """All rows are of one class: they lie in all ranges."""
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.rand(3).alias("s"))
    placed = running_sums(df, [F.col("s")], {"n": F.lit(1)}, ["k"], 10)
    sizes = [r["count"] for r in placed.select(((F.col("n") - 1) / 2000).cast("int").alias("g")).groupBy("g").count().collect()]
    assert sizes == [2000] * 10


def test_vectors_are_evaluated_once(spark):
    """An argument that takes work appears once in the plan, bound to a variable that each element refers to."""
    x = F.transform("a", lambda v: F.sqrt(v))
    df = spark.createDataFrame([([1.0, 4.0, 9.0],), (None,), ([],)], "a array<double>")
    for f in (N.softmax, N.argmax, lambda c: N.temperature(c, 2.0), lambda c: N.undo_temperature(c, 2.0)):
        assert plan(df.select(f(x).alias("y"))).count("SQRT(") == 1
    got = [r.y for r in df.select(N.softmax(x).alias("y")).collect()]
    assert got[1] is None and got[2] == [] and abs(sum(got[0]) - 1) < 1e-12 and got[0][2] / got[0][1] == pytest.approx(2.718281828, rel=1e-9)


def test_bootstrap_without_two_groups(spark):
    df = spark.createDataFrame([(0, 0, "g"), (1, 0, "g"), (1, 1, "g")], "truth int, predicted int, split_group string")
    for frame, repeats, groups in ((df, 50, 1), (df.limit(0), 50, 0), (df.unionByName(df.withColumn("split_group", F.lit("h"))), 0, 2)):
        row = evaluate.bootstrap_hashed(frame, 2, repeats).first()
        assert (row.low, row.high, row.groups) == (None, None, groups)


def fold(rows, ratios, seed):
    out = {}
    tie = lambda *x: hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()
    for stratum in {r[3:] for r in rows}:
        part = [r for r in rows if r[3:] == stratum]
        goal = {s: (max(sum(r[1] for r in part) * q, 1), max(sum(r[2] for r in part) * q, 1)) for s, q in ratios.items()}
        used = {s: [0, 0] for s in ratios}
        for g, b, n, *_ in sorted(part, key=lambda r: (-r[1], tie(seed, r[0], "order"))):
            best = min(ratios, key=lambda s: ((used[s][0] + b) / goal[s][0] + (used[s][1] + n) / goal[s][1], tie(seed, g, s), s))  # noqa: B023
            used[best][0] += b
            used[best][1] += n
            out[g] = best
    return out


def test_allocation_streams_sorted_rows(spark):
    """Strata of one row and of most rows, null strata, many equal sizes; rows reach Python in batches, not as groups."""
    rnd = random.Random(8)
    rows = [(i, rnd.choice([10, 10, rnd.randint(1, 1000)]), rnd.randint(1, 4), rnd.choice(["big"] * 20 + ["a", "b", None]), rnd.choice([0, 1, None])) for i in range(1500)] + [(9999, 5, 1, "alone", 0)]
    stats = spark.createDataFrame(rows, "component long, bases long, genomes long, main_source string, main_label int").repartition(5)
    for seed in (0, 3):
        frame = splits.allocate(stats, seed=seed)
        assert {r.component: r.split for r in frame.collect()} == fold(rows, splits.RATIOS, seed)
        assert "MapInArrow" in plan(frame) and "FlatMapGroups" not in plan(frame)


def replay(epochs, checkpoint):
    kept = []
    for i, e in enumerate(epochs):
        kept = [x for x in kept if x[1] <= e]
        if all(x[1] != e for x in kept):
            kept.append((i, e))
    return [x for x in kept if x[1] <= checkpoint]


def test_history_repair(spark):
    rnd = random.Random(2)
    runs = {f"r{i}": [rnd.randint(1, 12) / 10 for _ in range(rnd.randint(1, 40))] for i in range(60)}
    rows = [(k, i, e, "x") for k, epochs in runs.items() for i, e in enumerate(epochs)]
    df = spark.createDataFrame(rows, "run string, pos int, epoch double, _e string").withColumnRenamed("_e", "note").repartition(5)
    got = defaultdict(list)
    for r in calibrate.repair_history(df, 0.9).orderBy("pos").collect():
        got[r.run].append((r.pos, r.epoch))
    assert got == {k: v for k, e in runs.items() if (v := replay(e, 0.9))}


def test_history_of_one_long_run(spark):
    long = spark.range(200_000).select(F.lit("r").alias("run"), F.col("id").alias("pos"), (F.col("id") % 5000 / 10).alias("epoch"))
    began = time.perf_counter()
    assert calibrate.repair_history(long, 1e9).count() == 5000
    assert time.perf_counter() - began < 20


def test_slice_reports_equal_each_slice_alone(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        p = [rnd.random() for _ in range(3)]
        rows.append((rnd.choice(["chunk", "genome"]), rnd.choice(["s0", "s1", None, 'q"x']), rnd.choice([0, 0, 1]), [x / sum(p) for x in p], rnd.choice([100, 600, 9000])))
    levels = spark.createDataFrame(rows, "level string, source string, truth int, p array<double>, valid_length int")
    reports = evaluate.slice_reports(levels, 3).cache()
    got = {(r.level, r.kind, r.slice, r.metric, r["class"], r.other): r.value for r in reports.collect()}
    assert len(got) == reports.count()
    one = evaluate.scored(levels.filter("level = 'chunk' AND source = 's1'"))
    each = evaluate.class_metrics(evaluate.confusion(one, 3))
    top = evaluate.summary(each).first()
    for m in ("n", "macro_f1", "balanced_accuracy", "accuracy"):
        assert got["chunk", "source", "s1", m, None, None] == pytest.approx(top[m], abs=1e-12)
    assert got["chunk", "source", "s1", "ece", None, None] == pytest.approx(evaluate.ece(evaluate.reliability(one)).first().ece, abs=1e-12)
    for r in each.collect():
        for m in ("precision", "recall", "f1", "support"):
            assert got["chunk", "source", "s1", m, r["class"], None] == pytest.approx(r[m], abs=1e-12)
    for c in range(3):
        curve = evaluate.precision_recall(one, F.get("p", F.lit(c)), F.col("truth") == c)
        ap = evaluate.average_precision(curve).first()
        for m in ("average_precision", "pr_auc"):
            assert got["chunk", "source", "s1", m, c, None] == (pytest.approx(ap[m], abs=1e-12) if ap[m] is not None else None)
    assert got["chunk", "all", "", "average_precision", 2, None] is None  # no row of class 2
    assert {k[2] for k in got if k[1] == "source"} == {"s0", "s1", "", 'q"x'} and {k[2] for k in got if k[1] == "band"} == {"<500", "500-4999", ">=5000"}
    import json

    documents = {r.level: json.loads(r.document) for r in evaluate.metric_documents(reports).collect()}
    chunk = documents["chunk"]
    assert set(documents) == {"chunk", "genome"} and set(chunk["by_source"]) == {"s0", "s1", "", 'q"x'}
    assert chunk["by_source"]["s1"]["classes"]["0"]["f1"] == got["chunk", "source", "s1", "f1", 0, None] and chunk["classes"]["2"]["average_precision"] is None
    assert chunk["by_band"]["<500"]["confusion_matrix"][0] == [got["chunk", "band", "<500", "confusion", 0, c] for c in range(3)]
    assert [b["count"] for b in chunk["reliability"]] == [got["chunk", "all", "", "reliability_count", None, b["bin"]] for b in chunk["reliability"]]
