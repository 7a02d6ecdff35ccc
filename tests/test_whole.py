"""Queries that must take the whole of their tables."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from helixlake.config import Settings
from helixlake.operators import audit, evaluate
from helixlake.plans import catalog

SF = "/root/testdata/sf0.001"


def test_near_duplicates_take_every_part(spark, tmp_path):
    rnd = random.Random(5)
    names = [(i, "".join(rnd.choice("abcdefgh") for _ in range(12))) for i in [0, *range(281, 321)]]
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    keyed = catalog.dna(catalog._Tables(spark, str(tmp_path)), F.concat("p_partkey", "p_name"))
    rows = [(r["id"], r["sequence"]) for r in catalog.mutants(keyed).collect()]
    assert len({i for i, _ in rows}) == 2 * len(names)
    turned = [(i, s[::-1].translate(str.maketrans("ACGT", "TGCA"))) for i, s in rows]
    want = set()
    for i, x in rows:
        for (j, y), (_, z) in zip(rows, turned, strict=True):
            if i < j and min(duckdb.execute("SELECT levenshtein(?, ?), levenshtein(?, ?)", [x, y, x, z]).fetchall()[0]) <= 0.05 * max(len(x), len(y)):
                want.add((i, j))
    found = {r["id"]: r["class"] for r in catalog.QUERIES["j22_near_duplicates"](spark, str(tmp_path)).collect()}
    assert len(found) == 3 * len(names) and all(found[i] == found[i + catalog.FAR] for i, _ in rows if i % 2 == 0)
    got = {(i, j) for i, _ in rows for j, _ in rows if i < j and found[i] == found[j]}
    assert len(want) >= len(names) and got == want


def union_find(edges):
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in list(up)}


def test_components_take_every_order(spark):
    orders = duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{SF}/orders.parquet'").fetchall()
    edges = [(c, c + 1000000 + o % 40) for o, c in orders]
    want = union_find(edges)
    assert {r["node"]: r["component"] for r in catalog.QUERIES["h1_components"](spark, SF).collect()} == want
    alone = [(c, c) for (c,) in duckdb.sql(f"SELECT c_custkey FROM '{SF}/customer.parquet'").fetchall()]
    sizes = Counter(union_find(edges + alone).values())
    assert {r["component"]: r["n"] for r in catalog.QUERIES["h2_components_with_vertices"](spark, SF).collect()} == sizes


def test_host_match_counts_every_order(spark):
    rows = catalog.QUERIES["j3_j4_host_match"](spark, SF).filter("match_type = 'exact_assembly_accession'").collect()
    want = duckdb.sql(f"SELECT count(*) FROM '{SF}/orders.parquet' JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey").fetchall()[0][0]
    assert sum(r["matching_viral_records"] for r in rows) == want


def test_crosstab_has_every_language(spark):
    rows = catalog.QUERIES["a35_crosstab"](spark, SF).collect()
    langs = {x for (x,) in duckdb.sql(f"SELECT DISTINCT lang FROM '{SF}/documents.parquet'").fetchall()}
    assert {r["lang"] for r in rows} == langs and len(langs) > 3 and len(rows) == len({r["split"] for r in rows}) * len(langs)


def test_crosstab_rows_fills_zeros_and_keeps_nulls(spark):
    rows = spark.createDataFrame([("a", "x", "g1"), ("a", "x", "g1"), ("a", "y", "g2"), ("b", None, "g3")], "s string, c string, g string")
    got = {(r["s"], r["c"]): r["genomes"] for r in audit.crosstab_rows(rows, "s", "c", "g").collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 1, ("a", None): 0, ("b", "x"): 0, ("b", "y"): 0, ("b", None): 1}


def test_report_has_every_row_in_order(spark):
    rows = [tuple(r) for r in catalog.QUERIES["o2_report_order"](spark, SF).collect()]
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{SF}/customer.parquet'").fetchall()[0][0] > 30
    assert rows == sorted(rows)


def test_bootstrap_takes_the_replicates_of_the_settings(spark, monkeypatch):
    seen = []
    plain = evaluate.bootstrap_hashed
    monkeypatch.setattr(evaluate, "bootstrap_hashed", lambda frame, classes, repeats, seed: seen.append(repeats) or plain(frame, classes, repeats, seed))
    assert catalog.QUERIES["a28_bootstrap_ci"](spark, SF).first()["low"] > 0
    assert seen == [Settings().bootstrap_repeats] == [200]


def test_stand_ins_give_rows(spark):
    for name in ("j3_host_overlap", "j24_cross_label_records", "a13_chunk_label_conflicts", "p12_unseen_taxa", "p10_shared_split"):
        assert catalog.QUERIES[name](spark, SF).count() > 0, name


def test_host_overlap_counts_all_fragments(spark, tmp_path):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b, c = text(500), text(500), text(300)
    docs = [(1, text(500) + b, "s"), (2, a + b + c, "t"), (3, a + b + c, "t"), (4, text(700), "s"), (5, c, "u"), (6, None, "s"), (7, a, None)]
    spark.createDataFrame([(i, x, "en", s) for i, x, s in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {tuple(r) for r in catalog.QUERIES["j3_host_overlap"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 2), (2, 2, 2), (3, 2, 2), (5, 1, 2)}
