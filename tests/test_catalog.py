import duckdb
import pytest

from helixlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    frame = catalog.QUERIES[name](spark, SF)
    rows = frame.collect()
    if name not in catalog.SQL:
        assert rows
        return
    cursor = con.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in names)) for r in rows)
    assert got == sorted(repr(tuple(map(norm, r))) for r in cursor.fetchall())


def test_plans_stay_native(spark):
    """No Python in the plans of relational queries, and no cartesian product of two tables."""
    import contextlib
    import io

    for name in ("flagship_shared_fragments", "f3_canonical_hash", "g1_chunk_explode", "j23_exact_fragment_edges", "a12_cross_split_overlap", "a21_logprob_aggregate", "a39_length_histogram", "w10_best_so_far"):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            catalog.QUERIES[name](spark, SF).explain("formatted")
        assert "Python" not in out.getvalue() and "CartesianProduct" not in out.getvalue(), name
