import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gämma", "delta", "x1", "the", "of", "and", "über", "zeta"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(n))
    base = [text(rnd.randint(1, 60)) for _ in range(40)]
    rows = [(i, x, "en", f"s{i % 3}", len(x)) for i, x in enumerate(base)]
    long = text(6000)
    rows += [
        (100, None, None, None, None), (101, "", "en", "s1", 0), (102, "   \n\t ", "en", None, 5), (103, base[0], "en", "s0", 1),
        (104, base[0].replace(" ", "  "), "en", "s2", 1), (105, long, "de", "s1", 1), (106, long + " end", "de", "s1", 1), (107, "word", "en", "s0", 4),
        (108, "日本語 ", "ja", "s0", 4), (108, "日本語 ", "ja", "s0", 4), (None, base[1], "en", "s0", 1), (None, "lonely text here", "en", None, 1), (109, base[2] + " one more", "en", "s2", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    from pyspark.sql import functions as F

    # extra columns whose names clash with those that operators make inside
    return spark.createDataFrame(edge_rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("n", F.lit(1)).withColumn("size", F.lit(2)).withColumn("target", F.lit(0)).withColumn("level", F.lit(0)).withColumn("copies", F.lit(9)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
