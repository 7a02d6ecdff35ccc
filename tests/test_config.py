import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixlake import config, session
from helixlake.operators import scorer


def test_merge():
    assert config.merge({"chunk_size": 100}, {"chunk_size": 50, "seed": 3}).chunk_size == 50
    with pytest.raises(ValueError):
        config.merge({"chunk": 1})
    with pytest.raises(ValueError):
        config.merge({"train": 0.5})


def test_environment(spark):
    assert session.check_environment(spark)["adaptive"]


def test_observed(spark):
    frame, watch = session.observed(spark.range(10), "seen", rows=F.count("*"), bases=F.sum("id"))
    frame.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 10, "bases": 45}


def test_scorer(spark):
    rows = spark.createDataFrame([(i, "ACGT"[i % 4] * 3 + "AC") for i in range(30)], "id int, sequence string")
    got = {r.id: r.p for r in scorer.score_batches(rows, scorer.composition_scorer, 4, keep=("id",)).collect()}
    want = scorer.composition_scorer()([r.sequence for r in rows.orderBy("id").collect()])
    assert np.allclose([got[i] for i in range(30)], want)
    with pytest.raises(PySparkException):
        scorer.score_batches(rows, scorer.composition_scorer, 4, longest=4).collect()


def test_calls_take_like_lengths_across_batches(spark):
    import random

    import numpy as np

    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 10, 30, 30, 500, 3000])))) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "id long, sequence string").coalesce(1).sortWithinPartitions("id")
    made, padded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        plain = scorer.composition_scorer()

        def model(texts):
            made.add(1)
            padded.add(len(texts) * max(map(len, texts)))
            return plain(texts)

        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    found = scorer.score_batches(df, load, 4, letters=24_000, keep=("id",)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.id for r in found] == [i for i, _ in rows]  # in the order of the rows
    one = scorer.composition_scorer()
    assert np.allclose([r.p for r in found], [one([s or ""])[0] for _, s in rows])
    letters = sum(len(s or "") for _, s in rows)
    assert made.value < 601 / 8 / 2 and padded.value < 1.2 * letters  # eight at a time: 76 calls; padding hardly adds any
    assert [c.tolist() for c in scorer.calls(np.array([5, 1, 9, 1, 100]), 10, 3)] == [[1, 3], [0], [2], [4]]
    assert scorer.calls(np.array([], int), 10, 3) == []
