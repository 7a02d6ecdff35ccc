import hashlib
import json
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import build_dataset, common, ingest_fragments, queries

ROOT = Path(__file__).parents[1]
SF = "/root/testdata/sf0.001"


def sql(text: str, **tables: str):
    c = duckdb.connect()
    for name, path in tables.items():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cursor = c.execute(text)
    return [d[0] for d in cursor.description], cursor.fetchall()


def rows(frame, names) -> Counter:
    return Counter(repr(tuple(r[n] for n in names)) for r in frame.collect())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_job_equals_its_sql(spark, name):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None), spark.conf.get("spark.sql.sources.partitionOverwriteMode", None)
    frame = queries.QUERIES[name](spark, SF)
    names, want = sql(queries.SQL[name], documents=f"{SF}/documents.parquet", labels=f"{SF}/labels.parquet")
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame, names) == Counter(repr(r) for r in want)
    assert before == (spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None), spark.conf.get("spark.sql.sources.partitionOverwriteMode", None))


# ---- incremental ------------------------------------------------------------------------------------------------


def documents(n: int, seed: int = 4) -> list[tuple]:
    """Texts with shared passages, copies, nulls and empty ones; extra columns are for the reader to leave out."""
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcdefgh ") for _ in range(20)) for _ in range(6)]
    out = []
    for i in range(n):
        text = "".join(rnd.choice(shared) for _ in range(rnd.randint(0, 6))) + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 9)))
        out.append((i, text, f"s{i % 3}", "clash"))
    out += [(n, None, "s0", None), (n + 1, "", None, "x"), (n + 2, out[5][1], "s9", "x"), (n + 3, out[5][1], None, "x"), (n + 4, out[7][1] + "é𐐀" * 30, None, None), (None, shared[0] + "null id", "s1", "x")]
    return out


CONFIG = {"fragment_size": 20, "minimum_tail": 5, "train": 0.5, "validation": 0.3}


def cut(text: str, size: int, tail: int) -> list[tuple[int, int]]:
    n, rest = len(text), len(text) % size
    if n > size and 0 < rest < tail:
        a = n - rest - size
        return [(i, i + size) for i in range(0, a, size)] + [(a, a + (size + rest) // 2), (a + (size + rest) // 2, n)]
    return [(i, min(n, i + size)) for i in range(0, n, size)]


def ingested(batches: list[list[tuple]]) -> list[tuple]:
    """Plain loops: (batch, record id, source, start, end, text, split, status)."""
    texts, owners, out = set(), {}, []
    first = lambda x: (x[0] is not None, x[0] or 0)
    for number, batch in enumerate(batches):
        mine = []
        for key, text, source, _ in sorted(batch, key=lambda x: (first(x), x[2] is not None, x[2] or "")):
            if text and text not in texts:
                texts.add(text)
                at = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16) / 2**32
                mine.append((key, source, text, "train" if at < 0.5 else "validation" if at < 0.8 else "inference"))
        for key, source, text, split in mine:
            for a, z in cut(text, 20, 5):
                owner = owners.setdefault(text[a:z], split)
                out.append((number, key, source, a, z, text[a:z], split, "kept" if owner == split else "leak"))
    return out


@pytest.fixture
def growing(spark, tmp_path):
    schema = "doc_id long, text string, source string, status string"

    def add(part: list[tuple]) -> None:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    return add, lambda: ingest_fragments.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", CONFIG), f"{tmp_path}/out"


NAMES = ("batch", "record_id", "source", "start", "end", "text", "split", "status")


def test_ingest_takes_only_what_is_new(spark, growing):
    add, run, out = growing
    every = documents(60)
    batches = [every[:25], every[25:27], [(900, None, None, None)], every[20:] + every[:3]]
    for n, batch in enumerate(batches, 1):
        add(batch)
        assert run() == 1 and run() == 0  # a second run finds nothing new
        found = ingest_fragments.fragments(spark, out)
        assert rows(found, NAMES) == Counter(repr(x) for x in ingested(batches[:n]))
    kept = found.filter("status = 'kept'")
    assert kept.groupBy("hash").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert found.filter("status = 'leak'").count() > 0
    log = {r.batch: (r["rows"], r.records, r.fragments, r.leaks) for r in spark.read.parquet(f"{out}/log").collect()}
    want = ingested(batches)
    assert log == {n: (len(b), len({x[1] for x in want if x[0] == n}), sum(x[0] == n for x in want), sum(x[0] == n and x[-1] == "leak" for x in want)) for n, b in enumerate(batches)}
    assert {r.text_sha256 for r in spark.read.parquet(f"{out}/records").collect()} == {hashlib.sha256(t.encode()).hexdigest() for _, t, _, _ in every if t}


def test_a_batch_that_is_repeated_replaces_itself(spark, growing, monkeypatch):
    """The run fails after the batch's records are written; the next one takes the same batch again."""
    add, run, out = growing
    every = documents(40)
    add(every[:20])
    run()
    add(every[20:])
    whole = ingest_fragments.write_partitions

    def stop(df, path, *by):
        if path.endswith("/log"):
            raise OSError("lost")
        whole(df, path, *by)

    monkeypatch.setattr(ingest_fragments, "write_partitions", stop)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(ingest_fragments, "write_partitions", whole)
    assert run() == 1
    assert rows(ingest_fragments.fragments(spark, out), NAMES) == Counter(repr(x) for x in ingested([every[:20], every[20:]]))
    assert spark.read.parquet(f"{out}/records").groupBy("text_sha256").count().filter("count > 1").count() == 0


def test_ingest_of_an_empty_table(spark, growing):
    add, run, out = growing
    add([])
    assert run() <= 1
    add(documents(10))
    assert run() == 1 and ingest_fragments.fragments(spark, out).count() > 0


# ---- whole table ------------------------------------------------------------------------------------------------


def test_build_takes_odd_rows_and_keeps_what_is_current(spark, tmp_path):
    every = [r for r in documents(60) if r[0] is not None]
    every += [every[3], every[3], (None, "no id here", "s1", "x"), (None, "nor here", "s1", "x")]
    labels = [(i, i % 2) for i in range(0, 50)] + [(3, None), (4, 1), (4, 0), (None, 1)]
    spark.createDataFrame(every, "doc_id long, text string, source string, status string").write.parquet(f"{tmp_path}/records")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("clash")).write.parquet(f"{tmp_path}/labels")
    config = {"fragment_size": 20, "minimum_tail": 5}
    run = lambda **more: build_dataset.run(spark, f"{tmp_path}/records", f"{tmp_path}/labels", f"{tmp_path}/out", config | more)
    assert run() and not run()
    read = lambda n: spark.read.parquet(f"{tmp_path}/out/{n}")
    first = rows(read("chunks"), read("chunks").columns)
    chunks, gone = read("chunks").collect(), {r.record_id for r in read("quarantine").collect()}
    split = {r.record_id: (r.split, r.split_group) for r in chunks}
    assert None in gone and not gone & set(split)
    assert set(split) | gone == {r[0] for r in every if r[1]} | {None}
    for r in chunks:  # each piece is where it says, and pieces tile their records
        text = next(x[1] for x in every if x[0] == r.record_id)
        assert text[r.start : r.end] == r.text and r.sample_weight == (r.end - r.start) / len(text) and (r.split, r.split_group) == split[r.record_id]
    assert Counter(r.record_id for r in chunks) == Counter({x[0]: len(cut(x[1], 20, 5)) for x in every if x[0] in split})
    for key in ("hash", "split_group"):
        assert read("chunks").groupBy(key).agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r.name for r in read("lineage").collect()} == {"input records", "input labels", "settings", "chunks", "quarantine", "groups"}
    read("groups").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/other")
    spark.read.parquet(f"{tmp_path}/other").write.mode("overwrite").parquet(f"{tmp_path}/out/groups")  # a table that is not what was written
    assert run() and rows(read("chunks"), read("chunks").columns) == first and not run()
    assert run(seed=1) and run()  # other settings make other tables, and the first ones come back
    assert rows(read("chunks"), read("chunks").columns) == first


def test_only_fragments_that_others_have_meet(spark, tmp_path, monkeypatch):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "s") for i in range(30)]
    texts += [(100 + i, texts[i][1], "s") for i in range(3)] + [texts[5]]  # three copies, and a row twice
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/records")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    given, whole = [], build_dataset.similarity.exact_edges
    monkeypatch.setattr(build_dataset.similarity, "exact_edges", lambda fragments, *more: given.append(fragments.count()) or whole(fragments, *more))
    assert build_dataset.run(spark, f"{tmp_path}/records", f"{tmp_path}/labels", f"{tmp_path}/out", {"fragment_size": 20, "minimum_tail": 5})
    held = Counter(text[a:z] for text in dict((i, text) for i, text, _ in texts).values() for a, z in cut(text, 20, 5))
    assert given == [sum(n for n in held.values() if n > 1)] and 0 < given[0] < sum(held.values()) / 2


def test_build_from_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/records")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    run = lambda: build_dataset.run(spark, f"{tmp_path}/records", f"{tmp_path}/labels", f"{tmp_path}/out")
    assert run() and not run()
    assert {r.name: r["rows"] for r in spark.read.parquet(f"{tmp_path}/out/lineage").collect()} == {"input records": 0, "input labels": 0, "settings": 0, "chunks": 0, "quarantine": 0, "groups": 0}


def test_build_refuses_one_id_of_two_texts(spark, tmp_path):
    spark.createDataFrame([(1, "one", "s"), (1, "two", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/records")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    with pytest.raises(Exception, match="two texts have the id 1"):
        build_dataset.run(spark, f"{tmp_path}/records", f"{tmp_path}/labels", f"{tmp_path}/out")


# ---- settings and command line ----------------------------------------------------------------------------------


def test_settings():
    assert common.settings({"a": 1, "b": 0.5}, {"b": 1}) == {"a": 1, "b": 1}
    for wrong in ({"c": 1}, {"a": "x"}):
        with pytest.raises(ValueError):
            common.settings({"a": 1, "b": 0.5}, wrong)
    for job in (ingest_fragments, build_dataset):
        assert json.loads((ROOT / f"jobs/{job.__name__.split('.')[-1]}.json").read_text()) == job.DEFAULTS


@pytest.mark.parametrize("job, inputs, table, said", [("ingest_fragments", ("input",), "fragments", "batch 0 of"), ("build_dataset", ("records", "labels"), "chunks", "wrote")])
def test_command_line(spark, tmp_path, job, inputs, table, said):
    """The config file, the log of what is read and written, and a second run that changes nothing."""
    spark.createDataFrame([r for r in documents(20) if r[0] is not None], "doc_id long, text string, source string, status string").coalesce(1).write.parquet(f"{tmp_path}/{inputs[0]}")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    names = [*inputs, "output", *(["checkpoint"] if job == "ingest_fragments" else [])]
    call = [sys.executable, "-m", f"jobs.{job}", "--master", "local[2]", "--config", str(ROOT / f"jobs/{job}.json"), *(x for n in names for x in (f"--{n}", f"{tmp_path}/{n}"))]
    seen = []
    for text in (said, "nothing new" if job == "ingest_fragments" else "up to date"):
        done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and text in done.stderr, done.stderr[-2000:]
        seen.append(sorted(map(repr, spark.read.parquet(f"{tmp_path}/output/{table}").collect())))
    assert seen[0] == seen[1] and seen[0]
