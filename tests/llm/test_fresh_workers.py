"""Every operator over null texts in workers that have imported nothing for others."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]

CODE = """
import random, sys, tempfile
from pyspark.sql import SparkSession
import corpus_pipeline
from helixlake.llm import queries
spark = SparkSession.builder.master("local[4]").config("spark.python.worker.reuse", "false").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
top = tempfile.mkdtemp(prefix="fresh-")
rnd = random.Random(1)
text = lambda: " ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(30))
docs = [(i, text() if i % 5 else None, "en", "s%d" % (i % 3), 1) for i in range(60)] + [(None, None, None, None, None)]
spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(1).write.parquet(top + "/documents.parquet")
spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(50)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(top + "/labels.parquet")
spark.createDataFrame([(1, docs[1][1]), (2, None), (None, "words")], "item_id long, text string").write.parquet(top + "/benchmark.parquet")
spark.createDataFrame([(1, "u", "<p>x</p>"), (2, None, None), (None, "v", "<p>x</p>")], "page_id long, url string, html string").write.parquet(top + "/pages.parquet")
spark.createDataFrame([(1, 1, "user", None)], "conv_id long, turn int, role string, text string").write.parquet(top + "/conversations.parquet")
for name in sys.argv[1:] or [*queries.QUERIES, "pipeline"]:
    rows = (corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name])(spark, top).collect()
    assert rows, name
    print("done", name, len(rows), flush=True)
"""


def test_null_texts_in_fresh_workers():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=900)
    names = [line.split()[1] for line in done.stdout.splitlines() if line.startswith("done")]
    assert done.returncode == 0 and len(names) == 13, (names, done.stderr[-3000:])
