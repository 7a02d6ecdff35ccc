from pyspark.sql import functions as F

from helixlake.streaming import ingest


def test_streaming(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 4).alias("source"), F.col("id").alias("header"), (F.col("id") * 3 % 17).cast("double").alias("m"), F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    path = f"{tmp_path}/in"
    rows.repartition(3).write.parquet(path)
    rows.limit(20).coalesce(1).write.mode("append").parquet(path)  # sent again
    stream = ingest.stream_parquet(spark, path)
    q = ingest.append_batches(ingest.new_records(stream, "source", "header"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 60 and out.select("record_id").distinct().count() == 60
    q = ingest.best_so_far(stream, "source", "m").writeStream.format("memory").queryName("best").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    best = {r.source: r.b for r in spark.sql("SELECT source, max(best) AS b FROM best GROUP BY source").collect()}
    assert best == {r.source: r.b for r in rows.groupBy("source").agg(F.max("m").alias("b")).collect()}
    q = ingest.windowed_counts(stream, "ts", "source").writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").columns == ["start", "source", "n"]
