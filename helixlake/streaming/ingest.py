"""Structured Streaming: records that arrive over time, each kept once, and running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import sequence as S


def stream_parquet(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_records(stream: DataFrame, source: str, header: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Records by stable id, each once; with an event time the state is bounded by a watermark."""
    named = stream.withColumn("record_id", S.stable_id(F.col(source), F.col(header), prefix="REC_"))
    if event_time:
        return named.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["record_id"])
    return named.dropDuplicates(["record_id"])


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def best_so_far(stream: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, best, updates): the highest metric of each key so far, kept in custom state."""

    def update(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, n = state.get if state.exists else (float("-inf"), 0)
        for batch in batches:
            best, n = max(best, float(batch[metric].max())), n + len(batch)
        state.update((best, n))
        yield pd.DataFrame({key: [name[0]], "best": [best], "updates": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, best double, updates long", "best double, updates long", "update", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, appended exactly once to a table."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
