"""What the jobs share: settings from a config file, the log, and session settings that are put back."""

from __future__ import annotations

import json
import logging
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("helixlake.jobs")


def settings(defaults: dict[str, Any], given: dict[str, Any] | None) -> dict[str, Any]:
    """The given settings over the defaults; unknown names and other kinds are errors."""
    given = given or {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    wrong = [k for k, v in given.items() if not isinstance(v, (int, float) if isinstance(defaults[k], float) else type(defaults[k]))]
    if wrong:
        raise ValueError(f"settings of another kind: {', '.join(sorted(wrong))}")
    return {**defaults, **given}


def read_config(path: str) -> dict[str, Any]:
    return json.loads(Path(path).read_text())


@contextmanager
def kept(spark: SparkSession, *names: str):
    """Put the named session settings back as they were."""
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace exactly the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def draw(sha256_hex: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(sha256_hex, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def drawn_split(sha256_hex: Column, train: float, validation: float) -> Column:
    at = draw(sha256_hex)
    return F.when(at < train, "train").when(at < train + validation, "validation").otherwise("inference")
