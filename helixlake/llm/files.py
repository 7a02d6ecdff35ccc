"""Whole files written by executors into a shared folder, and read back by Spark."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(folder: str, name: str, data: bytes) -> None:
    """Publish a file at once, under a name that no other attempt of a task uses."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    part = f"{root}/.{name}.{os.getpid()}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")


def get(folder: str, name: str) -> bytes:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as found:
        return found.read()


def create(folder: str) -> str:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return folder


def contents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(file, content) of the files that the manifest lists; others, left by lost attempts, are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file"), "file", "left_semi")
