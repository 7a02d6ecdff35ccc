"""Session helpers: one place for the settings every plan relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "helixlake", master: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a new local one if driver and executors are one
    process (tests); on a cluster that is an error, as executors do not share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is then left to its owner
        pass


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared root, deleted when the driver exits."""
    path = f"{shared_root(spark)}/helixlake-{os.getpid()}/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


#: Rows of a narrow table that are worth a file of their own.
ROWS_PER_FILE = 250_000


def save(df: DataFrame, label: str, *partition_by: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    A lost executor then costs a re-read, never a recomputation of everything upstream. ``rows`` is a bound of the rows
    of a narrow table: few rows then go to few files, however many partitions the shuffle before had.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    if rows is not None:
        df = df.coalesce(rows // ROWS_PER_FILE + 1)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()

#: Python workers hold a few copies of a batch, so texts go to them in small ones.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Python code that some operators run there; and
    bound the batches they get, unless the session says how."""
    name, default, small = BATCH
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, small)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="helixlake-")) / "helixlake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))


def check_environment(spark: SparkSession) -> dict[str, object]:
    """A smoke test of what the plans rely on; raises where something is wrong."""
    import pyarrow
    from pyspark.sql import functions as F

    found = {
        "spark": spark.version,
        "arrow": pyarrow.__version__,
        "time_zone": spark.conf.get("spark.sql.session.timeZone"),
        "adaptive": spark.conf.get("spark.sql.adaptive.enabled") == "true",
        "ansi": spark.conf.get("spark.sql.ansi.enabled") == "true",
        "shared_root": shared_root(spark),
    }
    rows = spark.range(10).mapInArrow(lambda batches: batches, "id long").agg(F.sum("id")).first()[0]
    if rows != 45 or save(spark.range(3), "check").count() != 3:
        raise RuntimeError("Python workers or the shared folder do not work")
    return found


def observed(df: DataFrame, name: str, **measures):
    """The frame with statistics that come with its run: (frame, observation); observation.get after an action."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, *[c.alias(n) for n, c in measures.items()]), watch
