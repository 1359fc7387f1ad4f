"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources import files

#: Of stored tables and steps; a third smaller than Spark's default.
COMPRESSION = "zstd"

_local_roots: dict[str, str] = {}
_ending: set[str] = set()
_shipped: set[str] = set()


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("souk")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python call site of every expression costs more than small plans take.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def workspace(spark: SparkSession) -> str:
    """Folder, visible to all executors, for tables this application writes, removed when it ends.

    It lies below ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because on a cluster executors could not read each other's.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="souk-")
        root = _local_roots[app]
    path = f"{root.rstrip('/')}/souk/{app}"
    if app not in _ending:
        _ending.add(app)
        atexit.register(_remove_steps, spark, path)
    return path


def _remove_steps(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may have stopped; what it could not remove stays
        if spark.sparkContext._jsc is not None:
            files.remove(spark, f"{path}/steps")


def release(settled: DataFrame) -> None:
    """Remove the copy of a settled frame that no plan will read again."""
    files.remove(settled.sparkSession, settled._souk_path)


def released(*settled: DataFrame) -> None:
    for one in settled:
        release(one)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    On its own it does so when the driver happens to collect its garbage, which a job of few objects may not need until its end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for functions that run in Python workers.

    The archive is made beside the driver; Spark hands it out. Nothing is sent if the package came in an archive itself.
    """
    app, package = spark.sparkContext.applicationId, os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(package):
        return
    _shipped.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="souk-"), "souk.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    inside = os.path.join("souk", os.path.relpath(os.path.join(folder, name), package))
                    archive.write(os.path.join(folder, name), inside)
    spark.sparkContext.addPyFile(path)


def size_shuffles(spark: SparkSession, folder: str, partition_bytes: int = 128 * 1024 * 1024) -> int:
    """Raise the number of shuffle partitions to fit the files below ``folder``.

    Adaptive execution starts every shuffle from this number and merges what turns out
    small, so it has to suit the largest table. Only file sizes are read here, no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    total = files.agg(F.sum("length")).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / partition_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return wanted


#: Stored or shuffled bytes one task may read, and input bytes per shuffle partition: rows take ten times as much in a sort.
SPLIT = 32 * 1024 * 1024
SHARE = 16 * 1024 * 1024


def bound_tasks(spark: SparkSession, folder: str) -> None:
    """Let the number of tasks grow with the files below ``folder``, so that no task sorts more on larger input.

    The default splits are so large that a sort ahead of a shuffle, as aggregates of text need, does not fit a task's share of memory.
    """
    size_shuffles(spark, folder, SHARE)
    # Adaptive execution merges shuffle partitions up to the second size; a join of several sides sorts each of them in one task.
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > SPLIT:
            spark.conf.set(name, str(SPLIT))


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a frame to the workspace and read it back, so later uses share one result.

    Unlike a cache, the written copy survives the loss of executors.
    """
    path = f"{workspace(df.sparkSession)}/steps/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled._souk_path = path
    return settled
