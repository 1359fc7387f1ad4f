"""Small files at any path Spark can reach: read, put in one step, remove."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, None if there is none."""
    target, fs = _at(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str, *options: str) -> None:
    """Write the content beside the path, then give it its name in one step."""
    jvm, fresh = spark._jvm.org.apache.hadoop.fs, f"{path}.{uuid.uuid4().hex}.tmp"
    source, fs = _at(spark, fresh)
    stream = fs.create(source, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    kind = getattr(jvm, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, len(options))
    for at, option in enumerate(options):
        how[at] = getattr(kind, option)
    target = jvm.Path(path)
    # Unlike FileSystem.rename, this says what happens if the target exists.
    context = jvm.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(source), context.makeQualified(target), how)
    except Exception:
        fs.delete(source, False)
        raise


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that must not exist yet; fails if another writer was first."""
    _put(spark, path, text, "NONE")


def switch_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file in one step: readers see the old content or the new one, never a part."""
    _put(spark, path, text, "OVERWRITE")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, none if there is no such folder."""
    target, fs = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds."""
    target, fs = _at(spark, path)
    fs.delete(target, True)
