"""A few operations on any file system that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/chronofold/{name}-{uuid.uuid4().hex}"
    p, fs = _open(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _open(spark, path)
    return fs.exists(p)


def is_dir(spark: SparkSession, path: str) -> bool:
    p, fs = _open(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, sorted."""
    p, fs = _open(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in fs.globStatus(p) or [])


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _open(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    p, fs = _open(spark, source)
    t = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(t.getParent())
    if not fs.rename(p, t):
        raise OSError(f"{source} could not be moved to {target}")


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _open(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Whether the file was written; without ``overwrite`` an existing file stays."""
    p, fs = _open(spark, path)
    try:
        stream = fs.create(p, overwrite)
    except Exception:
        if not overwrite and fs.exists(p):
            return False
        raise
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return True
