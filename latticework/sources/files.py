"""Small files through Hadoop's file systems, so that any path Spark can read works on the driver too."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import GraphFileNotFound


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise GraphFileNotFound(f"no such file: {path}")
    return path


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text: manifests and documents in authoring form."""
    require(spark, path)
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Write a small file, with its folders."""
    at, fs = _at(spark, path)
    fs.mkdirs(at.getParent())
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return path
