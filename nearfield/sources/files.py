"""Small files and folders of any store that Spark can open, from the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _open(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _open(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file as a whole: write beside it, then rename over it."""
    temporary, fs = _open(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temporary, True)
    stream.write(text.encode())
    stream.close()
    target, _ = _open(spark, path)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(temporary, target, options)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file as a whole; false, without a change, if it is there already."""
    temporary, fs = _open(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temporary, True)
    stream.write(text.encode())
    stream.close()
    target, _ = _open(spark, path)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(temporary, target, options)
    except Py4JJavaError:
        fs.delete(temporary, False)
        if fs.exists(target):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _open(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
