"""Model versions below a root, and the pointer to the one in use.

A version is saved whole before the pointer names it. The pointer is a file that is written beside and renamed over
the old one, which is atomic on HDFS and local disks: a reader finds the old version or the new one, and a job
that dies in between leaves the old one in use. (An object store without atomic renames needs a file system layer that has them.)
"""

import uuid

from pyspark.sql import SparkSession

CURRENT = "current"


def version_path(root: str, version: str) -> str:
    return f"{root}/versions/{version}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all, replacing one that is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs
    target, beside = files.Path(path), files.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(files, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = files.FileContext.getFileContext(target.getFileSystem(conf).makeQualified(target).toUri(), conf)
    context.rename(beside, target, options)


def get_text(spark: SparkSession, path: str) -> str | None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def promote(spark: SparkSession, root: str, version: str) -> None:
    """Put a saved version in use."""
    put_text(spark, f"{root}/{CURRENT}", version)


def current(spark: SparkSession, root: str) -> str | None:
    return get_text(spark, f"{root}/{CURRENT}")
