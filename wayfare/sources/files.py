"""Folders and files of whatever store Spark reads: listing, signatures, renaming, deleting.

Everything goes through Hadoop's ``FileSystem`` of the session, so a path may
lie in any store that Spark reaches; only names, sizes and times come to the
driver, never data.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    name: str
    path: str
    is_folder: bool


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def entries(spark: SparkSession, folder: str) -> list[Entry]:
    """What lies directly in ``folder``, by name; nothing if there is no such folder."""
    p, fs = _path(spark, folder)
    if not fs.exists(p):
        return []
    found = [Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p)]
    return sorted(found)


def signature(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of all files under ``path``: another one means that something was written."""
    p, fs = _path(spark, path)
    found = []
    if fs.exists(p):
        files = fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.md5(repr(sorted(found)).encode()).hexdigest()


def create_new(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if it is there already."""
    p, fs = _path(spark, path)
    return fs.createNewFile(p)


def rename(spark: SparkSession, old: str, new: str) -> None:
    p, fs = _path(spark, old)
    q, _ = _path(spark, new)
    if not fs.rename(p, q):
        raise OSError(f"could not rename {old} to {new}")


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)
