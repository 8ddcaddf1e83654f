"""Small files and folders in any store that Spark reads: existence, text files that appear at once, digests of data."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Damaged(ValueError):
    """The store finds a file's bytes not to be those that were written."""


def _at(path: str):
    """The store's file system and the path in its own terms."""
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    fs, where = _at(path)
    return fs.exists(where)


def make_folder(path: str) -> None:
    fs, where = _at(path)
    fs.mkdirs(where)


def remove(path: str) -> None:
    """A file or a whole folder; nothing if it is not there."""
    fs, where = _at(path)
    fs.delete(where, True)


def read_text(path: str) -> str:
    """A small file; OSError if it is not there, Damaged if the store refuses to read it."""
    fs, where = _at(path)
    if not fs.exists(where):
        raise OSError(f"{path} is not there")
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    except Py4JError as e:
        raise Damaged(path) from e
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Written under another name and renamed, so that nobody sees a part of it."""
    fs, where = _at(path)
    _, pending = _at(f"{path}.pending")
    out = fs.create(pending, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(pending, where):
        raise OSError(f"{path} could not be put in place")


def data_files(path: str) -> dict[str, tuple[str, int]]:
    """Each Parquet file below a folder, by its path in it: SHA-256 and bytes, worked out where the files lie."""
    spark = SparkSession.active()
    fs, where = _at(path)
    root = fs.resolvePath(where).toUri().getPath()
    rows = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(path)
    digests = rows.select("path", F.sha2("content", 256).alias("digest"), "length").collect()  # a row for each file
    return {spark._jvm.org.apache.hadoop.fs.Path(r["path"]).toUri().getPath().removeprefix(root).lstrip("/"): (r["digest"], r["length"]) for r in digests}
