"""Folders of JSON lines that change by files: a change writes only the files whose rows change, and a reader keeps the files it began with.

A version is a list of file names under ``_snapshots/<n>`` in the folder; a folder without one is version 0, all files
that lie in it. New files go to ``_versions/<n>``, which a plain scan of the folder does not see. A file, once written,
is never written again. A version is there as soon as its list has the ``_SUCCESS`` that Spark puts last; a writer first
creates ``_snapshots/<n>.claim``, which only one can, so of two that began with the same version the second gets a
:class:`Conflict` and no change is lost. The lists are as long as the index of files that Spark's own scan keeps on the driver.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS, FILES = "_snapshots", "_versions"


class Conflict(RuntimeError):
    """Another writer has claimed the next version."""


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def _name(uri: str) -> str:
    """A path as Spark takes it, of one that it gives: local ones come with one slash or three."""
    return re.sub("^file:/+", "file:/", unquote(uri))


def _names(spark: SparkSession, path: str) -> list[str]:
    store, where = _at(spark, path)
    return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions whose lists are whole, oldest first, without version 0."""
    found = sorted(int(n) for n in _names(spark, f"{folder}/{LISTS}") if n.isdigit())
    return [n for n in found if exists(spark, f"{folder}/{LISTS}/{n}/_SUCCESS")]


def latest(spark: SparkSession, folder: str) -> int:
    return max(versions(spark, folder), default=0)


def listed(spark: SparkSession, folder: str, version: int | None = None) -> list[str]:
    """The files of a version, the latest unless one is named."""
    version = latest(spark, folder) if version is None else version
    if version:
        return sorted(r["value"] for r in spark.read.text(f"{folder}/{LISTS}/{version}").collect())
    return sorted(map(_name, spark.read.schema("value string").text(folder).inputFiles()))


def scan(spark: SparkSession, folder: str, schema: str, version: int | None = None, files: list[str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its ``files``; later versions do not touch what this reads.

    A folder that has no later version is read as a folder, with the columns of its partitions.
    """
    reader = spark.read.option("mode", "FAILFAST").schema(schema)
    version = latest(spark, folder) if version is None else version
    if files is None and not version:
        return reader.json(folder)
    files = listed(spark, folder, version) if files is None else files
    return reader.json(files) if files else spark.createDataFrame([], schema)


def paths(rows: DataFrame, name: str = "path") -> DataFrame:
    """The rows of a scan with the file each came from."""
    return rows.select("*", F.col("_metadata.file_path").alias(name))


def touched(rows: DataFrame, name: str = "path") -> list[str]:
    """The different files of rows that :func:`paths` made, by their names in lists."""
    return sorted(_name(r[0]) for r in rows.select(name).distinct().collect())


def replaced(spark: SparkSession, folder: str, base: int, gone: list[str], rows: DataFrame) -> int:
    """The number of a new version: ``base`` without the files ``gone``, and ``rows`` in files of their own.

    Nothing is seen of it before it is whole; if it fails, its claim is taken back and ``base`` stays the latest.
    """
    to = base + 1
    claim = f"{folder}/{LISTS}/{to}.claim"
    store, where = _at(spark, claim)
    try:
        store.create(where, False).close()
    except Py4JJavaError as error:
        raise Conflict(f"version {to} of {folder} is another writer's; if that one has died, delete {claim}") from error
    try:
        place, kept = f"{folder}/{FILES}/{to}", set(listed(spark, folder, base)) - set(gone)
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(place)
        files = [(f,) for f in sorted(kept | set(listed(spark, place, 0)))]
        spark.createDataFrame(files, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{LISTS}/{to}")
    except BaseException:
        store.delete(where, False)
        raise
    return to


def appended(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    """More rows: files of the folder while it has no later version, else a version with them."""
    base = latest(spark, folder)
    if base:
        replaced(spark, folder, base, [], rows)
    else:
        rows.write.mode("append").option("ignoreNullFields", False).json(folder)


def expire(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Delete the files that only versions before the last ``keep`` list, and those lists; the number of files deleted.

    A reader that still uses such a version loses its files, so keep as many as readers may hold. Version 0 counts as older than all.
    """
    known = versions(spark, folder)
    old, stay = known[:-keep], known[-keep:]
    if not stay or keep < 1:
        return 0
    live = set().union(*(listed(spark, folder, n) for n in stay))
    dead = set(listed(spark, folder, 0)).union(*(listed(spark, folder, n) for n in old)) - live
    for path in [*dead, *(f"{folder}/{LISTS}/{n}" for n in old)]:
        store, where = _at(spark, path)
        store.delete(where, True)
    return len(dead)
