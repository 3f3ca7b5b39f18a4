"""Files as the session's file systems know them: what Spark itself reads and writes through."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class SourceFile(NamedTuple):
    path: str
    size: int
    modified: int  # milliseconds


def _opened(spark: SparkSession, path: str, is_uri: bool = False):
    """(file system, path) of a plain path, or of a URI as a DataFrame's inputFiles gives it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if is_uri else path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _opened(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all below it; nothing happens if there is none."""
    system, place = _opened(spark, path)
    system.delete(place, True)


def rename(spark: SparkSession, path: str, target: str) -> bool:
    """Whether path is now target. False if target was there before: then nothing has moved."""
    system, place = _opened(spark, path)
    _, to = _opened(spark, target)
    return not system.exists(to) and system.rename(place, to)


def children(spark: SparkSession, path: str) -> list[SourceFile]:
    """What lies directly in a folder; nothing if there is no such folder."""
    system, place = _opened(spark, path)
    if not system.exists(place):
        return []
    return [
        SourceFile(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in system.listStatus(place)
    ]


def source_files(tables: Iterable[DataFrame]) -> list[SourceFile]:
    """The files the tables are read from, each once, ordered by path."""
    found: dict[str, SourceFile] = {}
    for table in tables:
        for path in table.inputFiles():
            if path not in found:
                system, place = _opened(table.sparkSession, path, is_uri=True)
                status = system.getFileStatus(place)
                found[path] = SourceFile(path, status.getLen(), status.getModificationTime())
    return [found[path] for path in sorted(found)]
