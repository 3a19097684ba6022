"""Names, marks and removal of files in a folder that every executor can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spinneret.sources.store import _path_of


def names(spark: SparkSession, folder: str) -> list[str]:
    """What stands in a folder; nothing if there is no such folder."""
    files, path = _path_of(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file, whole or not at all."""
    files, where = _path_of(spark, path)
    files.create(where, True).close()


def remove(spark: SparkSession, path: str) -> None:
    files, where = _path_of(spark, path)
    files.delete(where, True)
