"""Versions of a folder that count once a marker has been renamed into place."""

from __future__ import annotations

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    """The file system of a path, by Hadoop, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    fs, commits = folder(spark, f"{base}/commits")
    if not fs.exists(commits):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(commits)]
    return sorted(int(n) for n in names if n.isdigit())


def commit(spark: SparkSession, base: str, version: int) -> bool:
    """Make a version count; false if another writer was first."""
    fs, marker = folder(spark, f"{base}/commits/{version}")
    if fs.exists(marker):
        return False
    _, draft = folder(spark, f"{base}/drafts/{version}")
    fs.create(draft, True).close()
    fs.mkdirs(marker.getParent())
    return bool(fs.rename(draft, marker))


def forget(spark: SparkSession, base: str, keep: int) -> None:
    """Old versions of ``versions/`` go: first the marker, then the files."""
    for version in versions(spark, base)[:-keep]:
        for path in (f"{base}/commits/{version}", f"{base}/versions/{version}"):
            fs, p = folder(spark, path)
            fs.delete(p, True)
