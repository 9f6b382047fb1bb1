"""Versions of a saved thing below one folder, published atomically.

A version is a folder ``v-<number>-<random>``: the number is one above those that
are there, the random part keeps writers that start at the same time apart.  The
empty file ``_PUBLISHED``, created last, makes it visible.  A reader takes the
last published version by name, so it sees a whole version or none, and a writer
that dies leaves a folder that nobody reads.  Nothing is renamed or overwritten,
so any Hadoop file system or object store will do."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

MARK = "_PUBLISHED"
NAME = re.compile(r"v-(\d{10})-[0-9a-f]{32}")


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(n for n in found if NAME.fullmatch(n))


def folder(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/{version}"


def start(spark: SparkSession, path: str) -> str:
    """The name of a new version, which no other writer has or gets."""
    number = max((int(NAME.fullmatch(n).group(1)) for n in _names(spark, path)), default=0) + 1
    return f"v-{number:010d}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Readers see the version from here on."""
    fs, target = _fs(spark, f"{folder(path, version)}/{MARK}")
    fs.create(target, False).close()


def published(spark: SparkSession, path: str) -> list[str]:
    """The whole versions, oldest first."""
    out = []
    for n in _names(spark, path):
        fs, mark = _fs(spark, f"{folder(path, n)}/{MARK}")
        if fs.exists(mark):
            out.append(n)
    return out


def latest(spark: SparkSession, path: str, version: str | None = None) -> str:
    """The folder of the newest whole version, or of the given one."""
    known = published(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no published version{'' if version is None else f' {version}'} below {path}")
    return folder(path, version or known[-1])


def prune(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Take back and delete the published versions but the newest ``keep`` (at
    least one); their names.  Folders of writers still at work stay."""
    old = published(spark, path)[: -max(keep, 1)]
    for n in old:
        fs, mark = _fs(spark, f"{folder(path, n)}/{MARK}")
        fs.delete(mark, False)  # first no reader takes it any more
        fs.delete(mark.getParent(), True)
    return old
