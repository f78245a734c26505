"""Folders of a shared file system: scratch space, deletion, and swapping in staged partitions.

A swap has two marks. Folders are staged under the table as `_staged-<id>`, which readers pass over; once all are written the file
`_ready` is put there, and then each partition is moved in, after the one in its place has been moved to `_old-<id>`. A swap that was
cut short is finished by the next one (or by recover()) if it was ready, else its staged folder is deleted and the table is as it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STAGED, OLD, READY = "_staged-", "_old-", "_ready"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, the warehouse of a session on one machine; on a cluster an error, as that may be local to a machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def new_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/warehouse-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder that is deleted at the end, however it comes."""
    path = new_scratch(spark)
    try:
        yield path
    finally:
        delete(spark, path)


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


def staging(table: str) -> str:
    return f"{table.rstrip('/')}/{STAGED}{uuid.uuid4().hex}"


def _children(fs, at) -> list:
    return [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []


def _leaves(fs, at, depth: int) -> list:
    """Partition folders `depth` levels down."""
    found = [at]
    for _ in range(depth):
        found = [c for f in found for c in _children(fs, f) if "=" in c.getName()]
    return found


def swap(spark: SparkSession, table: str, staged: str, depth: int) -> None:
    """Marks the staged partitions as ready and moves them in."""
    fs, at = _fs(spark, f"{staged}/{READY}")
    fs.create(at).close()
    _move(spark, table, staged, depth)


def _move(spark: SparkSession, table: str, staged: str, depth: int) -> None:
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs, root = _fs(spark, staged)
    table, old = table.rstrip("/"), staged.replace(STAGED, OLD)
    for leaf in _leaves(fs, root, depth):
        part = "/".join(str(leaf.toString()).rsplit("/", depth)[1:])
        place, aside = make(f"{table}/{part}"), make(f"{old}/{part}")
        if fs.exists(place):
            fs.mkdirs(aside.getParent())
            if not fs.exists(aside):
                fs.rename(place, aside)
            else:
                fs.delete(place, True)
        fs.mkdirs(place.getParent())
        if not fs.rename(leaf, place):
            raise OSError(f"{leaf} can't be moved to {place}")
    fs.delete(make(old), True)
    fs.delete(root, True)


def recover(spark: SparkSession, table: str, depth: int) -> None:
    """Finishes swaps that were ready, and deletes what was staged by others; one writer at a time."""
    fs, at = _fs(spark, table)
    for child in _children(fs, at):
        if child.getName().startswith(STAGED):
            path = f"{table.rstrip('/')}/{child.getName()}"
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{READY}")):
                _move(spark, table, path, depth)
            else:
                fs.delete(child, True)
    for child in _children(fs, at):
        if child.getName().startswith(OLD):  # its staged folder is gone, so all its partitions were moved
            fs.delete(child, True)
