"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset, one in the warehouse of a session on one machine, on a cluster an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint, which survives the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/barwright-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: column-pruned, compressed, re-readable."""
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_secret(spark: SparkSession, name: str) -> str:
    """A random secret kept under a name in the shared folder: made once, the same for all later jobs that use the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/barwright-secret-{name}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        draft = spark._jvm.org.apache.hadoop.fs.Path(f"{at.toString()}.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(secrets.token_hex(32).encode())
        out.close()
        if not fs.rename(draft, at):
            fs.delete(draft, False)  # another job was first
    held = fs.open(at)
    try:
        return bytes(held.readAllBytes()).decode()
    finally:
        held.close()


def release(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished plans when the driver collects its garbage; this asks it to, before more are written."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables stored() while the block runs; they are deleted at its end, so what outlives it must be cut() before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(new_folder(self.spark))
        out = stored(df, self.paths[-1])
        release(self.spark)
        return out

    def free(self) -> None:
        """Deletes what has been stored so far."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        self.paths = []
        release(self.spark)

    def __exit__(self, *_) -> None:
        self.free()
