"""Scratch space that all executors share, to cut lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own on a local master; on a cluster that would
    be another folder on every machine, so it is refused there."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = spark.conf.get("quarrybed.scratch.dir", "")
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quarrybed-")
    spark.conf.set("quarrybed.scratch.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persist_shared(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back.

    A lost executor costs no recomputation after this, and a second consumer does not repeat the work.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Rounds:
    """The state of a loop: each round is written to the shared folder, and the round before the last is removed, as
    nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            drop_path(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove what is left, once the result has been written elsewhere."""
        while self.paths:
            drop_path(self.spark, self.paths.pop())


class Scratch:
    """Tables in the shared folder that one computation reads and removes when its result has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame | None = None) -> None:
        """Remove one table, or all that are left."""
        for key in [id(df)] if df is not None else list(self.paths):
            if key in self.paths:
                drop_path(self.spark, self.paths.pop(key)[0])


class Appended:
    """A table that a loop adds rows to."""

    def __init__(self, spark: SparkSession, name: str, schema):
        self.spark, self.path, self.schema = spark, scratch_path(spark, name), schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
