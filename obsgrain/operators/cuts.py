"""Cuts lineage at the shared folder named in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table is broadcast.
BROADCAST_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in a single-JVM session that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="obsgrain-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in one folder of this application that is deleted when the application ends."""
    jvm, home = spark.sparkContext._jvm, f"{shared_dir(spark)}/obsgrain-{spark.sparkContext.applicationId}"
    folder = jvm.org.apache.hadoop.fs.Path(home)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path of scratch()."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, already cut, with a broadcast hint if it has at most so many rows; beyond that Spark shuffles it."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
