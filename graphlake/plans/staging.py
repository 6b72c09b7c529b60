"""Staging tables in the cluster's shared folder.

A staged table cuts the lineage: it survives the loss of any executor and is read back with column pruning.
The folder is the one the session names in ``spark.checkpoint.dir``; a default of our own is used only in
local mode, where driver and executors are one process.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints/graphlake"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_DEFAULT


def stage_root(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    return f"{shared_dir(spark)}/stage/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again, as a loop's last round but one."""
    path = getattr(df, "_staged_at", None)
    if path is not None:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all staged tables of this application; results not yet written can't be read afterwards."""
    _delete(spark, stage_root(spark))
