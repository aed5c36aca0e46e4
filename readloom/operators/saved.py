"""Cutting the lineage of iterated tables in the folder that driver and executors share; dealing rows to kernels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: spark.checkpoint.dir.

    Where that is unset and driver and executors are one process, a folder of our own is used; on a cluster it is an
    error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="readloom-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, stored in the folder of spark.checkpoint.dir, with its plan cut there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in that folder and read back: for rows with arrays of structs, which take far less room so."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to spark.sql.shuffle.partitions tasks, never fewer.

    For kernels: they take far longer than the bytes of their rows let adaptive execution guess, which would put small rows
    into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
