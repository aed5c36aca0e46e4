"""Helpers that the text operators share: the shared folder, stored intermediate tables, joins on uneven keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python.  Texts may be long, so a batch holds few of them.
ARROW_ROWS = 512


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder of our own in the temporary folder, if driver and executors are one process; on a
    cluster a machine's own folder is no shared one, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="readloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that a column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The plan is cut there: a lost executor costs only the tasks that read the table, never its making.
    """
    spark = session_of(df)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker by handing it few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text of a documents table; a null text counts as empty.  Other columns stay behind, so none can clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, mod n: the fold of a document.  A null id falls in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)), F.lit(n))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of rows with one row per group, when one group may hold a large part of all rows.

    A group with more than 1/share of the rows is hot.  There are at most `share` such groups whatever the data, so
    they are broadcast and their rows never move; every other key has at most total/share rows and is joined by a
    shuffle.
    """
    hot = groups.where(F.col(size) * share > total)
    cold = groups.where(F.col(size) * share <= total)
    stay = rows.join(F.broadcast(hot), key, "inner")
    move = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return stay.unionByName(move)
