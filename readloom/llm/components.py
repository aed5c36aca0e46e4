"""Connected components of a graph held as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def _round(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on its smallest one, then the smaller neighbours likewise."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(low, "u").where("v > u and m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    low = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node of edges(a, b).

    The steps settle, after about a logarithmic number of rounds, on stars around the smallest ids.  Minima and
    distinct edges are aggregated before they move; a hub's edges meet only the hub's one row, in a join that adaptive
    execution can split.  The driver sees a count and a checksum per round.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = stored(_round(edges), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
