"""Error statistics of aligned reads: by place in the read, and by single-base run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.functions import sequences as S


def by_read_position(reads: DataFrame, cuts: list[float]) -> DataFrame:
    """bin, mismatches, rate: mismatches by the distance to the nearer end of the read, in bins of `cuts`."""
    c = F.col
    seen = reads.where("md is not null").select("pos", "end", F.explode(A.mismatches(c("ops"), c("pos"), c("seq"), c("qual"), c("md"))).alias("x"))
    near = F.least(F.col("x.pos") - F.col("pos"), F.col("end") - 1 - F.col("x.pos"))
    counts = seen.groupBy(S.bin_index(near, cuts).alias("bin")).agg(F.count("*").alias("mismatches"))
    total = counts.agg(F.sum("mismatches").alias("total"))
    return counts.join(F.broadcast(total)).select("bin", "mismatches", (F.col("mismatches") / F.col("total")).alias("rate"))


def run_length_calls(pairs: DataFrame, longest: int = 6) -> DataFrame:
    """len, n, over, under of pairs(ref_run, read_run): how often a run of a reference length is read too long or short.

    Lengths from `longest` on are one class; runs without a base on either side are pure inserts or deletions and don't
    count.
    """
    kept = pairs.where("ref_run > 0 and read_run > 0").withColumn("len", F.least("ref_run", F.lit(longest)))
    return kept.groupBy("len").agg(F.count("*").alias("n"), F.count(F.when(F.col("read_run") > F.col("ref_run"), 1)).alias("over"), F.count(F.when(F.col("read_run") < F.col("ref_run"), 1)).alias("under"))
