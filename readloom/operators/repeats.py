"""Runs of one base and repeats in sequences, as rows (id, run, base, start, len) that windows by sequence put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sequences as S


def run_rows(seqs: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """key, run (from 0), base, len, start of every single-base run."""
    rows = seqs.select(key, F.posexplode(S.base_runs(F.col(seq))).alias("run", "x")).select(key, "run", "x.base", "x.len")
    before = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)))


def neighbour_runs(runs: DataFrame, key: str) -> DataFrame:
    """Runs with `left` and `right`: the length of the run two before (behind) if it has the same base, else 0.

    Such runs are one run that another base interrupts.
    """
    order = Window.partitionBy(key).orderBy("run")
    same = lambda f: F.when(f("base", 2).over(order) == F.col("base"), f("len", 2).over(order)).otherwise(0)
    return runs.withColumn("left", same(F.lag)).withColumn("right", same(F.lead))


def run_marks(seqs: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """key, pos, base, before, after, left, right of every base: equal bases before and behind it in its run, and
    the interrupted neighbours of the run."""
    runs = neighbour_runs(run_rows(seqs, key, seq), key)
    each = runs.withColumn("before", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    return each.select(key, (F.col("start") + F.col("before")).alias("pos"), "base", "before", (F.col("len") - 1 - F.col("before")).alias("after"), "left", "right")


def single_base_repeats(seqs: DataFrame, key: str, least: int, seq: str = "seq") -> DataFrame:
    """key, start, end of runs of `least` (2 or more) equal bases, with the interrupted runs beside them.

    A run of two or more of the same base, behind one run of another base, goes on with it; so does the next.
    """
    if least < 2:
        raise ValueError("a repeat has two bases or more")
    order = Window.partitionBy(key, "phase", "base").orderBy("run")
    runs = run_rows(seqs, key, seq).where("len > 1").withColumn("phase", F.col("run") % 2)
    chains = runs.withColumn("chain", F.col("run") - 2 * F.row_number().over(order))
    found = chains.groupBy(key, "phase", "base", "chain").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"), F.max("len").alias("most"))
    return found.where(F.col("most") >= least).select(key, "start", "end")


def two_base_repeats(seqs: DataFrame, key: str, least: int, seq: str = "seq") -> DataFrame:
    """key, start, end of `least` or more equal neighbouring pairs of bases, in the frame that has the longest repeat.

    Frames begin at 0 and 1; of equal ones the second is taken.  Pairs with an N are all alike; a single base at the
    end is no pair.
    """
    pair = lambda s, i: F.substring(s, i + 1, F.lit(2))
    n = F.length(seq)
    shift = F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")
    framed = seqs.where(n >= 2).select(key, F.col(seq).alias("s"), shift).where(F.length("s") - F.col("shift") >= 2)
    units = framed.select(key, "shift", F.posexplode(F.transform(F.sequence(F.col("shift"), F.length("s") - 2, F.lit(2)), lambda i: pair(F.col("s"), i))).alias("i", "unit"))
    units = units.withColumn("unit", F.when(F.col("unit").contains("N"), "N").otherwise(F.col("unit")))
    run = F.col("i") - F.row_number().over(Window.partitionBy(key, "shift", "unit").orderBy("i"))
    found = units.withColumn("run", run).groupBy(key, "shift", "unit", "run").agg(F.min("i").alias("i"), F.count("*").alias("n")).where(F.col("n") >= least)
    most = lambda k: F.coalesce(F.max(F.when(F.col("shift") == k, F.col("n"))).over(Window.partitionBy(key)), F.lit(0))
    found = found.withColumn("frame", F.when(most(0) > most(1), 0).otherwise(1)).where("shift = frame")
    start = (F.col("shift") + 2 * F.col("i")).cast("bigint")
    return found.select(key, start.alias("start"), (start + 2 * F.col("n")).alias("end"))


def merged_repeats(repeats: DataFrame, key: str, gap: int = 5, longest: int = 1000) -> DataFrame:
    """Repeats of a sequence, put together where less than `gap` bases are between them; longer ones than `longest` go."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") - before < gap, 0).otherwise(1)
    rows = repeats.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = rows.groupBy(key, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.where(F.col("end") - F.col("start") <= longest).select(key, "start", "end")


def repeat_regions(seqs: DataFrame, key: str, single: int, double: int, seq: str = "seq") -> DataFrame:
    """key, start, end: single-base repeats of `single` bases and two-base repeats of `double` pairs, merged."""
    both = single_base_repeats(seqs, key, single, seq).unionByName(two_base_repeats(seqs, key, double, seq))
    return merged_repeats(both, key)


def replaced_part(seq: Column, old: Column, new: Column) -> Column:
    """seq with the first `old` in it replaced; unchanged without one."""
    at = F.position(old, seq)
    return F.when(at > 0, F.concat(F.left(seq, at - 1), new, F.substring(seq, at + F.length(old), F.length(seq)))).otherwise(seq)
