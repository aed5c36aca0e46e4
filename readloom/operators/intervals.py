"""Interval operators: tiling, range joins, merges, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 16384
#: Places of a sequence that one task goes through in order.
SPAN = 1_000_000


def stretches(rows: DataFrame, keys: list[str], at: str, span: int, *totals: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with the stretch of `span` places that each is in (_part), and one row of totals for each stretch."""
    rows = rows.withColumn("_part", F.floor(F.col(at) / span))
    return rows, rows.groupBy(*keys, "_part").agg(*totals)


def with_stretches(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the columns of their stretch; null keys meet too."""
    named = totals.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_part"]], *[c for c in totals.columns if c not in (*keys, "_part")])
    met = F.lit(True)
    for k in [*keys, "_part"]:
        met = met & rows[k].eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(named, met).drop(*[f"_of_{k}" for k in [*keys, "_part"]], "_part")


def running(rows: DataFrame, keys: list[str], at: str, how: Callable, value: Column, name: str, span: int = SPAN, current: bool = True) -> DataFrame:
    """rows with the sum (how=F.sum) or maximum (how=F.max) of value over the rows of the same keys up to this one, by
    `at`; without this one unless `current`.  Null where there's nothing before.

    Each stretch of places is gone through on its own and meets what all stretches before it come to, so no task holds
    a whole sequence: a window over all places of a key has one row for each stretch.
    """
    rows, totals = stretches(rows, keys, at, span, how(value).alias("_all"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_part", how("_all").over(before).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    rows = with_stretches(rows.withColumn("_within", how(value).over(within)), totals, keys)
    both = F.greatest("_within", "_before") if how is F.max else F.coalesce(F.col("_within") + F.col("_before"), "_within", "_before")
    return rows.withColumn(name, both).drop("_within", "_before")


def overlap_join(a: DataFrame, b: DataFrame, bin_size: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of rows of a(chrom, start, end, ...) and b(chrom, b_start, b_end, ...) whose half-open intervals overlap.

    Both sides are cut at bin borders and meet on (chrom, bin); a pair is kept in the first bin that both reach, so it
    comes once.  Work follows the overlaps, not the product; bins of many rows are split by adaptive execution.
    how="left" keeps rows of a without a partner; a needs a column `a_id` then.
    """

    def bins(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / bin_size), F.floor((F.greatest(end, start + 1) - 1) / bin_size)))

    left = a.where("end > start").withColumn("_bin", bins(F.col("start"), F.col("end")))
    right = b.where("b_end > b_start").withColumn("_bin", bins(F.col("b_start"), F.col("b_end")))
    found = left.join(right, ["chrom", "_bin"]).where("start < b_end and b_start < end")
    found = found.where(F.col("_bin") == F.floor(F.greatest("start", "b_start") / bin_size)).drop("_bin")
    if how == "left":
        extra = [c for c in b.columns if c != "chrom"]
        found = a.join(found.select("a_id", *extra), "a_id", "left")
    return found


def tiles(regions: DataFrame, width: int, step: int | None = None) -> DataFrame:
    """Windows (chrom, start, end) of `width` at every `step` of regions(chrom, start, end), the last cut at the end.

    With step = width every base is in one window.
    """
    starts = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(step or width).cast("bigint")))
    cut = regions.where("end > start").withColumn("w_start", starts)
    return cut.select("chrom", F.col("w_start").alias("start"), F.least(F.col("w_start") + width, F.col("end")).alias("end"))


def merged(intervals: DataFrame, gap: int = 0, span: int = SPAN) -> DataFrame:
    """Intervals (chrom, start, end) merged where the next begins at most `gap` (0 or more) after all before it ended; n
    counts them.

    Intervals of one start are put together first; an island is named by its start.
    """
    rows = intervals.groupBy("chrom", "start").agg(F.max("end").alias("end"), F.count("*").alias("n"))
    rows = running(rows, ["chrom"], "start", F.max, F.col("end"), "before", span, current=False)
    fresh = F.when(F.col("before").isNull() | (F.col("start") - F.col("before") > gap), F.col("start"))
    rows = running(rows, ["chrom"], "start", F.max, fresh, "island", span)
    return rows.groupBy("chrom", "island").agg(F.max("end").alias("end"), F.sum("n").alias("n")).select("chrom", F.col("island").alias("start"), "end", "n")


def depth(reads: DataFrame, span: int = SPAN) -> DataFrame:
    """chrom, pos, depth of every covered base of reads(chrom, start, end).

    Starts and ends are summed per position before anything is sorted, so the windows hold positions, not reads, and no
    more of these than a stretch has.
    """
    ups = reads.groupBy("chrom", F.col("start").alias("pos")).agg(F.count("*").alias("d"))
    downs = reads.groupBy("chrom", F.col("end").alias("pos")).agg((-F.count("*")).alias("d"))
    steps = ups.unionByName(downs).groupBy("chrom", "pos").agg(F.sum("d").alias("d"))
    steps, totals = stretches(steps, ["chrom"], "pos", span, F.sum("d").alias("all"), F.min("pos").alias("first"))
    parts = Window.partitionBy("chrom").orderBy("_part")
    carried = F.coalesce(F.sum("all").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("chrom", "_part", carried.alias("carried"), F.lead("first").over(parts).alias("after"))
    order = Window.partitionBy("chrom", "_part").orderBy("pos")
    runs = steps.withColumn("within", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("next", F.lead("pos").over(order))
    runs = with_stretches(runs, totals, ["chrom"]).select("chrom", "pos", (F.col("within") + F.col("carried")).alias("depth"), F.coalesce("next", "after").alias("next"))
    runs = runs.where("depth > 0 and next > pos")
    return runs.select("chrom", F.explode(F.sequence(F.col("pos"), F.col("next") - 1)).alias("pos"), "depth")


def islands(depths: DataFrame, least: int, span: int = SPAN) -> DataFrame:
    """chrom, start, end, mean_depth of runs of neighbouring positions with a depth of `least` or more."""
    run = running(depths.where(F.col("depth") >= least), ["chrom"], "pos", F.sum, F.lit(1), "rank", span)
    run = run.withColumn("island", F.col("pos") - F.col("rank"))
    return run.groupBy("chrom", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.avg("depth").alias("mean_depth")).drop("island")


def intersected(a: DataFrame, b: DataFrame, bin_size: int = BIN) -> DataFrame:
    """The overlaps themselves: chrom, start, end of each pair."""
    found = overlap_join(a, b, bin_size)
    return found.select("chrom", F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"))
