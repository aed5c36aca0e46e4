"""Gapped alignments as strings, segments of reads within regions, repeats, simulated mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.operators.intervals import overlap_join


def gapped_read(ops: Column, pos: Column, seq: Column) -> Column:
    """The aligned bases of a read with `-` where reference bases are deleted; clipped bases are left out."""
    here = lambda o: F.when(o["op"].isin("M", "=", "X", "I"), F.substring(seq, o["read"] + 1, o["len"])).when(o["op"].isin("D", "N"), F.repeat(F.lit("-"), o["len"])).otherwise("")
    return F.array_join(F.transform(A.placed(ops, pos), here), "")


def gapped_reference(ops: Column, pos: Column, ref: Column, ref_start: Column) -> Column:
    """The reference bases under a read, of a sequence that begins at ref_start, with `-` where the read has inserts."""
    here = lambda o: F.when(o["op"].isin("M", "=", "X", "D", "N"), F.substring(ref, (o["ref"] - ref_start + 1).cast("int"), o["len"])).when(o["op"] == "I", F.repeat(F.lit("-"), o["len"])).otherwise("")
    return F.array_join(F.transform(A.placed(ops, pos), here), "")


def _columns(read: Column, ref: Column, of) -> Column:
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return F.array_join(F.zip_with(chars(read), chars(ref), of), "")


def pair_cigar(read: Column, ref: Column) -> Column:
    """CIGAR of a gapped pair: M, I and D in runs."""
    states = _columns(read, ref, lambda a, b: F.when(b == "-", "I").when(a == "-", "D").otherwise("M"))
    runs = F.regexp_extract_all(states, F.lit(r"(.)\1*"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))), "")


def pair_md(read: Column, ref: Column) -> Column:
    """MD of a gapped pair, as tools write it: a number at both ends and between any two other parts."""
    kinds = _columns(read, ref, lambda a, b: F.when(b == "-", "").when(a == "-", F.lower(b)).when((a == b) | (a == "N"), "=").otherwise(F.upper(b)))
    parts = F.regexp_extract_all(kinds, F.lit(r"=+|[a-z]+|[A-Z]"), F.lit(0))
    shown = F.transform(parts, lambda p: F.when(p.startswith("="), F.length(p).cast("string")).when(p.rlike("^[a-z]"), F.concat(F.lit("#^"), F.upper(p), F.lit("#"))).otherwise(F.concat(F.lit("#"), p, F.lit("#"))))
    text = F.regexp_replace(F.array_join(shown, ""), "##", "0")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^#", "0"), "#$", "0"), "#", "")


def gap_counts(read: Column, ref: Column) -> Column:
    """(matches, mismatches, inserts, deletes) of a gapped pair, by columns."""
    states = _columns(read, ref, lambda a, b: F.when(b == "-", "I").when(a == "-", "D").when(a == b, "M").otherwise("X"))
    count = lambda c: F.length(states) - F.length(F.replace(states, F.lit(c), F.lit("")))
    return F.struct(count("M").alias("matches"), count("X").alias("mismatches"), count("I").alias("inserts"), count("D").alias("deletes"))


def cropped(reads: DataFrame, regions: DataFrame, bin_size: int = 16384) -> DataFrame:
    """region_id, name, segment, offset: the part of each read of reads(name, chrom, start, end, ops, seq) in each region.

    A read is once in each region that it overlaps; offset is where the segment begins within the region.
    """
    found = overlap_join(reads, regions.withColumnRenamed("start", "b_start").withColumnRenamed("end", "b_end"), bin_size)
    lo, hi = F.col("b_start"), F.col("b_end")

    def part(o: Column) -> Column:
        first, last = F.greatest(o["ref"], lo), F.least(o["ref"] + o["len"], hi)
        match = F.substring(F.col("seq"), (o["read"] + first - o["ref"] + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))
        insert = F.when((o["ref"] > lo) & (o["ref"] < hi), F.substring(F.col("seq"), o["read"] + 1, o["len"])).otherwise("")
        return F.when(o["op"].isin("M", "=", "X"), match).when(o["op"] == "I", insert).otherwise("")

    segment = F.array_join(F.transform(A.placed(F.col("ops"), F.col("start")), part), "")
    return found.select("region_id", "name", segment.alias("segment"), F.greatest(F.col("start") - lo, F.lit(0)).alias("offset")).where("segment <> ''")


def unique_segments(segments: DataFrame) -> DataFrame:
    """region_id, segment, offset, name (the smallest), n of equal segments."""
    return segments.groupBy("region_id", "segment", "offset").agg(F.min("name").alias("name"), F.count("*").alias("n"))


def tandem_repeats(seq: Column, unit: int, copies: int) -> Column:
    """Array of (start, unit, copies): runs of `copies` or more copies of a unit, from the left, not overlapping."""
    pattern = f"(.{{{unit}}})\\1{{{copies - 1},}}"
    found = F.regexp_extract_all(seq, F.lit(pattern), F.lit(0))
    before = F.split(seq, pattern, -1)
    kind = "array<struct<start:int,unit:string,copies:int>>"
    zipped = F.zip_with(F.slice(before, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x["b"]
        run = F.struct(at.alias("start"), F.left(x["m"], F.lit(unit)).alias("unit"), (F.length(x["m"]) / unit).cast("int").alias("copies"))
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(run)).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])


def repeat_class(unit_length: Column) -> Column:
    return F.when(unit_length.between(1, 10), "micro").when(unit_length.between(11, 100), "mini").when(unit_length.between(101, 1_000_000), "satellite")


def mutated(contigs: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """name, pos, ref, alt of point mutations of contigs(name, seq): each base with probability `rate`, by a seeded hash.

    The new base is one of the three others.
    """
    rows = contigs.select("name", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "ref")).where(F.col("ref").isin(*"ACGT"))
    dice = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "name", "pos"), F.lit(1_000_003))
    others = F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != F.col("ref"))
    return rows.where(dice("hit") < rate * 1_000_003).select("name", "pos", "ref", F.element_at(others, (dice("base") % 3 + 1).cast("int")).alias("alt"))


def applied(contigs: DataFrame, variants: DataFrame) -> DataFrame:
    """contigs(name, seq) with variants(name, pos, ref, alt) of one base each put in."""
    marks = variants.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), "alt"))).alias("new"))
    chars = F.filter(F.split("seq", ""), lambda c: c != "")
    seq = F.array_join(F.transform(chars, lambda c, i: F.coalesce(F.try_element_at("new", i), c)), "")
    return contigs.join(marks, "name", "left").select("name", F.when(F.col("new").isNull(), F.col("seq")).otherwise(seq).alias("seq"))


def clade_threshold(rows: DataFrame, clade: str, value: str, share: float = 0.95) -> DataFrame:
    """Per clade the largest value, and the value at which its members, largest first, hold `share` of the clade's sum."""
    down = Window.partitionBy(clade).orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("_run", F.sum(value).over(down)).withColumn("_all", F.sum(value).over(Window.partitionBy(clade)))
    return run.groupBy(clade).agg(F.max(value).alias("most"), F.max(F.when(F.col("_run") >= share * F.col("_all") - 1e-9, F.col(value))).alias("threshold"))
