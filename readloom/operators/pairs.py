"""Gapped pairs of sequences (read, reference; `-` for a gap): runs, shifts of gaps, splicing, statistics of runs.

Pairs are two strings of equal length; a column that has a gap on both sides has no meaning and must not occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _plain(s: Column) -> Column:
    return F.replace(s, F.lit("-"), F.lit(""))


def _columns(read: Column, ref: Column) -> Column:
    """Four characters a column: `|` for a mismatch, else `.`; the reference's base (the read's at a gap); read; reference."""
    other = lambda a, b: (a != b) & (a != "-") & (b != "-") & (a != "N") & (b != "N")
    one = lambda a, b: F.concat(F.when(other(a, b), "|").otherwise("."), F.when(b == "-", a).otherwise(b), a, b)
    return F.array_join(F.zip_with(_chars(read), _chars(ref), one), "")


def _sides(block: Column) -> tuple[Column, Column]:
    """The bases of read and reference in a block of columns."""
    return _plain(F.regexp_replace(block, "..(.).", "$1")), _plain(F.regexp_replace(block, "...(.)", "$1"))


def shifted(read: Column, ref: Column) -> Column:
    """(read, ref) with every gap at the right end of the run of one base that it is in.

    A run ends where another base begins, or before a mismatch; a gap against a gap in one run goes away.
    """
    blocks = F.regexp_extract_all(_columns(read, ref), F.lit(r".(.)..(?:\.\1..)*+"), F.lit(0))

    def fit(side: int) -> Column:
        def one(block: Column) -> Column:
            sides = _sides(block)
            return F.rpad(sides[side], F.greatest(*map(F.length, sides)), F.lit("-"))

        return F.array_join(F.transform(blocks, one), "")

    return F.struct(fit(0).alias("read"), fit(1).alias("ref"))


def run_blocks(read: Column, ref: Column) -> Column:
    """Array of (base, read_len, ref_len, kind): the runs of one base of a pair.

    kind: match, over (more bases read than there are), under, insert (no reference base), delete (no read base),
    mismatch.  A mismatch is a block of its own.
    """
    blocks = F.regexp_extract_all(_columns(read, ref), F.lit(r"\|...|\.(.)..(?:\.\1..)*+"), F.lit(0))

    def block(x: Column) -> Column:
        m, n = map(F.length, _sides(x))
        kind = F.when(x.startswith("|"), "mismatch").when(n == 0, "insert").when(m == 0, "delete").when(m > n, "over").when(m < n, "under").otherwise("match")
        return F.struct(F.substring(x, 2, 1).alias("base"), m.alias("read_len"), n.alias("ref_len"), kind.alias("kind"))

    return F.transform(blocks, block)


def spliced(read: Column, ref: Column, at: Column, size: Column, new_read: Column, new_ref: Column) -> Column:
    """(read, ref) with the columns of reference bases [at, at + size) replaced by a new pair.

    Columns of inserts before the first of these bases stay; those between them and before the next base go.
    """
    bases = F.filter(F.transform(_chars(ref), lambda c, i: F.when(c != "-", i + 1)), lambda i: i.isNotNull())
    first = F.coalesce(F.try_element_at(bases, at + 1), F.length(ref) + 1)
    last = F.coalesce(F.try_element_at(bases, at + size + 1), F.length(ref) + 1)
    put = lambda s, new: F.concat(F.left(s, first - 1), new, F.substring(s, last, F.length(s)))
    return F.struct(put(read, new_read).alias("read"), put(ref, new_ref).alias("ref"))


def block_rows(pairs: DataFrame, key: str, read: str = "read", ref: str = "ref") -> DataFrame:
    """key, i, base, read_len, ref_len, kind: the runs of pairs(key, read, ref), numbered."""
    return pairs.select(key, F.posexplode(run_blocks(F.col(read), F.col(ref))).alias("i", "x")).select(key, "i", "x.*")


def run_site_deletes(blocks: DataFrame, longest: int = 6) -> DataFrame:
    """len, site, deletes, n, rate: how often the site-th base of a reference run of a length isn't read."""
    kept = blocks.where("kind not in ('insert', 'delete')").where(F.col("ref_len").between(1, longest))
    counts = kept.groupBy("ref_len", "read_len").agg(F.count("*").alias("n"))  # small before sites are made
    sites = counts.withColumn("site", F.explode(F.sequence(F.lit(0), F.col("ref_len") - 1)))
    out = sites.groupBy(F.col("ref_len").alias("len"), "site").agg(F.sum(F.when(F.col("site") >= F.col("read_len"), F.col("n")).otherwise(0)).alias("deletes"), F.sum("n").alias("n"))
    return out.withColumn("rate", F.col("deletes") / (F.col("n") + 1e-9))


def insert_contexts(blocks: DataFrame, key: str, longest: int = 6) -> DataFrame:
    """len, next_to, left_close, right_close: inserts by the run of the same base that they lengthen or stand near.

    A base too many in a run counts at each length that it makes; an insert counts at the length of the run two blocks
    before (behind) it if that has the same base and was read.
    """
    order = Window.partitionBy(key).orderBy("i")
    near = lambda f: F.when(f("kind", 2).over(order).isin("match", "over", "under") & (f("base", 2).over(order) == F.col("base")), f("ref_len", 2).over(order))
    seen = blocks.withColumn("l", near(F.lag)).withColumn("r", near(F.lead))
    count = lambda rows, name: rows.where(F.col("len").between(1, longest)).groupBy("len").agg(F.count("*").alias(name))
    over = blocks.where("kind = 'over'").select(F.explode(F.sequence(F.col("ref_len"), F.col("read_len") - 1)).alias("len"))
    inserts = seen.where("kind = 'insert'")
    parts = [count(over, "next_to"), count(inserts.select(F.col("l").alias("len")), "left_close"), count(inserts.select(F.col("r").alias("len")), "right_close")]
    out = parts[0].join(parts[1], "len", "full").join(parts[2], "len", "full")
    return out.select("len", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("next_to", "left_close", "right_close")])
