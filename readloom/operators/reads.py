"""Filters, joins by name, counts, top-k and ordered operators over reads and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.intervals import SPAN, running

#: k-mers that are cut out of one part of a sequence.
BLOCK = 64


def kmer_counts(reads: DataFrame, k: int, stride: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """kmer, n (within `keys`) over reads(seq); sequences shorter than k have none.

    A sequence is cut into parts of BLOCK k-mers, as finding a place in a string takes time by its distance from the
    start; k-mers are cut out where they are counted.
    """
    first = F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1, F.lit(BLOCK * stride)))
    parts = reads.where(F.length("seq") >= k).select(*keys, "seq", first.alias("first"))
    parts = parts.select(*keys, F.col("seq").substr(F.col("first"), F.lit((BLOCK - 1) * stride + k)).alias("part"))
    each = parts.select(*keys, "part", F.explode(F.sequence(F.lit(1), F.length("part") - k + 1, F.lit(stride))).alias("at"))
    return each.groupBy(*keys, F.col("part").substr(F.col("at"), F.lit(k)).alias("kmer")).agg(F.count("*").alias("n"))


def spectrum_cosine(counts: DataFrame, key: str) -> DataFrame:
    """Cosine of the k-mer spectra of every two groups that share a k-mer: a, b, cosine with a < b.

    Dot products come from a join on the k-mer, norms from one aggregation.
    """
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm"))
    left = counts.select(F.col(key).alias("a"), "kmer", F.col("n").alias("x"))
    right = counts.select(F.col(key).alias("b"), "kmer", F.col("n").alias("y"))
    dot = left.join(right, "kmer").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("dot"))
    named = lambda c: norm.select(F.col(key).alias(c), F.col("norm").alias(f"n_{c}"))
    return dot.join(named("a"), "a").join(named("b"), "b").select("a", "b", (F.col("dot") / (F.col("n_a") * F.col("n_b"))).alias("cosine"))


def cosine_between(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, cosine of the k-mer spectra of every group of left(a, kmer, n) with every group of right(b, kmer, n) that
    it shares a k-mer with."""
    norm = lambda t, k: t.groupBy(k).agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias(f"n_{k}"))
    both = left.select(F.col(a), "kmer", F.col("n").alias("x")).join(right.select(F.col(b), "kmer", F.col("n").alias("y")), "kmer")
    dot = both.groupBy(a, b).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("dot"))
    out = dot.alias("d").join(norm(left, a).alias("l"), F.col(f"d.{a}").eqNullSafe(F.col(f"l.{a}"))).join(norm(right, b).alias("r"), F.col(f"d.{b}").eqNullSafe(F.col(f"r.{b}")))
    return out.select(F.col(f"d.{a}").alias("a"), F.col(f"d.{b}").alias("b"), (F.col("dot") / (F.col(f"n_{a}") * F.col(f"n_{b}"))).alias("cosine"))


def unique_sequences(reads: DataFrame, least: int = 1) -> DataFrame:
    """Distinct sequences of reads(read_id, seq) with how often each comes and the smallest id as representative."""
    return reads.groupBy("seq").agg(F.min("read_id").alias("read_id"), F.count("*").alias("n")).where(F.col("n") >= least)


def keep_names(reads: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return reads.join(names.select(column).distinct(), column, "left_semi")


def drop_names(reads: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return reads.join(names.select(column).distinct(), column, "left_anti")


def mark_unmapped(reads: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Set the unmapped bit of the reads that `names` lists; all rows stay."""
    hit = names.select(column).distinct().withColumn("_hit", F.lit(True))
    flag = F.when(F.col("_hit"), F.col("flag").bitwiseOR(F.lit(4))).otherwise(F.col("flag"))
    return reads.join(hit, column, "left").withColumn("flag", flag).drop("_hit")


def best_hits(hits: DataFrame, query: str, cost: str) -> DataFrame:
    """All hits of each query that share its smallest cost."""
    return hits.withColumn("_best", F.min(cost).over(Window.partitionBy(query))).where(F.col(cost) == F.col("_best")).drop("_best")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def downsample(rows: DataFrame, keys: list[str], identity: list[str], depth: int, seed: int = 0) -> DataFrame:
    """At most `depth` rows per group, chosen by a seeded hash of the row's identity: the same rows in every run."""
    return top_k(rows, keys, [F.xxhash64(F.lit(seed), *identity), *map(F.col, identity)], depth)


def nx(lengths: DataFrame, shares: list[float], span: int = SPAN) -> DataFrame:
    """N50 and the like of lengths(length): the length at which pieces that long or longer hold the share of all bases.

    Equal lengths are counted first, so the running sum goes over distinct lengths, the longest first.
    """
    counts = lengths.groupBy("length").agg(F.count("*").alias("n")).withColumn("shorter", -F.col("length"))
    run = running(counts, [], "shorter", F.sum, F.col("length") * F.col("n"), "sum", span)
    total = counts.agg(F.sum(F.col("length") * F.col("n")).alias("total"))
    shared = F.explode(F.array(*map(F.lit, shares))).alias("share")
    return run.join(F.broadcast(total)).select("length", "sum", "total", shared).where(F.col("sum") >= F.col("share") * F.col("total")).groupBy("share").agg(F.max("length").alias("length"))


def jaccard(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """Jaccard coefficient of the item sets of every two groups that share an item: a, b, jaccard with a < b."""
    rows = pairs.select(key, item).distinct()
    size = rows.groupBy(key).agg(F.count("*").alias("size"))
    both = rows.select(F.col(key).alias("a"), item).join(rows.select(F.col(key).alias("b"), item), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(size.select(F.col(key).alias("a"), F.col("size").alias("x")), "a").join(size.select(F.col(key).alias("b"), F.col("size").alias("y")), "b")
    return out.select("a", "b", (F.col("both") / (F.col("x") + F.col("y") - F.col("both"))).alias("jaccard"))


def transitions(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """First-order transition shares a -> b between neighbouring rows of a group."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = rows.select(F.col(state).alias("a"), F.lead(state).over(w).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    return steps.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; the smallest of those that tie."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return top_k(counts, keys, [F.desc("n"), F.col(value)], 1)


def normalised(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """value as a share of its group's sum."""
    return rows.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy(key)))


def unanimous(rows: DataFrame, keys: list[str], rank: str, prefix: str = "x__") -> DataFrame:
    """The one value that all rows of a group share, or `prefix` if they differ."""
    return rows.groupBy(*keys).agg(F.when(F.min(rank) == F.max(rank), F.min(rank)).otherwise(F.lit(prefix)).alias(rank))
