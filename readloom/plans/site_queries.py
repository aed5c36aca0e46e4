"""Queries on sites, blocks, windows and read ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.operators import intervals, sites
from readloom.plans.queries import _DEPTH, _depth, query, r6
from readloom.plans.views import aln, regions, table

# Folds along positions.  In SQL the walk is one step per distinct position

_WALK = """, spot AS (SELECT chrom, s, e, row_number() OVER (PARTITION BY chrom ORDER BY s, e) AS k FROM ({rows})),
 walk AS (SELECT chrom, k, s AS t0, e AS t1 FROM spot WHERE k = 1 UNION ALL
 SELECT spot.chrom, spot.k, CASE WHEN {join} THEN t0 ELSE s END, CASE WHEN {join} THEN greatest(t1, e) ELSE e END FROM walk JOIN spot ON spot.chrom = walk.chrom AND spot.k = walk.k + 1),
 block AS (SELECT chrom, t0 AS start, max(t1) AS "end" FROM walk GROUP BY chrom, t0) """
_SITES = "SELECT DISTINCT chrom, start AS s, start + 1 AS e FROM aln WHERE nm > 6 AND mapq % 4 = 0"


def _sites(spark, d):
    return aln(spark, d).where("nm > 6 and mapq % 4 = 0").select("chrom", F.col("start").alias("pos"))


@query(_WALK.format(rows="SELECT DISTINCT chrom, start AS s, start + 1 AS e FROM aln", join="s - t1 < 0.1 * (s - t0)") + 'SELECT chrom, start, "end" FROM block', recursive=True)
def snp_blocks(spark, d):
    return sites.growing_blocks(aln(spark, d).select("chrom", F.col("start").alias("pos")))


@query(_WALK.format(rows=_SITES, join="s - t1 < 2 AND t1 - t0 < 17") + 'SELECT chrom, start - 5 AS start, "end" + 5 AS "end" FROM block WHERE "end" > start + 1', recursive=True)
def site_clusters(spark, d):
    return sites.site_clusters(_sites(spark, d), flank=5)


@query(_WALK.format(rows='SELECT DISTINCT chrom, start AS s, "end" AS e FROM regions', join="((s >= t0 AND e <= t1) OR (t1 + 2 >= s AND t1 - t0 < 30))") + 'SELECT chrom, start, "end" FROM block', recursive=True)
def merged_sites(spark, d):
    return sites.merged_sites(regions(spark, d).select("chrom", "start", "end"))


@query(_WALK.format(rows=_SITES, join="s - t1 < 0.1 * (s - t0)") + """SELECT chrom, s AS start, s + 1 AS "end", 'site' AS kind FROM block, LATERAL (SELECT unnest(range(start, "end")) AS s) WHERE "end" - start <= 2
 UNION ALL SELECT chrom, greatest(start - 10, 0), "end" + 10, 'window' FROM block WHERE "end" - start > 2""", recursive=True)
def block_tasks(spark, d):
    return sites.block_tasks(sites.growing_blocks(_sites(spark, d)))


# Windows


@query(_DEPTH + """, isle AS (SELECT chrom, min(pos) + 20 AS start, max(pos) + 1 - 20 AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM depth WHERE depth >= 3) GROUP BY chrom, g)
 SELECT chrom, start, "end" FROM isle WHERE "end" - start > 60""")
def trimmed_islands(spark, d):
    return sites.trimmed(intervals.islands(_depth(spark, d), 3), 20, 60).select("chrom", "start", "end")


@query(f""", site AS ({_SITES}), win AS (SELECT DISTINCT chrom, start, "end" FROM regions WHERE "end" > start),
 hits AS (SELECT w.chrom, w.start, w."end", (SELECT count(*) FROM site WHERE site.chrom = w.chrom AND s >= w.start - 30 AND s < w."end" - 30) AS l, (SELECT count(*) FROM site WHERE site.chrom = w.chrom AND s >= w.start + 30 AND s < w."end" + 30) AS r FROM win w)
 SELECT chrom, CASE WHEN l > r THEN start - 30 ELSE start + 30 END AS start, CASE WHEN l > r THEN "end" - 30 ELSE "end" + 30 END AS "end", l AS "left", r AS "right" FROM hits""")
def shifted_windows(spark, d):
    return sites.shifted_windows(regions(spark, d).where("end > start"), _sites(spark, d), 30, 256)


@query("""SELECT chrom, s AS start, least(s + 1000, n) AS "end" FROM (SELECT chrom, max("end") AS n FROM aln GROUP BY chrom), LATERAL (SELECT unnest(range(0, n, 1000)) AS s)""")
def whole_sequence_knots(spark, d):
    lengths = aln(spark, d).groupBy("chrom").agg(F.max("end").alias("length"))
    return intervals.tiles(sites.or_whole(None, lengths), 1000)


@query("""SELECT r.region_id, count(a.chrom) AS n, CASE WHEN any_value(r."end" - r.start) < 5 THEN 'SmallRegion' WHEN count(a.chrom) <= 300 THEN 'NotEnoughRead' ELSE 'Ready' END AS status
 FROM regions r LEFT JOIN aln a ON a.chrom = r.chrom AND a.start < r."end" AND a."end" > r.start AND a."end" > a.start AND r."end" > r.start GROUP BY r.region_id""")
def region_status(spark, d):
    return sites.region_status(regions(spark, d), aln(spark, d), 300, 5, 256)


# Reads as rows: names, clipped ends, intervals


@query("""SELECT chrom, side, pos, count(*) AS n FROM (SELECT chrom, 'head' AS side, start AS pos FROM aln WHERE line >= 3 UNION ALL SELECT chrom, 'tail', start + reflen FROM aln WHERE mapq % 5 >= 3) GROUP BY ALL""")
def clip_sites(spark, d):
    c = F.col
    some = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    ops = A.cigar(F.concat(some(c("line"), "S"), some(c("reflen"), "M"), some(c("mapq") % 5, "S")))
    seq = F.repeat(F.lit("A"), c("line") + c("reflen") + c("mapq") % 5)
    found = aln(spark, d).select("chrom", F.explode(A.clip_sites(ops, c("start"), seq, 3)).alias("x"))
    return found.groupBy("chrom", "x.side", "x.pos").agg(F.count("*").alias("n"))


@query("""SELECT name || CASE WHEN (flag & 1) = 0 THEN '' WHEN line % 4 = 2 THEN '.1' ELSE '.2' END AS read_name, name || ':' || f AS read_id, count(*) AS n
 FROM (SELECT *, flag + CASE WHEN line % 2 = 1 THEN 0 WHEN line % 4 = 2 THEN 64 ELSE 128 END AS f FROM aln) GROUP BY ALL""")
def read_names(spark, d):
    flag = F.col("flag") + F.when(F.col("line") % 2 == 1, 0).when(F.col("line") % 4 == 2, 64).otherwise(128)
    rows = aln(spark, d).select(F.col("name").cast("string").alias("name"), flag.alias("flag"))
    return rows.groupBy(A.read_name(F.col("name"), F.col("flag")).alias("read_name"), A.read_id(F.col("name"), F.col("flag")).alias("read_id")).agg(F.count("*").alias("n"))


@query("""SELECT chrom, start, "end", round((reflen - least(nm, reflen)) * 1.0 / reflen, 6) AS identity, count(*) AS n, sum(line) AS heads FROM aln WHERE reflen > 0 GROUP BY ALL""")
def read_intervals(spark, d):
    c = F.col
    ops = A.cigar(F.concat(c("line").cast("string"), F.lit("S"), c("reflen").cast("string"), F.lit("M")))
    row = A.bed_row(c("chrom"), c("start"), c("name"), c("mapq"), ops, F.least("nm", "reflen"), F.lit(""), F.lit(""))
    rows = aln(spark, d).where("reflen > 0").select(row.alias("r")).select("r.*")
    return rows.groupBy("chrom", "start", "end", r6("identity", "identity")).agg(F.count("*").alias("n"), F.sum("head").alias("heads"))


# Statistics of pairs and sequences


@query("""SELECT chrom, count(*) AS n, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.5), 6) AS median FROM (SELECT chrom, abs(mate - start) AS x FROM aln WHERE (flag & 3) = 3) GROUP BY chrom""")
def insert_size_metrics(spark, d):
    size = aln(spark, d).where(F.col("flag").bitwiseAND(3) == 3).select("chrom", F.abs(F.col("mate") - F.col("start")).alias("x"))
    return size.groupBy("chrom").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), r6(F.avg("x"), "mean"), r6(F.stddev_samp("x"), "sd"), r6(F.percentile("x", 0.5), "median"))


@query("""SELECT chrom, pos, round(count(*) FILTER (b = 'A') * 1.0 / count(*), 6) AS a, round(count(*) FILTER (b = 'C') * 1.0 / count(*), 6) AS c, round(count(*) FILTER (b = 'G') * 1.0 / count(*), 6) AS g, round(count(*) FILTER (b = 'T') * 1.0 / count(*), 6) AS t
 FROM (SELECT chrom, start AS pos, substr('ACGT', line % 4 + 1, 1) AS b FROM aln) GROUP BY ALL""")
def allele_spectrum(spark, d):
    rows = aln(spark, d).select("chrom", F.col("start").alias("pos"), F.substring(F.lit("ACGT"), F.col("line") % 4 + 1, F.lit(1)).alias("b"))
    share = lambda x: r6(F.count(F.when(F.col("b") == x, 1)) / F.count("*"), x.lower())
    return rows.groupBy("chrom", "pos").agg(*map(share, "ACGT"))


@query("""SELECT chrom, round(regr_slope(mapq, nm), 6) AS slope, round(regr_intercept(mapq, nm), 6) AS intercept FROM aln GROUP BY chrom""")
def fitted_line(spark, d):
    return aln(spark, d).groupBy("chrom").agg(r6(F.regr_slope("mapq", "nm"), "slope"), r6(F.regr_intercept("mapq", "nm"), "intercept"))


@query("""SELECT p_partkey AS contig, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE coalesce(n, 0) > 30""")
def contigs_by_count(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("contig")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("contig")).join(counts, "contig", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.where("n > 30")


@query("""SELECT a.name, a.line, coalesce(o_custkey, a.start) AS start FROM aln a LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = a.name""")
def replaced_records(spark, d):
    new = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("new_start"))
    return aln(spark, d).join(new, "name", "left").select("name", "line", F.coalesce("new_start", "start").alias("start"))


@query("""SELECT c_custkey AS id, n_name AS family, r_name AS kingdom, coalesce(depth, 0) AS depth, CASE WHEN coalesce(depth, 0) < 10 THEN 'lowest' WHEN depth < 15 THEN 'low' WHEN depth < 20 THEN 'middle' ELSE 'high' END AS class
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS depth FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def taxa_with_depth(spark, d):
    t = lambda n: table(spark, d, n)
    depth = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("depth"))
    taxa = t("customer").join(t("nation"), F.expr("n_nationkey = c_nationkey")).join(t("region"), F.expr("r_regionkey = n_regionkey"))
    rows = taxa.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("family"), F.col("r_name").alias("kingdom")).join(depth, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return rows.withColumn("class", F.when(F.col("depth") < 10, "lowest").when(F.col("depth") < 15, "low").when(F.col("depth") < 20, "middle").otherwise("high"))


@query("""SELECT a.name, a.line, b.name AS mate_name FROM aln a JOIN aln b ON a.name = b.name WHERE a.line = 1 AND b.line = 2""")
def read_mates(spark, d):
    a = aln(spark, d)
    first, second = a.where("line = 1").select("name", "line"), a.where("line = 2").select("name")
    return first.join(second, "name").select("name", "line", F.col("name").alias("mate_name"))


@query("""SELECT name, flag FROM aln WHERE line = 1 AND name NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL
 SELECT o_orderkey, -1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT name FROM aln WHERE line = 1)""")
def name_difference(spark, d):
    left = aln(spark, d).where("line = 1").select("name", "flag")
    right = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("name"))
    return left.join(right, "name", "left_anti").unionByName(right.join(left, "name", "left_anti").withColumn("flag", F.lit(-1)))
