"""One query per operator of the genomic engine, over the given tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.functions import sequences as S
from readloom.operators import consensus, intervals, kernels, variants
from readloom.operators import reads as R
from readloom.plans.views import WITH, aln, reads, regions, table
from readloom.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (WITH.replace("WITH", "WITH RECURSIVE", 1) if recursive else WITH) + "\n" + sql
        return f

    return add


def r6(c: str | F.Column, name: str) -> F.Column:
    return F.round(c, 6).alias(name)


# Filters


@query("SELECT chrom, count(*) AS n FROM aln WHERE (flag & 1796) = 0 GROUP BY chrom")
def flag_filter(spark, d):
    return aln(spark, d).where(A.passes_mask(F.col("flag"), 0x704)).groupBy("chrom").agg(F.count("*").alias("n"))


@query("SELECT chrom, count(*) AS n FROM aln WHERE (flag & 3844) = 0 AND ((flag & 1) = 0 OR (flag & 2) <> 0) GROUP BY chrom")
def good_alignment(spark, d):
    return aln(spark, d).where(A.good_alignment(F.col("flag"))).groupBy("chrom").agg(F.count("*").alias("n"))


@query("SELECT name, chrom, start, mapq, nm FROM aln WHERE mapq >= 30 AND reflen >= 20 AND nm < reflen * 0.1")
def read_filter(spark, d):
    c = F.col
    return aln(spark, d).where((c("mapq") >= 30) & (c("reflen") >= 20) & (c("nm") < c("reflen") * 0.1)).select("name", "chrom", "start", "mapq", "nm")


@query("SELECT name, line, chrom, start FROM aln WHERE (flag & 3844) = 0 AND ((flag & 1) = 0 OR (flag & 2) <> 0) AND line % 5 <> 0 AND reflen >= 15 AND mapq >= 10 AND nm * 10 <= reflen")
def realign_filter(spark, d):
    """Reads fit to realign; those of every fifth line have no MD."""
    c = F.col
    md = F.when(c("line") % 5 != 0, c("reflen").cast("string"))
    return aln(spark, d).where(A.fit_to_realign(c("flag"), md, c("reflen"), c("mapq"), c("nm"), 15, 10, 0.1)).select("name", "line", "chrom", "start")


@query("SELECT chrom, count(*) AS n FROM aln WHERE mapq <= 20 AND nm > 0 AND nm < 0.25 * (reflen - nm) GROUP BY chrom")
def dark_alignments(spark, d):
    c = F.col
    return aln(spark, d).where((c("mapq") <= 20) & (c("nm") > 0) & (c("nm") < 0.25 * (c("reflen") - c("nm")))).groupBy("chrom").agg(F.count("*").alias("n"))


@query("""SELECT chrom, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand, count(*) AS n FROM aln GROUP BY ALL""")
def strand_counts(spark, d):
    return aln(spark, d).groupBy("chrom", F.when(A.has_flag(F.col("flag"), A.REVERSE), "-").otherwise("+").alias("strand")).agg(F.count("*").alias("n"))


@query("SELECT name, chrom, start FROM aln WHERE nm <= 2 AND (flag & 4) = 0")
def filter_by_nm(spark, d):
    return aln(spark, d).where((F.col("nm") <= 2) & ~A.has_flag(F.col("flag"), A.UNMAPPED)).select("name", "chrom", "start")


# Windows and range joins


@query("""SELECT chrom, s AS start, least(s + 100, e) AS "end" FROM (SELECT chrom, min(start) AS b, max("end") AS e FROM regions GROUP BY chrom), LATERAL (SELECT unnest(range(b, e, 100)) AS s)""")
def window_tile(spark, d):
    return intervals.tiles(regions(spark, d).groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end")), 100)


@query("""SELECT chrom, s AS start, least(s + 250, e) AS "end" FROM (SELECT chrom, min(start) AS b, max("end") AS e FROM regions GROUP BY chrom), LATERAL (SELECT unnest(range(b, e, 100)) AS s)""")
def window_step(spark, d):
    return intervals.tiles(regions(spark, d).groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end")), 250, 100)


def _b(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("start", "b_start").withColumnRenamed("end", "b_end")


@query("""SELECT region_id, count(*) AS n, sum(mapq) AS mapq_sum FROM regions r JOIN aln a ON r.chrom = a.chrom AND a.start < r."end" AND a."end" > r.start AND a."end" > a.start WHERE r."end" > r.start GROUP BY region_id""")
def region_overlap_join(spark, d):
    found = intervals.overlap_join(aln(spark, d).select("chrom", "start", "end", "mapq"), _b(regions(spark, d)), 256)
    return found.groupBy("region_id").agg(F.count("*").alias("n"), F.sum("mapq").alias("mapq_sum"))


@query("""SELECT w.chrom, w.start, count(s.pos) AS n FROM (SELECT chrom, unnest(range(b, e, 100)) AS start FROM (SELECT chrom, min(start) AS b, max("end") AS e FROM regions GROUP BY chrom)) w
 LEFT JOIN (SELECT chrom, start AS pos FROM aln GROUP BY ALL HAVING count(*) > 3) s ON s.chrom = w.chrom AND s.pos >= w.start AND s.pos < w.start + 100 GROUP BY ALL""")
def window_snp_count(spark, d):
    sites = aln(spark, d).groupBy("chrom", F.col("start").alias("pos")).agg(F.count("*").alias("hits")).where("hits > 3")
    win = intervals.tiles(regions(spark, d).groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end")), 100).withColumn("a_id", F.concat_ws(":", "chrom", "start"))
    sites = sites.select("chrom", F.col("pos").alias("b_start"), (F.col("pos") + 1).alias("b_end"))
    return intervals.overlap_join(win, sites, 256, "left").groupBy("chrom", "start").agg(F.count("b_start").alias("n"))


@query("""SELECT a.chrom, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS bases, count(*) AS n FROM regions a JOIN regions b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY a.chrom""")
def interval_intersection(spark, d):
    r = regions(spark, d).select("chrom", "start", "end")
    return intervals.intersected(r, _b(r), 256).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.count("*").alias("n"))


@query("""SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 5 THEN 0 ELSE 1 END AS f FROM regions)) GROUP BY chrom, g""")
def interval_merge_gap(spark, d):
    return intervals.merged(regions(spark, d).select("chrom", "start", "end"), 5)


_DEPTH = """, covered AS (SELECT chrom, unnest(range(start, "end")) AS pos FROM aln WHERE "end" > start), depth AS (SELECT chrom, pos, count(*) AS depth FROM covered GROUP BY ALL) """


def _depth(spark, d):
    return intervals.depth(aln(spark, d).where("end > start").select("chrom", "start", "end"))


@query(_DEPTH + "SELECT chrom, pos, depth FROM depth")
def depth_per_base(spark, d):
    return _depth(spark, d)


@query(_DEPTH + "SELECT chrom, min(pos) AS start, max(pos) + 1 AS \"end\", round(avg(depth), 6) AS mean_depth FROM (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM depth WHERE depth >= 200) GROUP BY chrom, g")
def depth_islands(spark, d):
    return intervals.islands(_depth(spark, d), 200).withColumn("mean_depth", F.round("mean_depth", 6))


@query(_DEPTH + "SELECT round(coalesce(avg(depth), 0), 6) AS mean_depth FROM depth")
def mean_depth(spark, d):
    return _depth(spark, d).agg(F.round(F.coalesce(F.avg("depth"), F.lit(0.0)), 6).alias("mean_depth"))


@query(_DEPTH + "SELECT chrom, round(avg(depth), 6) AS mean_depth FROM depth GROUP BY chrom")
def mean_depth_per_chrom(spark, d):
    return _depth(spark, d).groupBy("chrom").agg(r6(F.avg("depth"), "mean_depth"))


@query(_DEPTH + "SELECT chrom, round(quantile_cont(depth, 0.5), 6) AS median_depth FROM depth GROUP BY chrom")
def median_depth_per_chrom(spark, d):
    return _depth(spark, d).groupBy("chrom").agg(r6(F.percentile("depth", 0.5), "median_depth"))


@query(_DEPTH + """SELECT chrom, round(count(*) * 1.0 / (SELECT max("end") FROM aln), 6) AS fraction FROM depth GROUP BY chrom""")
def coverage_fraction(spark, d):
    total = aln(spark, d).agg(F.max("end").alias("total"))
    return _depth(spark, d).groupBy("chrom").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("chrom", r6(F.col("n") / F.col("total"), "fraction"))


@query("SELECT DISTINCT chrom, start, start + 1 AS \"end\" FROM aln")
def read_start_sites(spark, d):
    return aln(spark, d).select("chrom", "start", (F.col("start") + 1).alias("end")).distinct()


@query("SELECT DISTINCT chrom, \"end\" - 1 AS start, \"end\" FROM aln")
def read_end_sites(spark, d):
    return aln(spark, d).select("chrom", (F.col("end") - 1).alias("start"), "end").distinct()


@query("""SELECT c.chrom, coalesce(n, 0) AS n FROM (SELECT DISTINCT chrom FROM aln) c LEFT JOIN (SELECT chrom, count(*) AS n FROM aln WHERE (reflen - nm) * 1.0 / reflen >= 0.95 GROUP BY chrom) USING (chrom)""")
def read_count_per_chrom(spark, d):
    a = aln(spark, d)
    n = a.where((F.col("reflen") - F.col("nm")) / F.col("reflen") >= 0.95).groupBy("chrom").agg(F.count("*").alias("n"))
    return a.select("chrom").distinct().join(n, "chrom", "left").select("chrom", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT chrom, count(*) AS n, sum(abs(mate - start)) AS total, round(avg(abs(mate - start)), 6) AS mean FROM aln WHERE (flag & 3) = 3 AND (flag & 4) = 0 GROUP BY chrom")
def insert_size_stats(spark, d):
    size = F.abs(F.col("mate") - F.col("start"))
    pairs = aln(spark, d).where((F.col("flag").bitwiseAND(3) == 3) & ~A.has_flag(F.col("flag"), A.UNMAPPED))
    return pairs.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(size).alias("total"), r6(F.avg(size), "mean"))


# Alleles and genotypes

_SEEN = """, seen AS (SELECT chrom, start AS pos, substr('ACGT', cast(mate % 4 AS int) + 1, 1) AS ref, substr('ACGT', line % 4 + 1, 1) AS alt, mapq, (flag & 16) <> 0 AS reverse, nm AS bq FROM aln WHERE mapq >= 6) """


def _seen(spark, d):
    pick = lambda c: F.substring(F.lit("ACGT"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    return aln(spark, d).where("mapq >= 6").select("chrom", F.col("start").alias("pos"), pick("mate").alias("ref"), pick("line").alias("alt"), "mapq", A.has_flag(F.col("flag"), A.REVERSE).alias("reverse"), F.col("nm").alias("bq"))


@query(_SEEN + "SELECT chrom, pos, ref, alt, count(*) AS allele_depth, sum(mapq) AS mapq_sum, count(*) FILTER (NOT reverse) AS fwd, count(*) FILTER (reverse) AS rev FROM seen WHERE ref <> alt GROUP BY ALL HAVING count(*) > 2")
def allele_profile_having(spark, d):
    return variants.allele_profile(_seen(spark, d).where("ref <> alt")).where("allele_depth > 2")


@query(_SEEN + _DEPTH.replace("covered", "cov2") + "SELECT s.chrom, s.pos, alt, n AS allele_depth, coalesce(depth, 0) AS depth FROM (SELECT chrom, pos, alt, count(*) AS n FROM seen GROUP BY ALL) s LEFT JOIN depth USING (chrom, pos) WHERE n >= coalesce(depth, 0) * 0.02")
def allele_ratio_having(spark, d):
    profile = variants.allele_profile(_seen(spark, d), ("chrom", "pos", "alt"))
    return variants.with_depth(profile, _depth(spark, d)).where("allele_depth >= depth * 0.02").select("chrom", "pos", "alt", "allele_depth", "depth")


@query(_SEEN + "SELECT chrom, pos, count(*) AS n, round(sqrt(sum(mapq * mapq)) / count(*), 6) AS mapq_l2_over_n FROM seen GROUP BY ALL")
def pileup_mapq(spark, d):
    return _seen(spark, d).groupBy("chrom", "pos").agg(F.count("*").alias("n"), r6(F.sqrt(F.sum(F.col("mapq") * F.col("mapq"))) / F.count("*"), "mapq_l2_over_n"))


@query(_SEEN + """, like_ AS (SELECT chrom, pos, sum(ln(CASE WHEN line = 'r' THEN greatest(1 - e, 1e-6) ELSE e END)) AS l0,
 sum(ln((CASE WHEN line = 'r' THEN greatest(1 - e, 1e-6) ELSE e END + CASE WHEN line = 'a' THEN greatest(1 - e, 1e-6) ELSE e END) / 2)) AS l1,
 sum(ln(CASE WHEN line = 'a' THEN greatest(1 - e, 1e-6) ELSE e END)) AS l2
 FROM (SELECT chrom, pos, CASE alt WHEN 'A' THEN 'r' WHEN 'C' THEN 'a' ELSE 'o' END AS line, pow(10.0, -(bq + 1) / 10.0) AS e FROM seen) GROUP BY ALL),
 p AS (SELECT *, l0 + ln(0.999) AS a, l1 + ln(0.0005) AS b, l2 + ln(0.0005) AS c FROM like_), t AS (SELECT *, greatest(a, b, c) AS top FROM p)
 SELECT chrom, pos, genotype, round(exp(s - top) / (exp(a - top) + exp(b - top) + exp(c - top)), 6) AS posterior FROM (
 SELECT *, 'A/A' AS genotype, a AS s FROM t UNION ALL SELECT *, 'A/C', b FROM t UNION ALL SELECT *, 'C/C', c FROM t)""")
def genotype_posterior(spark, d):
    pile = _seen(spark, d).select("chrom", "pos", F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.col("alt").alias("base"), (F.col("bq") + 1).alias("q"))
    return variants.genotype_posterior(pile).select("chrom", "pos", "genotype", r6("posterior", "posterior"))


_PILE = """, pile AS (SELECT chrom, start AS pos, substr('ACGT', cast(start % 4 AS int) + 1, 1) AS ref, substr('ACGT', line % 4 + 1, 1) AS base, nm + 20 AS bq, mapq, round(1 - nm * 1.0 / reflen, 6) AS match
 FROM aln WHERE (flag & 3844) = 0 AND ((flag & 1) = 0 OR (flag & 2) <> 0) AND mapq >= 10 AND nm <= reflen * 0.2),
 counts AS (SELECT chrom, pos, ref, base, count(*) AS n FROM pile GROUP BY ALL),
 best AS (SELECT chrom, pos, ref, min((-n, base)) FILTER (base <> ref) AS b, sum(n) AS depth FROM counts GROUP BY ALL),
 sites AS (SELECT chrom, pos, ref, b[2] AS alt, -b[1] AS n, depth FROM best WHERE b IS NOT NULL AND -b[1] >= 2 AND -b[1] >= depth * 0.1) """


def _pile(spark, d):
    c = F.col
    good = aln(spark, d).where(A.good_alignment(c("flag")) & (c("mapq") >= 10) & (c("nm") <= c("reflen") * 0.2))
    pick = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    return good.select("chrom", c("start").alias("pos"), pick(c("start")).alias("ref"), pick(c("line")).alias("base"), (c("nm") + 20).alias("bq"), "mapq", F.round(1 - c("nm") / c("reflen"), 6).alias("match"))


@query(_PILE + "SELECT chrom, pos, ref, alt, n, cast(depth AS bigint) AS depth FROM sites")
def candidate_sites(spark, d):
    return variants.candidate_sites(_pile(spark, d))


@query(_PILE + """, weighed AS (SELECT chrom, pos, p.ref, alt, base, pow(10.0, -least(bq, mapq) * CASE WHEN base = p.ref THEN 1.0 ELSE match END / 10) AS e FROM pile p JOIN sites USING (chrom, pos)),
 liked AS (SELECT *, CASE WHEN base = ref THEN greatest(1 - e, 1e-6) ELSE e END AS r, CASE WHEN base = alt THEN greatest(1 - e, 1e-6) ELSE e END AS a FROM weighed),
 sums AS (SELECT chrom, pos, ref, alt, sum(ln(r)) + ln(0.999) AS s0, sum(ln((r + a) / 2)) + ln(0.0005) AS s1, sum(ln(a)) + ln(0.0005) AS s2 FROM liked GROUP BY ALL),
 tops AS (SELECT *, greatest(s0, s1, s2) AS top FROM sums), post AS (SELECT *, exp(s0 - top) / (exp(s0 - top) + exp(s1 - top) + exp(s2 - top)) AS p0, exp(s0 - top) + exp(s1 - top) + exp(s2 - top) AS t FROM tops)
 SELECT chrom, pos, ref, alt, CASE WHEN s1 >= s2 THEN ref || '/' || alt ELSE alt || '/' || alt END AS genotype, round(exp(greatest(s1, s2) - top) / t, 6) AS posterior,
 round(CASE WHEN p0 <= 0 THEN 3000.0 ELSE least(greatest(-10 * log10(p0), 0), 3000) END, 4) AS quality FROM post
 WHERE CASE WHEN p0 <= 0 THEN 3000.0 ELSE least(greatest(-10 * log10(p0), 0), 3000) END >= 13""")
def snp_calls(spark, d):
    out = variants.snp_calls(_pile(spark, d), least_quality=13)
    return out.select("chrom", "pos", "ref", "alt", "genotype", r6("posterior", "posterior"), F.round("quality", 4).alias("quality"))


# Operations of an alignment, written as text from the columns and read back


@query("""SELECT name, line, start + reflen + nm + mate % 7 AS ref_end, reflen + mapq % 9 + nm AS read_len, mapq % 9 AS inserted, mate % 7 AS lost, line AS head, mapq % 5 AS tail, greatest(mapq % 9, mate % 7) AS max_gap,
 1 + CASE WHEN mapq % 9 > 0 THEN 1 ELSE 0 END AS n_matched FROM aln WHERE nm > 0""")
def cigar_measures(spark, d):
    c = F.col
    some = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    text = F.concat(F.lit("2H"), some(c("line"), "S"), some(c("reflen"), "M"), some(c("mapq") % 9, "I"), some(c("mate") % 7, "D"), F.when(c("mapq") % 9 > 0, some(c("nm"), "=")).otherwise(some(c("nm"), "X")), some(c("mapq") % 5, "S"))
    rows = aln(spark, d).where("nm > 0").withColumn("ops", A.cigar(text))
    ops = c("ops")
    return rows.where(A.cigar_text(ops) == text).select(
        "name", "line", A.reference_end(c("start"), ops).alias("ref_end"), A.read_length(ops).alias("read_len"), A.cigar_sum(ops, "I").alias("inserted"), A.cigar_sum(ops, "D").cast("bigint").alias("lost"),
        A.head_clip(ops).alias("head"), A.tail_clip(ops).alias("tail"), A.max_gap(ops).cast("bigint").alias("max_gap"), A.cigar_count(ops, "M=").alias("n_matched"),
    )


@query("""SELECT name, line, mapq + nm + line AS matches, line % 3 + 1 AS mismatches, 1 AS deletes FROM aln""")
def md_measures(spark, d):
    c = F.col
    text = F.concat(c("mapq").cast("string"), F.lit("A"), F.when(c("line") % 3 > 0, "0C").otherwise(""), F.when(c("line") % 3 > 1, "0G").otherwise(""), c("nm").cast("string"), F.lit("^ACGT"), c("line").cast("string"))
    rows = aln(spark, d).withColumn("md", text)
    return rows.select("name", "line", A.md_matches(c("md")).alias("matches"), A.md_mismatches(c("md")).alias("mismatches"), A.md_deletes(c("md")).alias("deletes"))


@query("SELECT chrom, least(start // 500, 3) AS bin, count(*) AS n FROM aln GROUP BY ALL")
def bin_index_histogram(spark, d):
    return aln(spark, d).groupBy("chrom", S.bin_index(F.col("start"), [0, 500, 1000, 1500]).cast("long").alias("bin")).agg(F.count("*").alias("n"))


# Joins by name, ordered and set operators


@query("SELECT name, chrom, start FROM aln WHERE name IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def whitelist_semi(spark, d):
    names = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("name"))
    return R.keep_names(aln(spark, d), names, "name").select("name", "chrom", "start")


@query("SELECT name, chrom, start FROM aln WHERE name NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def blacklist_anti(spark, d):
    names = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("name"))
    return R.drop_names(aln(spark, d), names, "name").select("name", "chrom", "start")


@query("SELECT name, start, CASE WHEN name IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN flag | 4 ELSE flag END AS flag FROM aln")
def mark_unmapped_update(spark, d):
    names = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("name"))
    return R.mark_unmapped(aln(spark, d), names, "name").select("name", "start", "flag")


@query("SELECT name, chrom, start, nm FROM (SELECT *, min(nm) OVER (PARTITION BY name) AS best FROM aln) WHERE nm = best")
def best_hit_ties(spark, d):
    return R.best_hits(aln(spark, d), "name", "nm").select("name", "chrom", "start", "nm")


@query("SELECT name, coalesce(min(nm) FILTER (chrom = 'A') + 1, 0) AS a, coalesce(min(nm) FILTER (chrom = 'N') + 1, 0) AS n, coalesce(min(nm) FILTER (chrom = 'R') + 1, 0) AS r FROM aln GROUP BY name HAVING count(DISTINCT chrom) > 1 AND avg(nm) < 5")
def read_cns_pivot(spark, d):
    a = aln(spark, d)
    kept = a.groupBy("name").agg(F.count_distinct("chrom").alias("k"), F.avg("nm").alias("m")).where("k > 1 and m < 5").select("name")
    wide = a.join(kept, "name", "left_semi").groupBy("name").pivot("chrom", ["A", "N", "R"]).agg(F.min("nm") + 1)
    return wide.select("name", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "ANR"])


@query("SELECT chrom, nm AS mode, n FROM (SELECT chrom, nm, count(*) AS n, row_number() OVER (PARTITION BY chrom ORDER BY count(*) DESC, nm) AS k FROM aln GROUP BY chrom, nm) WHERE k = 1")
def mode_count(spark, d):
    return R.mode(aln(spark, d), ["chrom"], "nm").select("chrom", F.col("nm").alias("mode"), "n")


@query("SELECT user_id, event_id, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events WHERE value > 0")
def posterior_normalise(spark, d):
    return R.normalised(table(spark, d, "events").where("value > 0"), "user_id", "value", "share").select("user_id", "event_id", r6("share", "share"))


@query("SELECT a, b, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY a), 6) AS p FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b")
def markov1_matrix(spark, d):
    return R.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").withColumn("p", F.round("p", 6))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def top_k_per_group(spark, d):
    return R.top_k(table(spark, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "value")


@query("SELECT c_nationkey, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) ELSE 'x__' END AS c_mktsegment FROM customer GROUP BY c_nationkey")
def taxonomy_unanimous(spark, d):
    return R.unanimous(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("SELECT chrom, start, \"end\", 'region' AS origin FROM regions UNION ALL SELECT chrom, start, \"end\", 'read' FROM aln")
def bed_concat(spark, d):
    cols = ("chrom", "start", "end")
    return regions(spark, d).select(*cols, F.lit("region").alias("origin")).unionByName(aln(spark, d).select(*cols, F.lit("read").alias("origin")))


@query("SELECT a.p_brand AS a, b.p_brand AS b, round(count(*) * 1.0 / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard FROM (SELECT DISTINCT p_brand, p_size, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part)) a JOIN (SELECT DISTINCT p_brand, p_size, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part)) b ON a.p_size = b.p_size AND a.p_brand < b.p_brand GROUP BY a.p_brand, b.p_brand")
def jaccard_bins(spark, d):
    return R.jaccard(table(spark, d, "part"), "p_brand", "p_size").withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return windows.windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g""")
def event_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", ["user_id"], "1 hour").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# Sequences


def _runs_sql(inner: str) -> str:
    return f", base AS (SELECT read_id, i, seq[i] AS c FROM reads, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i)), run AS (SELECT read_id, c, count(*) AS len, min(i) AS i FROM (SELECT *, i - row_number() OVER (PARTITION BY read_id, c ORDER BY i) AS g FROM base) GROUP BY read_id, c, g) {inner}"


@query(_runs_sql("SELECT c AS base, len, count(*) AS n FROM run GROUP BY ALL"))
def base_runs(spark, d):
    runs = reads(spark, d).where("length(seq) > 0").select(F.explode(S.base_runs(F.col("seq"))).alias("x"))
    return runs.groupBy(F.col("x.base").alias("base"), F.col("x.len").cast("long").alias("len")).agg(F.count("*").alias("n"))


@query(_runs_sql("SELECT r.read_id, coalesce(max(len), 0) AS longest FROM reads r LEFT JOIN run USING (read_id) GROUP BY r.read_id"))
def longest_base_run(spark, d):
    return reads(spark, d).select("read_id", S.longest_base_run(F.col("seq")).cast("long").alias("longest"))


@query(_runs_sql("SELECT r.read_id, coalesce(string_agg(c, '' ORDER BY i), '') AS signature FROM reads r LEFT JOIN run USING (read_id) GROUP BY r.read_id"))
def seq_signature(spark, d):
    return reads(spark, d).select("read_id", S.signature(F.col("seq")).alias("signature"))


@query("SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM reads")
def revcomp(spark, d):
    return reads(spark, d).select("read_id", S.reverse_complement(F.col("seq")).alias("seq"))


@query("SELECT substr(seq, cast(i AS int), 6) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM reads WHERE length(seq) >= 6) GROUP BY 1")
def kmer_count(spark, d):
    return R.kmer_counts(reads(spark, d), 6)


@query(""", k AS (SELECT sample, substr(seq, cast(i AS int), 5) AS kmer, cast(count(*) AS double) AS n FROM (SELECT sample, seq, unnest(range(1, length(seq) - 3)) AS i FROM reads WHERE length(seq) >= 5) GROUP BY 1, 2),
 m AS (SELECT sample, sqrt(sum(n * n)) AS norm FROM k GROUP BY sample)
 SELECT x.sample AS a, y.sample AS b, round(sum(x.n * y.n) / (any_value(p.norm) * any_value(q.norm)), 6) AS cosine FROM k x JOIN k y ON x.kmer = y.kmer AND x.sample < y.sample JOIN m p ON p.sample = x.sample JOIN m q ON q.sample = y.sample GROUP BY x.sample, y.sample""")
def kmer_cosine(spark, d):
    return R.spectrum_cosine(R.kmer_counts(reads(spark, d), 5, keys=("sample",)), "sample").withColumn("cosine", F.round("cosine", 6))


@query("SELECT seq, min(read_id) AS read_id, count(*) AS n FROM reads GROUP BY seq HAVING count(*) >= 2")
def unique_reads_freq(spark, d):
    return R.unique_sequences(reads(spark, d), 2)


@query("""SELECT share, max(length) AS length FROM (SELECT length, sum(length * n) OVER (ORDER BY length DESC) AS run, sum(length * n) OVER () AS total FROM (SELECT length(seq) AS length, count(*) AS n FROM reads GROUP BY 1)), (SELECT unnest([0.1, 0.5, 0.9]) AS share) s
 WHERE run >= share * total GROUP BY share""")
def nx_stats(spark, d):
    return R.nx(reads(spark, d).select(F.length("seq").cast("long").alias("length")), [0.1, 0.5, 0.9]).select(F.col("share").cast("double").alias("share"), "length")


@query("SELECT read_id, length(seq) AS length, round(length(regexp_replace(seq, '[^GC]', '', 'g')) * 1.0 / length(seq), 6) AS gc FROM reads WHERE length(seq) > 0")
def gc_content(spark, d):
    gc = F.length(F.regexp_replace("seq", "[^GC]", "")) / F.length("seq")
    return reads(spark, d).where("length(seq) > 0").select("read_id", F.length("seq").cast("long").alias("length"), r6(gc, "gc"))


# Consensus graphs: each user's events in order are a path through (place, type)

_STEPS = """, steps AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS base FROM events),
 e AS (SELECT user_id % 16 AS win, pos, base AS u, lead(base) OVER (PARTITION BY user_id ORDER BY pos) AS v FROM steps),
 n AS (SELECT win, pos, u, v, count(*) AS n FROM e WHERE v IS NOT NULL GROUP BY ALL),
 w AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY win, pos, u) AS out_, n * 1.0 / sum(n) OVER (PARTITION BY win, pos, v) AS into_ FROM n) """


def _steps(spark, d, window="user_id % 16"):
    rows = table(spark, d, "events").withColumn("window", F.expr(window))
    return consensus.step_edges(rows, "window", "user_id", ["ts", "event_id"], "event_type")


@query(_STEPS + 'SELECT win AS "window", pos, u, v, n, round(out_, 6) AS "out", round(into_, 6) AS "into" FROM w')
def path_edges(spark, d):
    rows = consensus.weighed(_steps(spark, d))
    return rows.select("window", F.col("u.pos").alias("pos"), F.col("u.base").alias("u"), F.col("v.base").alias("v"), "n", r6("out", "out"), r6("into", "into"))


@query(_STEPS + 'SELECT win AS "window", pos, u, v, n FROM w WHERE n > 1 AND out_ > 0.1')
def edge_pruning(spark, d):
    return consensus.pruned(_steps(spark, d)).select("window", F.col("u.pos").alias("pos"), F.col("u.base").alias("u"), F.col("v.base").alias("v"), "n")


@query()
def top_paths(spark, d):
    """Windows are 64 users each, so there are more of them with more data."""
    return consensus.top_paths(consensus.weighed(_steps(spark, d, "user_id div 64")), 5)


# Kernels, checked by tests against brute force


@query()
def sw_pairs(spark, d):
    """Smith-Waterman of each benchmark passage's letters against those of the next."""
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    pairs = b.select(F.col("item_id").alias("a_id"), F.col("seq").alias("a_seq")).join(b.select(F.col("item_id").alias("b_id"), F.col("seq").alias("b_seq")), F.expr("b_id = a_id + 1"))
    return kernels.aligned_pairs(pairs)


@query()
def haplotype_selection(spark, d):
    """Haplotypes of each 64 orders: suppliers as haplotypes, orders as reads."""
    hits = aln(spark, d).groupBy("chrom", F.col("name").alias("read"), (F.col("mate") % 12).alias("haplotype")).agg(F.min("nm").alias("nm"), F.max("reflen").alias("length"))
    hits = hits.select(F.concat_ws(":", "chrom", F.floor(F.col("read") / 64)).alias("window"), "read", F.lit(1).alias("n"), F.greatest("length", "nm").alias("length"), "haplotype", "nm")
    return kernels.haplotypes(hits)


@query()
def upgma_clusters(spark, d):
    """Average-linkage clusters of the labels, by the cosine distance of the means of all their embeddings."""
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v")).withColumn("key", F.lit(0))  # as many as there are dimensions
    pairs = means.select("key", F.col("label").alias("a"), F.col("v").alias("x")).join(means.select("key", F.col("label").alias("b"), F.col("v").alias("y")), "key").where("a < b")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m * n), F.lit(0.0), lambda s, t: s + t)
    cos = dot(F.col("x"), F.col("y")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))
    return kernels.clusters(pairs.select("key", "a", "b", (1 - cos).alias("d")), "key", 0.9)
