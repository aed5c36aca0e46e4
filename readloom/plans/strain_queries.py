"""Queries on strains: bins along a sequence, representatives, two-sided clusters, paths of consensus graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.operators import consensus, strains
from readloom.operators import reads as R
from readloom.plans.queries import _STEPS, _steps, query, r6
from readloom.plans.views import aln, reads, table

# Bins: at every 25th part the line numbers are bins of suppliers

_BINS = """, bins AS (SELECT DISTINCT chrom, start // 25 AS position, line AS bin, mate // 5 AS item FROM aln WHERE nm < 2),
 size AS (SELECT chrom, position, bin, count(*) AS size FROM bins GROUP BY ALL),
 step AS (SELECT chrom, position, lag(position) OVER (PARTITION BY chrom ORDER BY position) AS before FROM (SELECT DISTINCT chrom, position FROM size)),
 likes AS (SELECT a.chrom, a.position, a.bin, b.bin AS prev, count(*) * 1.0 / (any_value(x.size) + any_value(y.size) - count(*)) AS j FROM bins a JOIN step s ON s.chrom = a.chrom AND s.position = a.position
 JOIN bins b ON b.chrom = a.chrom AND b.position = s.before AND b.item = a.item JOIN size x ON x.chrom = a.chrom AND x.position = a.position AND x.bin = a.bin JOIN size y ON y.chrom = b.chrom AND y.position = b.position AND y.bin = b.bin GROUP BY a.chrom, a.position, a.bin, b.bin),
 best AS (SELECT chrom, position, bin, prev, j FROM (SELECT *, row_number() OVER (PARTITION BY chrom, position, bin ORDER BY j DESC, prev) AS k FROM likes WHERE j >= 0.05) WHERE k = 1),
 free AS (SELECT s.chrom, s.position, count(*) AS k, count(*) FILTER (t.prev IS NULL) AS n_free, min(o.bin) FILTER (t.prev IS NULL) AS free FROM step s JOIN size o ON o.chrom = s.chrom AND o.position = s.before
 LEFT JOIN (SELECT DISTINCT chrom, position, prev FROM best) t ON t.chrom = s.chrom AND t.position = s.position AND t.prev = o.bin GROUP BY s.chrom, s.position),
 now_ AS (SELECT z.chrom, z.position, z.bin, s.before, b.prev, b.j, f.k, f.n_free, f.free, count(*) OVER w AS n, max(b.j) OVER w AS top FROM size z JOIN step s ON s.chrom = z.chrom AND s.position = z.position AND s.before IS NOT NULL
 JOIN free f ON f.chrom = z.chrom AND f.position = z.position LEFT JOIN best b ON b.chrom = z.chrom AND b.position = z.position AND b.bin = z.bin WINDOW w AS (PARTITION BY z.chrom, z.position, b.prev)),
 links AS (SELECT chrom, position, bin, before, CASE WHEN bool_or(n > 1 AND n < k) OVER (PARTITION BY chrom, position) THEN CASE WHEN j = top THEN prev END ELSE coalesce(prev, CASE WHEN n_free = 1 THEN free END) END AS prev FROM now_)"""


def _bins(spark, d):
    return aln(spark, d).where("nm < 2").select("chrom", F.expr("start div 25").alias("position"), F.col("line").alias("bin"), F.expr("mate div 5").alias("item"))


@query(_BINS + "SELECT chrom, position, bin, before, prev FROM links")
def bin_links(spark, d):
    return strains.bin_links(_bins(spark, d), 0.05)


@query(_BINS + """, edge AS (SELECT concat_ws(':', chrom, position, bin) AS node, concat_ws(':', chrom, before, prev) AS parent, chrom, position, bin, before, prev FROM links WHERE prev IS NOT NULL),
 ends AS (SELECT chrom, position, bin, node FROM edge UNION SELECT chrom, before, prev, parent FROM edge),
 up AS (SELECT chrom, position, bin, node, node AS root FROM ends WHERE node NOT IN (SELECT node FROM edge) UNION ALL SELECT e.chrom, e.position, e.bin, e.node, up.root FROM up JOIN edge e ON e.parent = up.node)
 SELECT chrom, position, bin, root AS component FROM up""", recursive=True)
def ligated_bins(spark, d):
    return strains.ligated(_bins(spark, d), 0.05)


@query("SELECT p_size AS cluster, p_brand AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY cast(regexp_extract(p_brand, '(\\d+)', 1) AS bigint), p_brand) AS k FROM part) WHERE k = 1")
def cluster_representatives(spark, d):
    members = table(spark, d, "part").select(F.col("p_size").alias("cluster"), F.col("p_brand").alias("name"))
    return strains.representatives(members, "cluster", "name")


_ALIKE = """, item AS (SELECT c_nationkey AS id, cast(count(*) AS double) AS weight, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS k FROM customer GROUP BY c_nationkey),
 link AS (SELECT s_nationkey AS a, s_nationkey * 7 % 25 AS b FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY ALL),
 both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 walk AS (SELECT k, [id] AS kept FROM item WHERE k = 1 UNION ALL SELECT item.k, CASE WHEN EXISTS (SELECT 1 FROM both_ WHERE both_.a = item.id AND list_contains(walk.kept, both_.b) AND both_.b <> item.id) THEN walk.kept ELSE list_append(walk.kept, item.id) END FROM walk JOIN item ON item.k = walk.k + 1)"""


@query(_ALIKE + " SELECT unnest(kept) AS id FROM walk WHERE k = (SELECT max(k) FROM item)", recursive=True)
def greedy_representatives(spark, d):
    items = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").cast("double").alias("weight"))
    links = table(spark, d, "supplier").where("s_nationkey % 3 > 0").select(F.col("s_nationkey").alias("a"), (F.col("s_nationkey") * 7 % 25).alias("b")).distinct()
    return strains.greedy_representatives(items, links)


@query()
def two_sided_clusters(spark, d):
    """Clusters of suppliers by the line numbers that their parts came on, per kind of return; tests hold the kernel
    against graphs of separate blocks."""
    hits = aln(spark, d).where("nm < 3").groupBy(F.col("chrom").alias("window"), F.col("line").alias("consensus"), (F.col("mate") % 50).alias("read")).agg((F.min("nm") + 1).alias("cost"))
    return strains.two_sided_clusters(hits, 3)


# Spectra and Jaccard coefficients of two sets


@query(""", k AS (SELECT chrom, sample, substr(seq, cast(i AS int), 4) AS kmer, cast(count(*) AS double) AS n FROM (SELECT chrom, sample, seq, unnest(range(1, length(seq) - 2)) AS i FROM reads WHERE length(seq) >= 4) GROUP BY ALL),
 x AS (SELECT chrom AS a, kmer, sum(n) AS n FROM k GROUP BY ALL), y AS (SELECT sample AS b, kmer, sum(n) AS n FROM k GROUP BY ALL), p AS (SELECT a, sqrt(sum(n * n)) AS m FROM x GROUP BY a), q AS (SELECT b, sqrt(sum(n * n)) AS m FROM y GROUP BY b)
 SELECT x.a, y.b, round(sum(x.n * y.n) / (any_value(p.m) * any_value(q.m)), 6) AS cosine FROM x JOIN y USING (kmer) JOIN p ON p.a IS NOT DISTINCT FROM x.a JOIN q ON q.b IS NOT DISTINCT FROM y.b GROUP BY x.a, y.b""")
def kmer_cosine_two_sets(spark, d):
    counts = R.kmer_counts(reads(spark, d), 4, keys=("chrom", "sample"))
    return R.cosine_between(counts.groupBy("chrom", "kmer").agg(F.sum("n").alias("n")), counts.groupBy("sample", "kmer").agg(F.sum("n").alias("n")), "chrom", "sample").withColumn("cosine", F.round("cosine", 6))


# Consensus graphs


@query(_STEPS + """, ref AS (SELECT win, pos, min_by(base, (-n, base)) AS base FROM (SELECT user_id % 16 AS win, pos, base, count(*) AS n FROM steps GROUP BY ALL) GROUP BY ALL),
 kept AS (SELECT e.*, sum(n) OVER (PARTITION BY e.win, e.pos, v) AS into_n, rv.base IS NOT NULL AS v_on, ru.base IS NOT NULL AS u_on FROM n e LEFT JOIN ref rv ON rv.win = e.win AND rv.pos = e.pos + 1 AND rv.base = v LEFT JOIN ref ru ON ru.win = e.win AND ru.pos = e.pos AND ru.base = u)
 SELECT win AS "window", pos, u, v, n FROM kept WHERE CASE WHEN v_on THEN u_on OR n > 2 ELSE into_n > 3 END""")
def pruned_by_kind(spark, d):
    edge = _steps(spark, d)
    ends = edge.select("window", "v.pos", "v.base", "n").union(edge.where("u.pos = 1").select("window", "u.pos", "u.base", "n"))
    counts = ends.groupBy("window", "pos", "base").agg(F.sum("n").alias("n"))
    first = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_type").alias("base")).where("n = 1")  # users without a step
    counts = counts.union(first.groupBy((F.col("user_id") % 16).alias("window"), F.lit(1).cast("bigint").alias("pos"), "base").agg(F.count("*").alias("n")))
    counts = counts.groupBy("window", "pos", "base").agg(F.sum("n").alias("n"))
    ref = counts.groupBy("window", "pos").agg(F.min_by("base", F.struct(-F.col("n"), F.col("base"))).alias("base"))
    return consensus.pruned_by_kind(edge, ref, 3, 2).select("window", F.col("u.pos").alias("pos"), F.col("u.base").alias("u"), F.col("v.base").alias("v"), "n")


@query(_STEPS + """SELECT win AS "window", '"' || pos || '/0/' || u || '" -> "' || (pos + 1) || '/0/' || v || '" [label="' || n || '"];' AS value FROM n""")
def graph_lines(spark, d):
    return consensus.dot_lines(_steps(spark, d))


@query("""SELECT user_id, least(n, 3) || 'M' || CASE WHEN n > 3 THEN '2D' || (n - 3) || 'M' ELSE '' END AS cigar FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""")
def path_cigars(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    path = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct((i + F.when(i > 3, 2).otherwise(0)).cast("bigint").alias("pos"), F.lit(0).alias("off"), F.lit("A").alias("base")))
    return counts.select("user_id", consensus.path_cigar(path).alias("cigar"))


@query(""", w AS (SELECT user_id AS path_id, user_id % 16 AS win, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS base FROM events),
 span AS (SELECT win, path_id, max(pos) AS high FROM w GROUP BY ALL), place AS (SELECT DISTINCT win, pos FROM w)
 SELECT p.win AS "window", p.pos, CASE WHEN p.pos > high THEN '$' ELSE coalesce(w.base, '-') END AS shown, count(*) AS n FROM place p JOIN span s ON s.win = p.win LEFT JOIN w ON w.path_id = s.path_id AND w.pos = p.pos GROUP BY ALL""")
def vertex_reads(spark, d):
    rows = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("pos"), "event_type")
    path = F.array(F.struct("pos", F.lit(0).alias("off"), F.col("event_type").alias("base")))
    shown = consensus.vertex_reads(rows.select((F.col("user_id") % 16).alias("window"), F.col("user_id").alias("path_id"), path.alias("path")))
    return shown.groupBy("window", "pos", "shown").agg(F.count("*").alias("n"))


@query("""SELECT chrom, pos, alt, allele_depth, v.n AS through FROM (SELECT chrom, start AS pos, substr('ACGT', line % 4 + 1, 1) AS alt, count(*) AS allele_depth FROM aln GROUP BY ALL) a
 JOIN (SELECT chrom, start AS pos, substr('ACGT', cast(mate % 4 AS int) + 1, 1) AS alt, count(*) AS n FROM aln GROUP BY ALL HAVING count(*) > 1) v USING (chrom, pos, alt)""")
def allele_vertices(spark, d):
    pick = lambda c: F.substring(F.lit("ACGT"), (F.col(c) % 4 + 1).cast("int"), F.lit(1)).alias("alt")
    a = aln(spark, d)
    alleles = a.groupBy("chrom", F.col("start").alias("pos"), pick("line")).agg(F.count("*").alias("allele_depth"))
    vertices = a.groupBy("chrom", F.col("start").alias("pos"), pick("mate")).agg(F.count("*").alias("through")).where("through > 1")
    return alleles.join(vertices, ["chrom", "pos", "alt"])


@query(_STEPS + """, ranked AS (SELECT win, pos, u, v, n, row_number() OVER (PARTITION BY win, pos, u ORDER BY n DESC, v) AS k, round(n * 1.0 / sum(n) OVER (PARTITION BY win, pos, u), 6) AS share FROM n) SELECT win AS "window", pos, u, v, share FROM ranked WHERE k <= 2""")
def beam_steps(spark, d):
    rows = consensus.weighed(_steps(spark, d)).select("window", F.col("u.pos").alias("pos"), F.col("u.base").alias("u"), F.col("v.base").alias("v"), "n", r6("out", "share"))
    return R.top_k(rows, ["window", "pos", "u"], [F.desc("n"), F.col("v")], 2).drop("n")
