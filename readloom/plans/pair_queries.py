"""Queries on gapped pairs, single-base runs and repeats, over sequences out of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import pairs, repeats, segments
from readloom.plans.queries import query, r6
from readloom.plans.views import reads

# Pairs: of a sequence, every 11th base isn't read, every 7th isn't in the reference, every 13th is read as another one

_BASE = ", base AS (SELECT read_id, i, seq[i] AS c FROM reads, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i))"
_COLS = (
    _BASE
    + """, cols AS (SELECT *, CASE WHEN b = '-' THEN a ELSE b END AS key, a <> b AND a <> '-' AND b <> '-' AS other FROM (
 SELECT read_id, i, CASE WHEN i % 11 = 0 THEN '-' WHEN i % 13 = 0 THEN translate(c, 'ACGT', 'CGTA') ELSE c END AS a, CASE WHEN i % 7 = 0 AND i % 11 <> 0 THEN '-' ELSE c END AS b FROM base))"""
)
_BLOCKS = """, marked AS (SELECT *, sum(CASE WHEN key = k1 AND NOT other AND NOT ({behind} AND o1) THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY i) AS g FROM (
 SELECT *, lag(key) OVER w AS k1, coalesce(lag(other) OVER w, false) AS o1 FROM cols WINDOW w AS (PARTITION BY read_id ORDER BY i))),
 blocks AS (SELECT read_id, g AS i, coalesce(string_agg(a, '' ORDER BY i) FILTER (a <> '-'), '') AS a, coalesce(string_agg(b, '' ORDER BY i) FILTER (b <> '-'), '') AS b FROM marked GROUP BY read_id, g)"""
_ROWS = """, kinds AS (SELECT read_id, i, left(CASE WHEN b = '' THEN a ELSE b END, 1) AS base, length(a) AS read_len, length(b) AS ref_len,
 CASE WHEN b = '' THEN 'insert' WHEN a = '' THEN 'delete' WHEN length(a) = 1 AND length(b) = 1 AND a <> b THEN 'mismatch' WHEN length(a) > length(b) THEN 'over' WHEN length(a) < length(b) THEN 'under' ELSE 'match' END AS kind FROM blocks)"""
_SHIFTED = _COLS + _BLOCKS.format(behind="false")
_KINDS = _COLS + _BLOCKS.format(behind="true") + _ROWS


def _pairs(spark, d) -> DataFrame:
    chars = F.filter(F.split("seq", ""), lambda c: c != "")
    a = F.transform(chars, lambda c, i: F.when((i + 1) % 11 == 0, "-").when((i + 1) % 13 == 0, F.translate(c, "ACGT", "CGTA")).otherwise(c))
    b = F.transform(chars, lambda c, i: F.when(((i + 1) % 7 == 0) & ((i + 1) % 11 != 0), "-").otherwise(c))
    return reads(spark, d).where("length(seq) > 0").select("read_id", "seq", F.array_join(a, "").alias("read"), F.array_join(b, "").alias("ref"))


@query(_SHIFTED + "SELECT read_id, string_agg(rpad(a, cast(greatest(length(a), length(b)) AS int), '-'), '' ORDER BY i) AS read, string_agg(rpad(b, cast(greatest(length(a), length(b)) AS int), '-'), '' ORDER BY i) AS ref FROM blocks GROUP BY read_id")
def shifted_gaps(spark, d):
    return _pairs(spark, d).select("read_id", pairs.shifted(F.col("read"), F.col("ref")).alias("s")).select("read_id", "s.read", "s.ref")


@query(_KINDS + "SELECT kind, base, read_len, ref_len, count(*) AS n FROM kinds GROUP BY ALL")
def run_blocks(spark, d):
    rows = pairs.block_rows(_pairs(spark, d), "read_id").groupBy("kind", "base", "read_len", "ref_len").agg(F.count("*").alias("n"))
    return rows.select("kind", "base", F.col("read_len").cast("long").alias("read_len"), F.col("ref_len").cast("long").alias("ref_len"), "n")


@query(_KINDS + """SELECT ref_len AS len, site, cast(sum(CASE WHEN site >= read_len THEN 1 ELSE 0 END) AS bigint) AS deletes, count(*) AS n, round(sum(CASE WHEN site >= read_len THEN 1 ELSE 0 END) / (count(*) + 1e-9), 6) AS rate
 FROM kinds, LATERAL (SELECT unnest(range(0, ref_len)) AS site) WHERE kind NOT IN ('insert', 'delete') AND ref_len BETWEEN 1 AND 6 GROUP BY ALL""")
def run_site_deletes(spark, d):
    out = pairs.run_site_deletes(pairs.block_rows(_pairs(spark, d), "read_id"))
    return out.select(F.col("len").cast("long").alias("len"), F.col("site").cast("long").alias("site"), "deletes", "n", r6("rate", "rate"))


@query(_KINDS + """, near AS (SELECT kind, base, read_len, ref_len, CASE WHEN lag(kind, 2) OVER w IN ('match', 'over', 'under') AND lag(base, 2) OVER w = base THEN lag(ref_len, 2) OVER w END AS l,
 CASE WHEN lead(kind, 2) OVER w IN ('match', 'over', 'under') AND lead(base, 2) OVER w = base THEN lead(ref_len, 2) OVER w END AS r FROM kinds WINDOW w AS (PARTITION BY read_id ORDER BY i)),
 each AS (SELECT unnest(range(ref_len, read_len)) AS len, 1 AS x, 0 AS y, 0 AS z FROM kinds WHERE kind = 'over' UNION ALL SELECT l, 0, 1, 0 FROM near WHERE kind = 'insert' UNION ALL SELECT r, 0, 0, 1 FROM near WHERE kind = 'insert')
 SELECT len, cast(sum(x) AS bigint) AS next_to, cast(sum(y) AS bigint) AS left_close, cast(sum(z) AS bigint) AS right_close FROM each WHERE len BETWEEN 1 AND 6 GROUP BY len""")
def insert_contexts(spark, d):
    out = pairs.insert_contexts(pairs.block_rows(_pairs(spark, d), "read_id"), "read_id")
    return out.withColumn("len", F.col("len").cast("long"))


_STATES = """, st AS (SELECT read_id, i, a, b, CASE WHEN b = '-' THEN 'I' WHEN a = '-' THEN 'D' ELSE 'M' END AS s FROM cols),
 runs AS (SELECT read_id, s, min(i) AS i, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY read_id, s ORDER BY i) AS g FROM st) GROUP BY read_id, s, g)"""


@query(_COLS + _STATES + """, md AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY i) AS j, CASE WHEN a = '-' THEN 'D' WHEN a = b THEN '=' ELSE 'X' || i END AS k FROM cols WHERE b <> '-'),
 mdr AS (SELECT read_id, left(k, 1) AS k, min(j) AS j, count(*) AS n, string_agg(b, '' ORDER BY j) AS t FROM (SELECT *, j - row_number() OVER (PARTITION BY read_id, k ORDER BY j) AS g FROM md) GROUP BY read_id, k, g),
 mds AS (SELECT *, lag(k) OVER w AS k1, lead(k) OVER w AS k2 FROM mdr WINDOW w AS (PARTITION BY read_id ORDER BY j)),
 mdt AS (SELECT read_id, string_agg(CASE WHEN k = '=' THEN cast(n AS varchar) ELSE (CASE WHEN k1 IS NULL OR k1 <> '=' THEN '0' ELSE '' END) || (CASE WHEN k = 'D' THEN '^' ELSE '' END) || t || (CASE WHEN k2 IS NULL THEN '0' ELSE '' END) END, '' ORDER BY j) AS md FROM mds GROUP BY read_id)
 SELECT read_id, string_agg(cast(n AS varchar) || s, '' ORDER BY i) AS cigar, any_value(md) AS md FROM runs JOIN mdt USING (read_id) GROUP BY read_id""")
def pair_cigar_md(spark, d):
    a, b = F.col("read"), F.col("ref")
    return _pairs(spark, d).select("read_id", segments.pair_cigar(a, b).alias("cigar"), segments.pair_md(a, b).alias("md"))


@query(_COLS + """, refs AS (SELECT *, sum(CASE WHEN b <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i) AS r FROM cols),
 cut AS (SELECT read_id, coalesce(min(i) FILTER (b <> '-' AND r = 6), max(i) + 1) AS f, coalesce(min(i) FILTER (b <> '-' AND r = 11), max(i) + 1) AS l FROM refs GROUP BY read_id)
 SELECT read_id, coalesce(string_agg(a, '' ORDER BY i) FILTER (i < f), '') || 'AC-GT' || coalesce(string_agg(a, '' ORDER BY i) FILTER (i >= l), '') AS read,
 coalesce(string_agg(b, '' ORDER BY i) FILTER (i < f), '') || 'ACTGT' || coalesce(string_agg(b, '' ORDER BY i) FILTER (i >= l), '') AS ref FROM cols JOIN cut USING (read_id) GROUP BY read_id""")
def spliced_pairs(spark, d):
    s = pairs.spliced(F.col("read"), F.col("ref"), F.lit(5), F.lit(5), F.lit("AC-GT"), F.lit("ACTGT"))
    return _pairs(spark, d).select("read_id", s.alias("s")).select("read_id", "s.read", "s.ref")


# Runs and repeats

_RUNS = (
    _BASE
    + """, run AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY start) - 1 AS r FROM (SELECT read_id, c, count(*) AS len, min(i) - 1 AS start FROM (
 SELECT *, i - row_number() OVER (PARTITION BY read_id, c ORDER BY i) AS g FROM base) GROUP BY read_id, c, g))"""
)
_SINGLE = """, single AS (SELECT read_id, min(start) AS start, max(start + len) AS "end" FROM (SELECT *, r - 2 * row_number() OVER (PARTITION BY read_id, r % 2, c ORDER BY r) AS g FROM run WHERE len > 1) GROUP BY read_id, r % 2, c, g HAVING max(len) >= 3)"""
_DOUBLE = """, unit AS (SELECT read_id, shift, i, substr(seq, cast(shift + 2 * i + 1 AS int), 2) AS u FROM reads, (SELECT unnest([0, 1]) AS shift) s, LATERAL (SELECT unnest(range(0, (length(seq) - shift) // 2)) AS i)),
 rep AS (SELECT read_id, shift, min(i) AS i, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY read_id, shift, u ORDER BY i) AS g FROM unit) GROUP BY read_id, shift, u, g HAVING count(*) >= 2),
 pick AS (SELECT *, CASE WHEN coalesce(max(n) FILTER (shift = 0) OVER (PARTITION BY read_id), 0) > coalesce(max(n) FILTER (shift = 1) OVER (PARTITION BY read_id), 0) THEN 0 ELSE 1 END AS f FROM rep),
 double_ AS (SELECT read_id, shift + 2 * i AS start, shift + 2 * i + 2 * n AS "end" FROM pick WHERE shift = f)"""


def _seqs(spark, d) -> DataFrame:
    return reads(spark, d).where("length(seq) > 0").select("read_id", "seq")


def _long(df: DataFrame) -> DataFrame:
    return df.select("read_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(_RUNS + """, near AS (SELECT *, CASE WHEN lag(c, 2) OVER w = c THEN lag(len, 2) OVER w ELSE 0 END AS l, CASE WHEN lead(c, 2) OVER w = c THEN lead(len, 2) OVER w ELSE 0 END AS rr FROM run WINDOW w AS (PARTITION BY read_id ORDER BY r))
 SELECT c AS base, x AS before, len - 1 - x AS after, l AS "left", rr AS "right", count(*) AS n, cast(sum(start + x) AS bigint) AS positions FROM near, LATERAL (SELECT unnest(range(0, len)) AS x) GROUP BY ALL""")
def run_marks(spark, d):
    marks = repeats.run_marks(_seqs(spark, d), "read_id")
    out = marks.groupBy("base", "before", "after", "left", "right").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))
    return out.select("base", *[F.col(c).cast("long").alias(c) for c in ("before", "after", "left", "right")], "n", "positions")


@query(_RUNS + _SINGLE + """SELECT read_id, start, "end" FROM single""")
def single_base_repeats(spark, d):
    return _long(repeats.single_base_repeats(_seqs(spark, d), "read_id", 3))


@query(_DOUBLE + """SELECT read_id, start, "end" FROM double_""")
def two_base_repeats(spark, d):
    return _long(repeats.two_base_repeats(_seqs(spark, d), "read_id", 2))


@query(_RUNS + _SINGLE + _DOUBLE + """, whole AS (SELECT * FROM single UNION ALL SELECT * FROM double_),
 flagged AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY read_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 5 THEN 0 ELSE 1 END AS f FROM whole),
 grouped AS (SELECT *, sum(f) OVER (PARTITION BY read_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM flagged)
 SELECT read_id, min(start) AS start, max("end") AS "end" FROM grouped GROUP BY read_id, g HAVING max("end") - min(start) <= 1000""")
def repeat_regions(spark, d):
    return _long(repeats.repeat_regions(_seqs(spark, d), "read_id", 3, 2))


@query("SELECT read_id, CASE WHEN position('CAT' IN seq) > 0 THEN left(seq, position('CAT' IN seq) - 1) || 'GG' || substr(seq, position('CAT' IN seq) + 3) ELSE seq END AS seq FROM reads")
def replaced_part(spark, d):
    return reads(spark, d).select("read_id", repeats.replaced_part(F.col("seq"), F.lit("CAT"), F.lit("GG")).alias("seq"))
