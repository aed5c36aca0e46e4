"""Genomic views over the given tables, defined alike for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Aligned reads out of lineitem: flags from the line number, mismatches from the tax.
ALN = """SELECT l_orderkey AS name, l_returnflag AS chrom, l_partkey AS start, l_partkey + cast(l_quantity AS bigint) AS {end},
  cast(l_quantity AS int) AS reflen, cast(round(l_discount * 600) AS int) AS mapq, cast(round(l_tax * 100) AS int) AS nm,
  CASE l_linenumber WHEN 4 THEN 4 WHEN 5 THEN 256 WHEN 6 THEN 512 WHEN 7 THEN 1024 ELSE 0 END
  + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 0 END AS flag, l_suppkey AS mate, l_linenumber AS line
FROM {lineitem}"""
REGIONS = """SELECT p_partkey AS region_id, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom,
  p_partkey AS start, p_partkey + cast(p_size AS bigint) AS {end} FROM {part}"""
READS = """SELECT doc_id AS read_id, lang AS chrom, source AS sample, {strip} AS seq FROM {documents}"""
STRIP_SPARK = "regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '')"
STRIP_SQL = "regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g')"

#: The same, for a WITH clause of the checking SQL.
WITH = f"""WITH aln AS ({ALN.format(end='"end"', lineitem='lineitem')}),
regions AS ({REGIONS.format(end='"end"', part='part')}),
reads AS ({READS.format(strip=STRIP_SQL, documents='documents')})"""


def _from(spark: SparkSession, sf_dir: str, table: str, text: str, **parts: str) -> DataFrame:
    return spark.sql(text.format(**parts, **{table: "{t}"}), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "lineitem", ALN, end="end")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "part", REGIONS, end="end")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "documents", READS, strip=STRIP_SPARK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
