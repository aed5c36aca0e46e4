import pytest
from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.sources import text_formats as T

HEAD = "##fileformat=VCFv4.2\n"
FIXED = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def test_samples_of_a_vcf(spark, tmp_path):
    rows = [[*FIXED, "s1", "s2", "s3"], ["c", "5", ".", "A", "C", "9", "PASS", ".", "GT", "0/1", "1/1", "0/0"]]
    path = tmp_path / "x.vcf"
    path.write_text(HEAD + "\n".join("\t".join(r) for r in rows) + "\n")
    got = [x.value for x in T.keep_samples(spark, ["s3", "s1"], str(path)).collect()]
    assert got == [HEAD.strip(), "\t".join([*FIXED, "s1", "s3"]), "\t".join([*rows[1][:9], "0/1", "0/0"])]
    assert [x.value.count("\t") for x in T.keep_samples(spark, [], str(path)).collect()] == [0, 7, 7]
    with pytest.raises(ValueError, match="s9"):
        T.keep_samples(spark, ["s9"], str(path))


def test_reads_fit_to_realign(spark):
    rows = [(0, "9", 100, 30, 10), (0, "9", 100, 30, 11), (0, None, 100, 30, 0), (4, "9", 100, 30, 0), (1024, "9", 100, 30, 0), (0, "9", 99, 30, 0), (0, "9", 100, 9, 0), (0, "9", 100, None, 0), (1, "9", 100, 30, 0), (3, "9", 100, 30, 0)]
    reads = spark.createDataFrame(rows, "flag int, md string, length int, mapq int, nm int")
    c = F.col
    fit = A.fit_to_realign(c("flag"), c("md"), c("length"), c("mapq"), c("nm"), 100, 10, 0.1)
    assert [x.fit for x in reads.select(fit.alias("fit")).collect()] == [True, False, False, False, False, False, False, False, False, True]
    loose = A.fit_to_realign(c("flag"), c("md"), c("length"), c("mapq"), c("nm"), keep_duplicates=True)
    assert [x.fit for x in reads.select(loose.alias("fit")).collect()] == [True, True, False, False, True, True, True, True, False, True]
