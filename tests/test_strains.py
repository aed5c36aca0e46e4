import numpy as np
from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.operators import consensus, strains
from readloom.sources import text_formats as T


def test_two_sided_clusters_are_separate_blocks(spark):
    rows = [("w", f"c{c}", f"r{r:02}", 1 + (r + c) % 3) for c in range(6) for r in range(30) if c % 3 == r % 3]
    out = strains.two_sided_clusters(spark.createDataFrame(rows, "window string, consensus string, read string, cost int"), 3).collect()
    assert len(out) == 30
    label = {r.read: r.cluster for r in out}
    assert [label[f"r{r:02}"] for r in range(30)] == [r % 3 for r in range(30)]
    weights = np.array([[1.0 if c % 3 == r % 3 else 0 for r in range(30)] for c in range(6)])
    assert strains.cluster_count(weights, np.array([0, 0, 0, 1, 1, 1]), 0.1) == 3


def test_roots(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [("x1", "x0"), ("y", None)], "node string, parent string")
    out = {r.node: r.root for r in strains.roots(links).collect()}
    assert {out[f"n{i}"] for i in range(40)} == {"n0"} and out["x1"] == out["x0"] == "x0" and out["y"] == "y" and len(out) == 43
    assert strains.roots(links.limit(0)).count() == 0


def test_links_of_empty_bins(spark):
    none = spark.createDataFrame([], "chrom string, position long, bin int, item long")
    assert strains.bin_links(none).count() == 0 and strains.ligated(none).count() == 0


def test_path_variants_become_records(spark):
    v = spark.createDataFrame([("w", "p1", 3, "A", "C"), ("w", "p2", 3, "A", "G"), ("w", "p3", 3, "A", "C"), ("w", "p1", 7, "-", "TT"), ("w", "p2", 9, "G", "-")], "window string, path_id string, pos long, ref string, alt string")
    rows = {r.pos: r for r in consensus.merged_variants(v).collect()}
    assert rows[3].alts == ["C", "G"] and [tuple(s) for s in rows[3].samples] == [("p1", 1), ("p2", 2), ("p3", 1)]
    assert set(rows) == {3, 7, 9} and {r.pos for r in consensus.merged_variants(v, skip_gaps=True).collect()} == {3}
    lines = [r.value for r in T.sample_vcf_lines(consensus.merged_variants(v, True).withColumnRenamed("window", "chrom"), ["p1", "p2", "p4"]).collect()]
    assert lines[-1].split("\t") == ["w", "4", ".", "A", "C,G", ".", "PASS", ".", "GT", "1", "2", "0"]


def test_distinct_paths(spark):
    p = spark.createDataFrame([("w", 0, "ACGT"), ("w", 1, "CG"), ("w", 2, "ACGT"), ("w", 3, "TT"), ("v", 0, "CG")], "window string, rank int, sequence string")
    assert {(r.window, r.rank) for r in consensus.distinct_paths(p).collect()} == {("w", 0), ("w", 3), ("v", 0)}
    ref = spark.createDataFrame([("w", "TT")], "window string, sequence string")
    assert {(r.window, r["rank"]) for r in consensus.without_reference(p, ref).collect()} == {("w", 0), ("w", 1), ("w", 2), ("v", 0)}


def test_path_cigar(spark):
    v = lambda pos, off=0: (pos, off, "A")
    df = spark.createDataFrame([([v(3), v(4), v(4, 1), v(4, 2), v(7)],), ([],)], "path array<struct<pos:bigint,off:int,base:string>>")
    assert [r.c for r in df.select(consensus.path_cigar(F.col("path")).alias("c")).collect()] == ["2M2I2D1M", ""]


def test_tags(spark):
    df = spark.createDataFrame([(["NM:i:2", "MD:Z:3:4", "bad", "NM:i:5"],)], "f array<string>").select(A.tags(F.col("f")).alias("t"))
    row = df.select("t", A.with_tag(F.col("t"), "NM", "i", F.lit(7)).alias("u"), A.without_tag(F.col("t"), "MD").alias("w")).first()
    assert row.t == {"NM": ("i", "5"), "MD": ("Z", "3:4")} and row.u["NM"] == ("i", "7") and set(row.w) == {"NM"}


def test_formats(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a\t3\nb\tx\n")
    assert [tuple(r) for r in T.read_frequencies(spark, str(tmp_path / "f.txt")).collect()] == [("a", 3)]
    (tmp_path / "x_chr1_100_350.long_read_pairs").write_text("#0 k\nr1\nr2\n#1\nr3\n")
    bins = T.read_local_bins(spark, str(tmp_path / "x_chr1_100_350.long_read_pairs")).select("start", "end", "bin", "read")
    assert {tuple(r) for r in bins.collect()} == {(100, 350, 0, "r1"), (100, 350, 0, "r2"), (100, 350, 1, "r3")}
    (tmp_path / "m.txt").write_text("read\tc1\tc2\nr1\t1\t0\nr2\t0\t3\n")
    assert {tuple(r) for r in T.read_biadjacency(spark, str(tmp_path / "m.txt")).collect()} == {("r1", "c1", 1.0), ("r2", "c2", 3.0)}
    trees = spark.createDataFrame([(1, "((a:1,b:2)x:0.5,c)r;"), (2, "")], "tree int, text string")
    edges = {r.name: r for r in T.newick_edges(trees).collect()}
    names = {r.node: r.name for r in edges.values()}
    assert {n: names.get(r.parent) for n, r in edges.items()} == {"a": "x", "b": "x", "x": "r", "c": "r", "r": None} and edges["x"].length == 0.5 and edges["b"].length == 2.0
    T.write_model(spark.createDataFrame([("M X", 1.5), ("M", -2.0)], "feature string, weight double"), str(tmp_path / "w"))
    assert {r.weight for r in T.read_model(spark, str(tmp_path / "w")).collect()} == {1.5, -2.0}
    reads = spark.createDataFrame([("p", 65, "AC", "IJ"), ("p", 145, "AACC", "ABCD"), ("q", 65, "G", "I")], "name string, flag int, seq string, qual string")
    one, two = (x.collect() for x in T.pair_fastq(reads))
    assert [tuple(r) for r in one] == [("p", "AC", "IJ")] and [tuple(r) for r in two] == [("p", "GGTT", "DCBA")]


def test_small_windows_are_dealt_to_all_tasks(spark):
    from readloom.operators import kernels, strains

    far = spark.createDataFrame([(f"w{i}", 0, 1, 0.5) for i in range(40)], "window string, a long, b long, d double")
    hits = spark.createDataFrame([(f"w{i}", f"c{s}", s, f"r{s}", 1) for i in range(40) for s in (0, 1)], "window string, consensus string, side int, read string, cost long")
    for found in (kernels.clusters(far, "window", 0.6), strains.cluster_counts(hits, 1e-7), strains.two_sided_clusters(hits, 1)):
        assert found.select("window").distinct().count() == 40 and found.rdd.getNumPartitions() == 4
