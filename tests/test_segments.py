from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.operators import segments as G

REF = "ACGTTTGACCAGT"
READS = [(0, "13M", REF, "13"), (0, "13M", "ACGTTTGCCCAGT", "7A5"), (0, "3M2D8M", "ACGTGACCAGT", "3^TT8"), (2, "3M1I4M", "GTTATGAC", "7"), (4, "2S5M", "CCTTGAC", "5"), (0, "4M2D3M", "TCGGGTC", "0A2T0^TT1A1")]


def frame(spark):
    rows = [(f"r{i}", "c", p, c, s, m) for i, (p, c, s, m) in enumerate(READS)]
    df = spark.createDataFrame(rows, "name string, chrom string, start long, cigar string, seq string, md string").withColumn("ops", A.cigar(F.col("cigar")))
    return df.withColumn("end", A.reference_end(F.col("start"), F.col("ops")))


def test_gapped_pairs_give_back_cigar_and_md(spark):
    c = F.col
    df = frame(spark).select("*", G.gapped_read(c("ops"), c("start"), c("seq")).alias("a"), G.gapped_reference(c("ops"), c("start"), F.lit(REF), F.lit(0)).alias("b"))
    rows = df.select("name", "cigar", "md", "a", "b", G.pair_cigar(c("a"), c("b")).alias("cigar2"), G.pair_md(c("a"), c("b")).alias("md2"), G.gap_counts(c("a"), c("b")).alias("n")).collect()
    for r in rows:
        assert len(r.a) == len(r.b)
        assert r.cigar2 == r.cigar.removeprefix("2S")
        assert r.md2 == r.md
    assert rows[3].a == "GTTATGAC" and rows[3].b == "GTT-TGAC" and rows[2].n.deletes == 2
    assert rows[5].b == "ACGTTTGAC" and rows[5].a == "TCGG--GTC" and rows[5].md2 == "0A2T0^TT1A1"


def test_crop(spark):
    regions = spark.createDataFrame([(1, "c", 3, 6), (2, "c", 5, 8), (3, "d", 0, 9)], "region_id long, chrom string, start long, end long")
    out = {(r.region_id, r.name): (r.segment, r.offset) for r in G.cropped(frame(spark).drop("md"), regions, 4).collect()}
    assert out[1, "r0"] == ("TTT", 0) and out[2, "r1"] == ("TGC", 0) and out[2, "r3"] == ("TGA", 0) and out[1, "r3"] == ("TTAT", 0)
    assert out[1, "r2"] == ("T", 0) and (3, "r0") not in out
    u = G.unique_segments(G.cropped(frame(spark), regions, 4)).where("region_id = 1 and segment = 'TTT'").first()
    assert u.n == 2 and u.name == "r0"


def test_repeats_and_simulation(spark):
    df = spark.createDataFrame([("c1", "GGAAAAATCACACACGG"), ("c2", "")], "name string, seq string")
    one, two = df.select(G.tandem_repeats(F.col("seq"), 1, 4).alias("m"), G.tandem_repeats(F.col("seq"), 2, 3).alias("d")).first()
    assert [tuple(x) for x in one] == [(2, "A", 5)] and [tuple(x) for x in two] == [(8, "CA", 3)]
    long = spark.createDataFrame([("c1", "ACGT" * 5000)], "name string, seq string")
    hits = G.mutated(long, 0.01, 3)
    rows = hits.collect()
    assert 120 < len(rows) < 290 and all(r.ref != r.alt and r.ref == "ACGT"[r.pos % 4] for r in rows)
    assert sorted(rows) == sorted(G.mutated(long.repartition(3), 0.01, 3).collect())
    new = G.applied(long, hits).first().seq
    assert sum(a != b for a, b in zip(new, "ACGT" * 5000, strict=True)) == len(rows)
    clades = spark.createDataFrame([("a", 90.0), ("a", 6.0), ("a", 4.0), ("b", 1.0)], "clade string, depth double")
    assert {tuple(r) for r in G.clade_threshold(clades, "clade", "depth").collect()} == {("a", 90.0, 6.0), ("b", 1.0, 1.0)}
