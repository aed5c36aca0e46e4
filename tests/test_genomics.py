import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.functions import sequences as S
from readloom.operators import intervals, kernels, rules, variants
from readloom.operators import reads as R
from readloom.operators.sites import growing_blocks
from readloom.sources import text_formats as T

SAM = [
    "@HD\tVN:1.4\tSO:coordinate",
    "@SQ\tSN:chr1\tLN:13",
    "@CO\tmade by hand",
    "r1\t0\tchr1\t1\t60\t13M\t*\t0\t0\tACGTTTGACCAGT\tIIIIIIIIIIIII\tNM:i:0\tMD:Z:13",
    "r2\t16\tchr1\t1\t50\t13M\t*\t0\t0\tACGTTTGCCCAGT\tIIIIIIIIIIIII\tNM:i:1\tMD:Z:7A5",
    "r3\t0\tchr1\t1\t40\t3M2D8M\t*\t0\t0\tACGTGACCAGT\tIIIIIIIIIII\tNM:i:2\tMD:Z:3^TT8",
    "r4\t0\tchr1\t3\t40\t3M1I4M\t=\t9\t0\tGTTATGAC\tIIIIIIII\tNM:i:1\tMD:Z:7",
    "r5\t0\tchr1\t5\t30\t2S5M\t*\t0\t0\tCCTTGAC\tIIIIIII\tNM:i:0\tMD:Z:5",
    "r6\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII",
]


@pytest.fixture(scope="module")
def sam(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("sam") / "x.sam"
    p.write_text("\n".join(SAM) + "\n")
    return str(p)


@pytest.fixture(scope="module")
def aligned(spark, sam):
    return T.read_sam(spark, sam)


def test_sam(spark, sam, aligned, tmp_path):
    rows = {r.name: r for r in aligned.collect()}
    assert len(rows) == 6 and rows["r6"].chrom is None and rows["r4"].mate_chrom == "chr1" and rows["r4"].mate_pos == 8
    assert [rows[f"r{i}"].end for i in (1, 3, 5)] == [13, 13, 9]
    assert T.reference_dict(T.sam_header(spark, sam)).collect() == [("chr1", 13)]
    T.write_sam(aligned, str(tmp_path / "out"))
    again = T.read_sam(spark, str(tmp_path / "out")).drop("file")
    assert sorted(map(str, again.collect())) == sorted(map(str, aligned.drop("file").collect()))


def test_cigar_and_md(aligned):
    c = F.col
    ops = c("ops")
    rows = {r.name: r for r in aligned.where("md is not null").select(
        "name", A.read_length(ops).alias("rl"), A.head_clip(ops).alias("head"), A.tail_clip(ops).alias("tail"), A.cigar_text(ops).alias("text"), A.md_matches(c("md")).alias("m"), A.md_mismatches(c("md")).alias("x"), A.md_deletes(c("md")).alias("d"), A.max_gap(ops).alias("gap"), A.cigar_count(ops, "I").alias("i"),
        A.mismatches(ops, c("pos"), c("seq"), c("qual"), c("md")).alias("mis"), A.inserts(ops, c("pos"), c("seq"), c("qual")).alias("ins"), A.deletes(ops, c("pos"), c("md")).alias("dels"),
    ).collect()}
    assert rows["r1"].mis == [] and rows["r1"].m == 13
    assert rows["r2"].mis == [(7, "A", "C", 40)] and rows["r2"].x == 1
    assert rows["r3"].dels == [(3, "TT")] and rows["r3"].rl == 11 and rows["r3"].d == 1 and rows["r3"].gap == 2 and rows["r3"].mis == []
    assert rows["r4"].ins == [(5, "A", "I")] and rows["r4"].i == 1
    assert rows["r5"].head == 2 and rows["r5"].tail == 0 and rows["r5"].rl == 5 and rows["r5"].text == "2S5M"


def test_variant_profile(aligned):
    reads = aligned.where(A.good_alignment(F.col("flag")))
    depth = intervals.depth(reads.select("chrom", F.col("pos").alias("start"), "end"))
    out = {tuple(r)[1:] for r in variants.variant_profile(reads, depth, 0, 0).collect()}
    assert out == {(7, 8, "A", "C", 1, 5, "snp"), (5, 6, "-", "A", 1, 5, "ins"), (3, 4, "T", "-", 1, 4, "del"), (4, 5, "T", "-", 1, 5, "del")}
    assert variants.variant_profile(reads, depth, 1, 1).count() == 0  # more than, not at least
    assert {r.pos for r in variants.observations(reads, compat_insert=True).where("ref = '-'").collect()} == {3}


def test_flags(spark):
    df = spark.createDataFrame([(f,) for f in (0, 4, 256, 512, 1024, 3, 1)], "flag int")
    assert [r.flag for r in df.where(A.passes_mask(F.col("flag"), 0x704)).collect()] == [0, 3, 1]
    assert [r.flag for r in df.where(A.good_alignment(F.col("flag"))).collect()] == [0, 3]
    assert [r.flag for r in df.where(A.good_alignment(F.col("flag"), True)).collect()] == [0, 1024, 3]


def test_sequences(spark):
    df = spark.createDataFrame([("AACCCGT",), ("ACGTN",), ("ACGACG",), ("",)], "s string")
    rows = df.select(S.signature(F.col("s")), S.longest_base_run(F.col("s")), S.reverse_complement(F.col("s")), S.ambiguous(F.col("s"))).collect()
    assert rows[0][:2] == ("ACGT", 3) and rows[1][2] == "NACGT" and rows[1][3] == 1 and rows[3][:3] == ("", 0, "")
    assert {(r.kmer, r.n) for r in R.kmer_counts(spark.createDataFrame([("ACGACG",), ("AC",)], "seq string"), 3).collect()} == {("ACG", 2), ("CGA", 1), ("GAC", 1)}
    assert S.kmers and [x.start for x in spark.createDataFrame([("chr1:3-7",), ("chr1:3..7",), ("chr1:5",), ("chr1",)], "t string").select(S.region(F.col("t")).alias("r")).select("r.*").collect()] == [2, 2, 4, None]
    q = spark.createDataFrame([(100.0, 40.0), (50.0, 0.0)], "a double, b double").select(S.mapping_quality(F.col("a"), F.col("b"))).collect()
    assert q[0][0] == math.floor(-4.343 * math.log(1 - 0.6)) + 4 and q[1][0] == 254


def test_intervals_against_brute_force(spark):
    r = random.Random(1)
    a = [(f"c{r.randint(0, 1)}", s := r.randint(0, 400), s + r.randint(0, 60)) for _ in range(150)]
    b = [(f"c{r.randint(0, 1)}", s := r.randint(0, 400), s + r.randint(0, 90)) for _ in range(60)]
    left, right = spark.createDataFrame(a, "chrom string, start long, end long"), spark.createDataFrame(b, "chrom string, b_start long, b_end long")
    want = sorted((c, x, y, p, q) for c, x, y in a for k, p, q in b if c == k and x < q and p < y and x < y and p < q)
    for size in (16, 1000):
        assert sorted(map(tuple, intervals.overlap_join(left, right, size).select("chrom", "start", "end", "b_start", "b_end").collect())) == want
    depth = {(x.chrom, x.pos): x.depth for x in intervals.depth(left.where("end > start")).collect()}
    assert sum(depth.values()) == sum(y - x for _, x, y in a) and all(d == sum(c == k and x <= p < y for k, x, y in a) for (c, p), d in depth.items())
    tiles = intervals.tiles(left.where("end > start"), 7).collect()
    assert sum(t.end - t.start for t in tiles) == sum(y - x for _, x, y in a)
    once = intervals.merged(left.where("end > start"), 0)
    twice = intervals.merged(once.select("chrom", "start", "end"), 0)
    assert sorted((x.chrom, x.start, x.end) for x in once.collect()) == sorted((x.chrom, x.start, x.end) for x in twice.collect())


@pytest.mark.parametrize("span", [1, 16, 10_000])
def test_stretches_change_nothing(spark, span):
    r = random.Random(3)
    a = [(r.choice(["c0", "c1", None]), s := r.randint(0, 300), s + r.choice([0, 1, 4, 90])) for _ in range(60)]
    rows = spark.createDataFrame(a, "chrom string, start long, end long")
    deep = {(c, p): n for c in ("c0", "c1", None) for p in range(400) if (n := sum(k == c and x <= p < y for k, x, y in a))}
    got = intervals.depth(rows, span)
    assert {(x.chrom, x.pos): x.depth for x in got.collect()} == deep and got.count() == len(deep)
    for gap in (0, 3):
        want: list = []
        for c, x, y in sorted(a, key=lambda v: (v[0] or "", v[1], v[2])):
            if want and want[-1][0] == c and x - want[-1][2] <= gap:
                want[-1][2:] = [max(y, want[-1][2]), want[-1][3] + 1]
            else:
                want.append([c, x, y, 1])
        assert sorted(map(repr, (list(x) for x in intervals.merged(rows, gap, span).collect()))) == sorted(map(repr, want))
    want = []
    for (c, p), n in sorted(deep.items(), key=lambda v: (v[0][0] or "", v[0][1])):
        if n >= 2 and want and want[-1][:2] == [c, p - 1]:
            want[-1] = [c, p, want[-1][2], want[-1][3] + n]
        elif n >= 2:
            want.append([c, p, p, n])
    want = [(c, s, e + 1, round(n / (e + 1 - s), 9)) for c, e, s, n in want]
    assert sorted(((x.chrom, x.start, x.end, round(x.mean_depth, 9)) for x in intervals.islands(got, 2, span).collect()), key=repr) == sorted(want, key=repr)
    sizes = [r.randint(0, 60) for _ in range(80)]
    got = {float(x.share): x.length for x in R.nx(spark.createDataFrame([(n,) for n in sizes], "length long"), [0.1, 0.5, 0.9], span).collect()}
    assert got == {q: max(n for n in sizes if sum(x for x in sizes if x >= n) >= q * sum(sizes)) for q in (0.1, 0.5, 0.9)}


def test_posteriors_sum_to_one(spark):
    r = random.Random(2)
    pile = spark.createDataFrame([("c", p, "A", "G", r.choice("AAGN"), r.randint(5, 40)) for p in range(20) for _ in range(r.randint(1, 300))], "chrom string, pos long, ref string, alt string, base string, q int")
    out = variants.genotype_posterior(pile).groupBy("pos").agg(F.sum("posterior").alias("s")).collect()
    assert len(out) == 20 and all(abs(x.s - 1) < 1e-9 for x in out)
    assert variants.genotypes(["A", "G"], 3) == [("A", "A", "A"), ("A", "A", "G"), ("G", "G", "G")]


def plain_alignment(a, b, local):
    low = -(10**9)
    n, m = len(a), len(b)
    h, e, f = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    h[0][0] = best = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if j:
                e[i][j] = max(h[i][j - 1] - 3, e[i][j - 1] - 1)
            if i:
                f[i][j] = max(h[i - 1][j] - 3, f[i - 1][j] - 1)
            d = h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -2) if i and j else low
            h[i][j] = max(h[i][j] if i == j == 0 else low, d, e[i][j], f[i][j], 0 if local else low)
            best = max(best, h[i][j])
    return best if local else h[n][m]


def test_alignment_against_brute_force(spark):
    r = random.Random(3)
    for _ in range(120):
        a, b = ("".join(r.choice("ACGT") for _ in range(r.randint(0, 14))) for _ in range(2))
        assert kernels.align(a, b)[0] == plain_alignment(a, b, True)
        assert kernels.align(a, b, local=False)[0] == plain_alignment(a, b, False)
    pairs = spark.createDataFrame([(1, 2, "ACGTACGT", "TACGTA")], "a_id long, b_id long, a_seq string, b_seq string")
    assert kernels.aligned_pairs(pairs).collect()[0].score == 10


def test_clusters_and_haplotypes(spark):
    x = np.array([0, 0.1, 0.2, 5, 5.1, 9])
    assert kernels.average_linkage(abs(x[:, None] - x), 1).tolist() == [0, 0, 0, 1, 1, 2]
    r = np.random.default_rng(4)
    truth = r.integers(0, 2, 200)
    hits = [("w", f"r{i}", 1, 100, f"h{h}", int(r.integers(0, 2)) if h == truth[i] else int(r.integers(5, 9))) for i in range(200) for h in range(2)]
    hits += [("w", f"r{i}", 1, 100, "h2", 7) for i in range(200)]
    out = kernels.haplotypes(spark.createDataFrame(hits, "window string, read string, n long, length long, haplotype string, nm long")).collect()
    assert {x.haplotype for x in out} == {"h0", "h1"} and abs(sum(x.abundance for x in out) - 1) < 1e-6


def test_blocks(spark):
    sites = spark.createDataFrame([("c", p) for p in (10, 11, 12, 40, 100)], "chrom string, pos long")
    assert [(x.start, x.end) for x in growing_blocks(sites).orderBy("start").collect()] == [(10, 13), (40, 41), (100, 101)]


def test_blocks_go_on_over_stretches(spark):
    r = np.random.default_rng(8)
    pos = {c: np.unique(np.cumsum(r.choice([1, 2, 5, 30, 200], 400, p=[0.5, 0.2, 0.15, 0.1, 0.05]))).tolist() for c in "ab"}
    want = set()
    for c, places in pos.items():
        left = right = None
        for p in places:
            if left is not None and p - right < 0.1 * (p - left):
                right = p + 1
            else:
                want |= {(c, left, right)} if left is not None else set()
                left, right = p, p + 1
        want.add((c, left, right))
    sites = spark.createDataFrame([(c, p) for c in pos for p in pos[c] * 2], "chrom string, pos long")
    for span in (50, 700, 1_000_000):
        assert {tuple(x) for x in growing_blocks(sites, span=span).select("chrom", "start", "end").collect()} == want


def test_snp_calls(spark):
    rows = [("c", 5, "A", b, 30, 40, 0.98) for b in "AAAAACCCCC"] + [("c", 6, "A", b, 30, 40, 0.98) for b in "GGGGGGG"] + [("c", 7, "A", b, 30, 40, 0.98) for b in "AAAAAAAAAC"]
    pile = spark.createDataFrame(rows, "chrom string, pos long, ref string, base string, bq int, mapq int, match double")
    assert {(x.pos, x.alt, x.genotype) for x in variants.snp_calls(pile).collect()} == {(5, "C", "A/C"), (6, "G", "G/G")}
    q = variants.allele_quality(F.col("base"), F.col("ref"), F.col("bq"), F.col("mapq"), F.col("match"))
    shown = spark.createDataFrame([("A", "A", 30, 20, 0.5), ("C", "A", 30, 20, 0.5), ("-", "A", 10, 20, 0.5)], "base string, ref string, bq int, mapq int, match double")
    assert [x[0] for x in shown.select(q).collect()] == [20, 10, 10]


def test_rules(spark):
    df = spark.createDataFrame([("read_1", 5), ("read_22", 50), ("other", 7)], "name string, mapq int")
    f = {"a": rules.token(F.col("name"), "read*"), "b": rules.token(F.col("mapq"), ">=10", True), "c": rules.token(F.col("name"), "*ther")}
    names = lambda rule: [r.name for r in df.where(rules.combine(rule, f)).collect()]
    assert names("a & !b") == ["read_1"] and names("(a & b) | c") == ["read_22", "other"] and names(None) == ["read_1", "read_22", "other"] and names("!(a | b)") == ["other"]
    with pytest.raises(ValueError):
        rules.combine("(a", f)


def test_text_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    fa = T.read_fasta(spark, put("a.fa", ">c1 first one\nACGT\nAC\n>c2\nGG\n"))
    assert [tuple(r) for r in fa.orderBy("name").collect()] == [("c1", "first one", "ACGTAC"), ("c2", "", "GG")]
    assert T.base_at(fa, "c1", 1, 4).first().seq == "CGT"
    fq = T.read_fastq(spark, put("a.fq", "@r1 x\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n")).orderBy("name").collect()
    assert [tuple(r) for r in fq] == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]
    bed = T.read_bed(spark, put("a.bed", "track x\nc1\t0\t5\tn\t1\t+\nc1\t9\t3\nbad\n")).collect()
    assert len(bed) == 1 and (bed[0].start, bed[0].end) == (0, 5)
    rows = spark.createDataFrame([("c1", 4, "A", "G", 31.5, 9, 4, "0/1")], "chrom string, pos long, ref string, alt string, quality double, depth long, allele_depth long, genotype string")
    T.vcf_lines(rows).write.text(str(tmp_path / "vcf"))
    v = T.read_vcf(spark, str(tmp_path / "vcf")).collect()
    assert len(v) == 1 and v[0].pos == 4 and v[0].alts == ["G"] and v[0].quality == 31.5
    tax = T.read_taxonomy(spark, put("t.txt", "o1\tBacteria; Firm;C\n")).first()
    assert (tax.otu_id, tax.phylum, tax.species) == ("o1", "Firm", None)
    assert T.read_triples(spark, put("d.txt", "a b 0.5\nbad\n")).collect() == [("a", "b", 0.5)]
    model = T.read_model(spark, put("m.txt", "name\nM X -1.5\nI D 2e-3\n")).collect()
    assert [tuple(r) for r in model] == [("M X", -1.5), ("I D", 0.002)]
