import random
from math import log

from pyspark.sql import functions as F

from readloom.functions import alignments as A
from readloom.operators import consensus as G
from readloom.operators import error_stats as E


def test_paths_and_edges(spark):
    rows = [("w", 0, "4M", "ACGT"), ("w", 0, "4M", "ACGT"), ("w", 0, "2M1I2M", "ACTGT"), ("w", 0, "2M1D1M", "ACT"), ("w", 1, "1S3M", "TCGT")]
    reads = spark.createDataFrame(rows, "window string, pos long, cigar string, seq string").withColumn("ops", A.cigar(F.col("cigar")))
    paths = reads.select("window", G.path_of(F.col("ops"), F.col("pos"), F.col("seq")).alias("path"))
    got = [[tuple(v) for v in r.path] for r in paths.collect()]
    assert got[2] == [(0, 0, "A"), (1, 0, "C"), (1, 1, "T"), (2, 0, "G"), (3, 0, "T")]
    assert got[3] == [(0, 0, "A"), (1, 0, "C"), (3, 0, "T")] and got[4] == [(1, 0, "C"), (2, 0, "G"), (3, 0, "T")]
    edge = {(tuple(r.u), tuple(r.v)): r.n for r in G.edges(paths).collect()}
    assert edge[(0, 0, "A"), (1, 0, "C")] == 4 and edge[(1, 0, "C"), (2, 0, "G")] == 3 and edge[(1, 0, "C"), (3, 0, "T")] == 1
    kept = G.pruned(G.edges(paths), level=1, share=0.1)
    assert {(tuple(r.u)[0], tuple(r.v)[0]) for r in kept.collect()} == {(0, 1), (1, 2), (2, 3)}
    best = G.top_paths(G.weighed(G.edges(paths)), 3).orderBy("rank").collect()
    assert best[0].sequence == "ACGT" and len(best) == 3
    spine = G.edges(paths.limit(1)).select("window", "u", "v")
    assert G.pruned(G.edges(paths), spine, level=9).count() == 3


def test_best_paths_against_enumeration():
    r = random.Random(1)
    for _ in range(30):
        layers = [[(p, 0, b) for b in "ACG"[: r.randint(1, 3)]] for p in range(5)]
        rows = [(u, v, r.uniform(0.05, 1), r.uniform(0.05, 1)) for a, b in zip(layers, layers[1:], strict=False) for u in a for v in b]
        weight = {(u, v): log(a) + log(b) for u, v, a, b in rows}

        def walk(path):
            if path[-1][0] == 4:
                yield sum(weight[e] for e in zip(path, path[1:], strict=False)) / 4, path
            else:
                for v in layers[path[-1][0] + 1]:
                    yield from walk([*path, v])

        want = sorted((s for u in layers[0] for s, _ in walk([u])), reverse=True)[:4]
        got = [s for s, _ in G.best_paths(rows, 4)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(want, got, strict=True))


def test_path_variants(spark):
    path = [{"pos": p, "off": o, "base": b} for p, o, b in ((0, 0, "A"), (1, 0, "T"), (1, 1, "G"), (1, 2, "G"), (3, 0, "T"))]
    paths = spark.createDataFrame([("w", 1, path)], "window string, path_id int, path array<struct<pos:long,off:int,base:string>>")
    ref = spark.createDataFrame([("w", i, b) for i, b in enumerate("ACGTA")], "window string, pos long, base string")
    out = {(r.pos, r.ref, r.alt) for r in G.path_variants(paths, ref).collect()}
    assert out == {(1, "C", "T"), (2, "G", "-"), (1, "-", "GG")}


def test_error_statistics(spark):
    runs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (8, 9), (0, 3), (3, 0)], "ref_run int, read_run int")
    assert {tuple(r) for r in E.run_length_calls(runs).collect()} == {(1, 2, 1, 0), (2, 1, 0, 1), (6, 1, 1, 0)}
    reads = spark.createDataFrame([(0, 13, "13M", "ACGTTTGCCCAGT", "I" * 13, "7A5")], "pos long, end long, cigar string, seq string, qual string, md string").withColumn("ops", A.cigar(F.col("cigar")))
    assert [tuple(r) for r in E.by_read_position(reads, [0, 5, 10]).collect()] == [(1, 1, 1.0)]
