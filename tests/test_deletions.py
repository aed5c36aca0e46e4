import random

from readloom.operators import deletions as D

R = random.Random(12)
REF = "".join(R.choice("ACGT") for _ in range(6000))


def reference(spark, size=1000, overlap=200):
    return spark.createDataFrame([("c", s, REF[s : s + size + overlap]) for s in range(0, len(REF), size)], "chrom string, start long, seq string")


def clips_of(start, end, n):
    """Reads of a sequence without [start, end): their clipped ends as a mapper leaves them."""
    tail = [("c", "tail", start, REF[end : end + 30 + i]) for i in range(n)]
    head = [("c", "head", end, REF[start - 30 - i : start]) for i in range(n)]
    return tail + head


def shifted(start, end):
    """How many bases the deletion can move to the right and left with the same result."""
    right = next(i for i in range(50) if REF[start + i] != REF[end + i])
    left = next(i for i in range(50) if REF[start - 1 - i] != REF[end - 1 - i])
    return left, right


def test_a_planted_deletion_is_found_once_with_its_support(spark):
    start, end = next((s, s + 500) for s in range(2300, 2400) if shifted(s, s + 500) == (0, 0))
    noisy = [("c", "tail", start, REF[end : end + 18] + "A" + REF[end + 19 : end + 40]), ("c", "tail", start, "".join(R.choice("ACGT") for _ in range(40))), ("c", "head", 1500, "ACGT"), ("c", "head", 1500, None)]
    clips = spark.createDataFrame(clips_of(start, end, 4) + clips_of(start, end, 2) + noisy, "chrom string, side string, pos long, seq string")
    found = D.large_deletions(clips, reference(spark), span=1024).collect()
    best = max(found, key=lambda x: x.support)
    assert (best.start, best.end, best.support, best.ends) == (start, end, 13, ["head", "tail"])
    assert len(found) == 1 or sum(x.support for x in found) <= 14
    merged = D.merged_deletions(D.large_deletions(clips, reference(spark), span=1024)).collect()
    assert [(x.start, x.end) for x in merged if x.support > 1] == [(start, end)]


def test_places_over_the_edges_of_stretches_and_none_elsewhere(spark):
    start, end = next((s, s + 700) for s in range(1280, 1330) if shifted(s, s + 700) == (0, 0))  # the far side spans 2000
    clips = spark.createDataFrame(clips_of(start, end, 3), "chrom string, side string, pos long, seq string")
    found = D.large_deletions(clips, reference(spark), span=2048).collect()
    assert [(x.start, x.end, x.support) for x in found] == [(start, end, 6)]
    other = clips.withColumn("chrom", clips["side"])
    assert D.large_deletions(other, reference(spark)).count() == 0
    assert D.large_deletions(clips.limit(0), reference(spark)).count() == 0


def test_near_deletions_are_merged(spark):
    rows = [("c", 100, 600, 5, ["head"]), ("c", 103, 598, 2, ["tail"]), ("c", 300, 900, 1, ["head"]), ("d", 100, 600, 1, ["head"])]
    out = D.merged_deletions(spark.createDataFrame(rows, "chrom string, start long, end long, support long, ends array<string>"))
    assert sorted(tuple(x) for x in out.collect()) == [("c", 100, 600, 7, ["head", "tail"]), ("c", 300, 900, 1, ["head"]), ("d", 100, 600, 1, ["head"])]


def test_words_of_clips_stay_in_their_task_and_bins_are_dealt(spark, monkeypatch):
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(900))
    stretches = spark.createDataFrame([("c", at, ref[at : at + 400]) for at in range(0, 900, 250)], "chrom string, start long, seq string")
    clips = spark.createDataFrame([(f"{i}", "c", 300, ref[at : at + 40]) for i, at in enumerate(range(420, 720, 20))], "clip string, chrom string, pos long, seq string")
    whole = sorted(map(tuple, D.placed_clips(clips, stretches, span=256).collect()))
    assert [r[0] for r in whole] == sorted(r.clip for r in clips.collect())
    monkeypatch.setattr(D, "SHARE", 2)
    dealt = D.placed_clips(clips, stretches, span=256)
    assert sorted(map(tuple, dealt.collect())) == whole
    assert "posexplode" not in dealt._jdf.queryExecution().toString()  # no table of words that a broadcast could take
