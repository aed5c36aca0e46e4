import hashlib
import random
import re

from pyspark.sql import functions as F

from readloom.llm import spotsigs as S


def brute_sigs(text):
    words = re.findall(r"[^\W_]+", text.lower())
    out = set()
    for i, w in enumerate(words):
        if w in S.ANCHORS:
            rest = [x for x in words[i + 1 :] if x not in S.ANCHORS][: S.CHAIN]
            if len(rest) == S.CHAIN:
                out.add(" ".join([w, *rest]))
    return out or set(words) or ({text.lower()} if text else set())


def jaccard(a, b):
    if not a and not b:
        return 1.0
    j = len(a & b) / len(a | b)
    return 0.0 if not a or not b else j


def sample(n=60, seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "a", "und", "Cat", "dog", "été", "x1", "über.", "run,", "far", "The", "is"]
    texts = [None, "", "!!", "the", "the cat", "a b", "é😀", "cat dog", "the THE the cat dog", "the cat of a dog", "the cat the cat the dog " * 60]
    return texts + [" ".join(r.choice(vocab) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_signatures_equal_brute_force(spark):
    texts = [t or "" for t in sample(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    hashes = {s: h for s, h in spark.createDataFrame([(s,) for s in set().union(*map(brute_sigs, texts))], "s string").select("s", F.xxhash64("s")).collect()}
    for i, sigs in df.select("i", S.signatures(F.col("t"))).collect():
        assert set(sigs) == {hashes[s] for s in brute_sigs(texts[i])} and sigs == sorted(sigs), texts[i]


def test_report_equals_brute_force(spark):
    texts = sample()
    rows = [(3 * i - 40, t, "z", "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, head string").repartition(5)
    got = {x.doc_id: x for x in S.neighbour_report(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (doc_id, text, *_) in enumerate(rows):
        t, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        x = got[doc_id]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(x.near_edited - jaccard(brute_sigs(t), brute_sigs(edited))) < 1e-9
        assert abs(x.near_next - jaccard(brute_sigs(t), brute_sigs(after))) < 1e-9
        assert prints.setdefault(frozenset(brute_sigs(t)), x.fingerprint) == x.fingerprint
        assert prints.setdefault(frozenset(brute_sigs(edited)), x.edited_fingerprint) == x.edited_fingerprint
    assert len(set(prints.values())) == len(prints)


def test_odd_tables(spark):
    one = spark.createDataFrame([(5, "the cat dog the cat dog")], "doc_id long, text string")
    assert [x.near_next for x in S.neighbour_report(one).collect()] == [1.0]
    assert S.neighbour_report(one.limit(0)).count() == 0
    odd = [(None, "the cat dog"), (None, "a"), (None, "the cat dog"), (1, "of cat dog"), (1, "of cat dog"), (1, "the cow ran off to the far field"), (2, None), (7, "end of the known world")]
    table = spark.createDataFrame(odd, "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_chars, x.edited_sha256, round(x.near_next, 9)) for x in S.neighbour_report(table).collect())
    largest = {}
    for i, t in odd:
        largest[i] = max(largest.get(i, ""), t or "")
    order = [None, 1, 2, 7]
    want = []
    for i, t in odd:
        t, after = t or "", largest[order[(order.index(i) + 1) % 4]]
        q = len(t) // 4
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest(), round(jaccard(brute_sigs(t), brute_sigs(after)), 9)))
    assert got == sorted(want)


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(1, "the cat dog"), (2, "a cat")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", S.neighbour_report(docs)._jdf.queryExecution().toString())


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(x for _ in range(40) for x in ("the", r.choice(vocab), r.choice(vocab))) for _ in range(25)]
    for t in list(texts):
        w = t.split()
        for _ in range(2):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = "edit"
            texts.append(" ".join(v))
    rows = list(enumerate([*texts, "", None, texts[0]]))
    members, pairs = S.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    cls = {x.doc_id: x.class_id for x in members.collect()}
    sigs = {i: frozenset(brute_sigs(t or "")) for i, t in rows}
    assert cls == {i: min(j for j in sigs if sigs[j] == sigs[i]) for i in sigs}
    reps = sorted(set(cls.values()))
    want = {(a, b) for a in reps for b in reps if a < b and sigs[a] and sigs[b] and len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b]) >= 0.8}
    assert {(x.a, x.b) for x in pairs.collect()} == want and len(want) > 10
