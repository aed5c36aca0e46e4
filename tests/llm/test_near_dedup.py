import random

import numpy as np

from readloom.llm import near_dedup as N
from readloom.llm.components import components


def sh(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts, least=0.8):
    """Brute force: all pairs, then components."""
    sets, parent = [sh(t or "") for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = len(a & b)
            if (not a and not b) or (same and same >= least * (len(a) + len(b) - same)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def corpus(seed=1, seeds=30, copies=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "a", "A", "a b c", "a b c d", "b a c d"]
    for _ in range(seeds):
        base = [r.choice(vocab) for _ in range(r.randint(30, 220))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, copies)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    passage = " ".join(r.choice(vocab) for _ in range(90))  # shared by documents that are not alike
    out += [passage + " " + " ".join(r.choice(vocab) for _ in range(60)) for _ in range(25)]
    return out


def test_registers_agree_as_probability_jaccard():
    r = np.random.default_rng(1)
    w = r.exponential(1, (2, 40)) * (r.random((2, 40)) < 0.8)
    h = r.integers(1, 2**63, 40).astype(np.uint64)
    d, e = np.nonzero(w)
    s = N.prob_min_hash(d, h[e], w[d, e], 2, 4000)
    both = [i for i in range(40) if w[0, i] and w[1, i]]
    want = sum(1 / np.maximum(w[0] / w[0, i], w[1] / w[1, i]).sum() for i in both)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_shingles():
    texts = ["a b c d e f", "a b", "", "x " * 40, "a b c d e f a b c d e f"]
    doc, h, n = N.shingles([N.split_words(t) for t in texts])
    for i, t in enumerate(texts):
        assert (doc == i).sum() == len(sh(t))
    assert n[doc == 3].tolist() == [36] and set(h[doc == 0]) < set(h[doc == 4])


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent) if x in got} and {x for x in parent if any(x in e and e[0] != e[1] for e in edges)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "doc_id long, text string, content string, n long")
    out = {x.doc_id: x for x in N.near_duplicates(docs).collect()}
    want = classes(texts)
    assert [out[i].class_id for i in range(len(texts))] == want
    for i, c in enumerate(want):
        assert out[i].kept == (c == i) and out[i].class_size == want.count(c) and out[i].n_shingles == len(sh(texts[i] or ""))


def test_star_shape_loses_no_link(spark):
    """A large bucket whose members are like some others but not like its leader."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(200)]
    base = [r.choice(vocab) for _ in range(200)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(3, 7)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x.class_id for x in N.near_duplicates(docs).collect()}
    assert [out[i] for i in range(len(texts))] == classes(texts)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c\nd e f"), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(x.doc_id), str(x.class_id), x.kept) for x in N.near_duplicates(docs).collect())
    assert out == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True), ("None", "None", True)]
    assert sorted(str(x.doc_id) for x in N.without_near_duplicates(docs).collect()) == ["1", "3", "None", "None"]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    """Repeated rows beside rows without an id, and one id with texts of different classes."""
    r = random.Random(5)
    x, y, z, u, v = (" ".join(f"{c}{r.randrange(300)}" for _ in range(80)) for c in "xyzuv")
    rows = [(1, x), (1, x), (None, "p q r s t u"), (None, "another text"), (None, None), (None, None)]  # repeated, and nameless
    rows += [(2, y), (3, y + " more"), (3, z), (2, u), (4, v), (4, v + " end"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(i.doc_id, i.class_id, i.class_size, i.kept) for i in N.near_duplicates(docs.where("doc_id < 4")).collect()}
    assert out == {(1, 1, 2, True), (2, 2, 2, True), (3, 2, 2, False), (3, 3, 1, True), (2, 2, 1, True)}
    got = [(i.doc_id, i.text) for i in N.without_near_duplicates(docs).collect()]
    assert sorted(t or "" for i, t in got if i is None) == ["", "", "another text", "p q r s t u"]
    assert sorted((i, t) for i, t in got if i is not None and i < 4) == sorted([(1, x), (2, y), (2, u), (3, z)])
    assert [i for i, _ in got].count(4) == [i for i, _ in got].count(5) == 1


def test_repeated_lines_lose_no_pair():
    """Copies with a line that comes very often: the sets' Jaccard is 0.8 or more, the weighted one is far lower."""
    r = random.Random(11)
    texts = []
    for _ in range(60):
        base = " ".join(f"w{r.randrange(5000)}" for _ in range(100))
        line = " ".join(f"w{r.randrange(5000)}" for _ in range(16))
        texts += [base, base + (" " + line) * 100]
    doc, h, count = N.shingles([N.split_words(t) for t in texts])
    bands = N.document_bands(doc, h, count, len(texts))
    for a, b, x, y in zip(bands[::2], bands[1::2], texts[::2], texts[1::2], strict=True):
        assert len(sh(x) & sh(y)) >= 0.8 * len(sh(x) | sh(y))
        assert len(np.intersect1d(a, b)) and len(a) == 24 < len(b)
