import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np

from readloom.llm import classlm as C


def plain_exchange(left, right, n, size, classes, rounds):
    """Every move weighed by the whole likelihood."""
    freq = np.bincount(left, n, size) + np.bincount(right, n, size)
    order = np.argsort(-freq, kind="stable")
    of = np.empty(size, int)
    of[order] = np.arange(size) % classes

    def value(of):
        t = np.zeros((classes, classes))
        np.add.at(t, (of[left], of[right]), n)
        return C.likelihood(t)

    for _ in range(rounds):
        for u in order:
            tries = []
            for c in range(classes):
                of[u] = c
                tries.append(value(of))
            of[u] = int(np.argmax(np.round(tries, 6)))
    return of, value(of)


def test_exchange_weighs_moves_by_likelihood():
    r = np.random.default_rng(3)
    left, right = np.divmod(np.arange(144), 12)
    n = r.integers(0, 9, 144).astype(float)
    keep = n > 0
    left, right, n = left[keep], right[keep], n[keep]
    of, want = plain_exchange(left, right, n, 12, 3, 2)
    got = C.exchange(left, right, n, 12, 3, 2)
    t = np.zeros((3, 3))
    np.add.at(t, (got[left], got[right]), n)
    assert abs(C.likelihood(t) - want) < 1e-6


def test_tokens():
    assert C.tokens("The ÄB\x0bx\x85y\x1c 1,") == [b"the", "Äb".encode(), "x\x85y\x1c".encode(), b"1,", C.END]
    assert C.tokens("") == [C.END]


def sample():
    r = random.Random(5)
    nouns, verbs = [f"n{i}a" for i in range(40)], [f"v{i}o" for i in range(40)]
    texts = [" ".join(x for _ in range(r.randint(1, 30)) for x in ("The", r.choice(nouns), r.choice(verbs))) for _ in range(300)]
    return [(i, t, "k") for i, t in enumerate(texts)] + [(900, None, "k"), (901, "", "k"), (902, "unseen words here", "k"), (None, "The n1a v1o", None), (5, texts[5], "k"), (903, "the " * 30_000, "k")]


def test_scores(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    count = Counter()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1

    def toks(t):
        return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    for d, t, _ in rows:
        if not held(d):
            count.update(toks(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held(d), len(toks(t)), sum(count[x] > 0 for x in toks(t)), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks(t)), 4)) for d, t, _ in rows)
    for start, held in ((6, 10), (30, 40), (30, 50_000)):  # few words with every task: most go through the joins
        out = C.scores(docs, start=start, held=held, classes=6, middle=min(held, 60)).collect()
        assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in out) == want
        some = [x for x in out if x.held_out and x.doc_id != 903]
        assert start < 30 or sum(x.score for x in some) > sum(x.base_score for x in some) + 1
    assert C.scores(docs.limit(0)).count() == 0
    none = C.scores(docs.where("doc_id = 902 or doc_id is null"), start=3, held=4, classes=2).collect()
    assert len(none) == 2


def test_model_and_score_against_plain_counts(spark):
    """Classes after a class, and words of a class with one unseen word, each sum to one; scores follow from counts of
    the whole texts by class, whether words are held or not."""
    rows = [(i, t or "") for i, (_, t, _) in enumerate(sample()[:80])] + [(500, "n1a qq1 qq2 qq3 v1o new1 new2"), (501, "qq9 qq8"), (502, "")]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    for start, held, size in ((8, 10, 4), (8, 12, 4), (8, 40, 4), (8, 9999, 4)):
        m = C.fit(train.select("text"), start, held, size, middle=10)
        tail = {bytes(r.token): (r.n, r["class"]) for r in m.tail.collect()}
        of = {w: int(m.of[i]) for i, w in enumerate(m.held)} | {w: c for w, (_, c) in tail.items()}
        count = Counter(w for _, t in rows for w in C.tokens(t))
        assert count == Counter(m.held) + Counter({w: n for w, (n, _) in tail.items()}) and len(of) == len(count) == m.types
        table, n, v = np.zeros((size, size)), np.zeros(size), np.zeros(size)
        for _, t in rows:
            for a, b in pairwise([C.END, *C.tokens(t)]):
                table[of[a], of[b]] += 1
        for w, c in of.items():
            n[c] += count[w]
            v[c] += 1
        alone = (table.sum(0) + 0.5) / (table.sum() + 0.5 * size)
        follow = (1 - C.ALONE) * (table + alone) / (table.sum(1, keepdims=True) + 1) + C.ALONE * alone
        assert np.allclose(10**m.follow, follow) and np.allclose(follow.sum(1), 1)
        emitted = np.zeros(size)
        for w, c in of.items():
            emitted[c] += (count[w] + 0.5) / 10 ** m.spread[c]
        assert np.allclose(emitted + 0.5 / 10**m.spread, 1) and np.allclose(10**m.spread, n + 0.5 * (v + 1))
        more = [(900, "unseen n1a unseen unseen2 qq1 unseen3"), (901, None), *rows]
        for r in C.scored(C.texts_of(spark.createDataFrame(more, "doc_id long, text string")), m).collect():
            want = 0.0
            for a, b in pairwise([C.END, *C.tokens(dict(more)[r.doc_id] or "")]):
                c = of.get(b, m.other)
                want += math.log10(follow[of.get(a, m.other), c]) + math.log10((count[b] + 0.5) / (n[c] + 0.5 * (v[c] + 1)))
            assert abs(r.logs + r.class_logs - want) < 1e-6


def test_best_classes_weigh_by_likelihood():
    r = np.random.default_rng(7)
    for _ in range(30):
        k, size = 5, 6
        table = r.integers(0, 40, (k, k)).astype(float)
        word = r.integers(0, size, 25)
        before, after, n = r.integers(-1, k, 25), r.integers(-1, k, 25), r.integers(1, 9, 25)
        got = C.best_classes(table, word, before, after, n, size, 3)
        for w in range(size):
            mine = np.flatnonzero(word == w)
            if not ((before[mine] >= 0) | (after[mine] >= 0)).any():
                assert got[w] == 3
                continue
            values = []
            for c in range(k):
                t = table.copy()
                for i in mine:
                    if before[i] >= 0:
                        t[before[i], c] += n[i]
                    if after[i] >= 0:
                        t[c, after[i]] += n[i]
                values.append(C.likelihood(t))
            assert values[got[w]] >= max(values) - 1e-6


def test_moves_of_words_in_the_table_weigh_by_likelihood():
    r = np.random.default_rng(8)
    for _ in range(30):
        k, size = 5, 6
        word, now = r.integers(0, size, 25), r.integers(0, k, size)
        before, after, n = r.integers(-1, k, 25), r.integers(-1, k, 25), r.integers(1, 9, 25)

        def put(t, w, c, sign):
            for i in np.flatnonzero(word == w):  # noqa: B023
                if before[i] >= 0:  # noqa: B023
                    t[before[i], c] += sign * n[i]  # noqa: B023
                if after[i] >= 0:  # noqa: B023
                    t[c, after[i]] += sign * n[i]  # noqa: B023
            return t

        table = r.integers(0, 40, (k, k)).astype(float)
        for w in range(size):
            put(table, w, now[w], 1)
        got = C.best_classes(table, word, before, after, n, size, 3, now)
        for w in set(word[(before >= 0) | (after >= 0)].tolist()):
            left = put(table.copy(), w, now[w], -1)
            values = [C.likelihood(put(left.copy(), w, c, 1)) for c in range(k)]
            assert values[got[w]] >= max(values) - 1e-6


def test_held_words_are_memory_alone(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, score string")
    few, many = ({(r.doc_id, r.n_tokens): (r.n_known, r.base_score, r.score) for r in C.scores(docs, start=20, held=h, classes=6, middle=40).collect()} for h in (50, 200_000))
    assert few.keys() == many.keys()
    assert all(np.allclose(few[k], many[k]) for k in few)
