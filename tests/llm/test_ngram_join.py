import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import ngram_join as J


def gram_set(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, percent=90):
    sets = [gram_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(r, words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


def sample(seed=1):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for size in (1, 2, 3, 5, 9, 12, 13, 22, 40, 60, 100, 150, 700):
        for _ in range(3):
            words = [r.choice(pool) for _ in range(size)]
            for k in range(9):
                copy = edited(r, words, k * size // 190 + k % 2)
                if k > 5:
                    copy = copy[: -max(1, size // 25)] if size > 25 else copy
                rows.append((i := i + 1, " ".join(copy) if k else "\t".join(copy).upper() + "\r\n"))
    chain = [r.choice(pool) for _ in range(120)]
    for k in range(12):  # each is linked with the next few only
        chain = chain[:2] + edited(r, chain[2:], 1)
        rows.append((1000 - k, " ".join(chain)))
    star = [r.choice(pool) for _ in range(300)]
    for k in range(25):  # near one text, but not near each other
        rows.append((2000 + k, " ".join(edited(r, star, 7))))
        rows.append((3000 + k, " ".join(edited(r, star, 5))))
    passage = " ".join(r.choice(pool) for _ in range(60))
    rows += [(4000 + k, passage + " " + " ".join(r.choice(pool) for _ in range(30))) for k in range(20)]
    return rows + [(5001, None), (5002, ""), (5003, " \n "), (None, None), (None, rows[0][1]), (None, "an id of none"), (5, rows[4][1]), (5, "another text of that id"), (9000, "É é\x1c   b"), (9001, "É É\x1c   b")]


@pytest.mark.parametrize("tile", [4 << 20, 4000])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE_BYTES", tile)
    rows = sample()
    docs = spark.createDataFrame([(d, t, "c", 1, "k") for d, t in rows], "doc_id long, text string, content string, n int, row string")
    out = J.ngram_components(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    got = sorted((tuple(x) for x in out.collect()), key=str)
    assert got == brute(rows)
    assert J.ngram_components(docs.limit(0)).count() == 0


def test_linked_sets_share_a_key():
    r = random.Random(8)
    for case in range(1500):
        n = r.choice([1, 5, 9, 10, 11, 19, 20, 21, 50, 99, 300, 1000, r.randrange(1, 400)])
        m = r.randint(n, n * 100 // 90)
        most_shared = n
        least_shared = -(-90 * (n + m) // 190)
        same = r.choice([least_shared, r.randint(least_shared, most_shared)])
        draw = np.random.default_rng(case).integers(0, 2**64, same + (n - same) + (m - same), np.uint64)
        x, y = np.unique(draw[:n]), np.unique(np.append(draw[:same], draw[n:]))
        if len(x) != n or len(y) != m or (same == n == m):
            continue
        assert J.linked(x, y, 90) and J.linked(y, x, 90)
        doc, h = np.repeat([0, 1], [n, m]), np.append(x, y)
        owner, keys = J.part_keys(doc, h, np.array([n, m]), 90)
        assert set(keys[owner == 0]) & set(keys[owner == 1]), (n, m, same)


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.sampled_from([50, 90, 100]))
def test_bound_is_never_too_low(p, q, percent):
    a, b = (J.mix(np.array(sorted(s), np.uint64) + J.GOLDEN) for s in (p, q))
    a, b = np.sort(a), np.sort(b)
    maps = [J.bitmap(x, 64) for x in (a, b)]
    assert J.bound(maps[0], len(a), maps[1][None], np.array([len(b)]))[0] >= len(p & q)
    assert J.linked(a, b, percent) == (len(p & q) > 0 and 100 * len(p & q) >= percent * len(p | q))
