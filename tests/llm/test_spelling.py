import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import spelling as S


def edits(w, letters):
    for i in range(len(w) + 1):
        yield from (w[:i] + c + w[i:] for c in letters)
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + c + w[i + 1 :] for c in letters)


def brute(rows, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    letters = S.LETTERS.decode("latin-1")
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n)


def sample():
    r = random.Random(3)
    base = ["harbour", "colour", "naïveté", "straße", "ÀÉÎÕÜ", "abcde", "bcdea", "letterlist", "Straßen", "x" * 300]
    words = list(base)
    for _ in range(900):
        w = r.choice(words[-40:] + base)
        words.append(r.choice(list(edits(w, "abeé")))[:310])
    weights = [r.random() ** 4 + 0.01 for _ in words]
    rows = [(i, " ".join(r.choices(words, weights, k=60)) + r.choice([", Ω 12", "中abcde中", "", "Harbour's"])) for i in range(150)]
    return rows + [(None, "harbour harbour naïveté"), (7, None), (8, ""), rows[3], rows[3]]


@pytest.mark.parametrize("every", [97, 5])
def test_equals_brute_force(spark, every, monkeypatch):
    monkeypatch.setattr(S, "TILE_WORDS", 8)  # many tiles in a block
    rows = sample()
    docs = spark.createDataFrame([(d, t, "c", 1, 2) for d, t in rows], "doc_id long, text string, word string, n int, cell int")
    out = S.variants(docs, every=every)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(tuple(r) for r in out.collect())
    want = brute(rows, every)
    assert got == want and len(want) > 100
    assert any(r[1] and r[1] != r[2] for r in want), "no chain of forms in the sample"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34")], "doc_id long, text string")
    assert S.variants(docs).count() == 0 == S.variants(docs.limit(0)).count()
    with pytest.raises(ValueError):
        S.variants(docs, times=1)


@settings(deadline=None, max_examples=100)
@given(st.integers(1, 7), st.integers(0, 1), st.data())
def test_pairs_are_those_at_one_edit(size, more, data):
    a = data.draw(st.lists(st.text("abÿ", min_size=size, max_size=size), min_size=1, max_size=12, unique=True))
    b = data.draw(st.lists(st.text("abÿ", min_size=size + more, max_size=size + more), min_size=1, max_size=12, unique=True))
    i, j = S.near_pairs(a, b)
    assert {(a[p], b[q]) for p, q in zip(i, j, strict=True)} == {(x, y) for x in a for y in b if y in set(edits(x, "abÿ")) - {x}}
    i, j = S.near_pairs(a, None)
    assert {(a[p], a[q]) for p, q in zip(i, j, strict=True)} == {(a[p], a[q]) for p in range(len(a)) for q in range(p + 1, len(a)) if a[q] in set(edits(a[p], "abÿ"))}
