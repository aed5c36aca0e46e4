import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from readloom.llm import divergence as D


def brute(rows, least, most):
    docs, n, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower))
        for t, k in found.items():
            docs[lang, t] += 1
            n[lang, source, t] += k
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), k in docs.items() if x == lang and k >= least)
        sources, v = sorted(s for x, s in groups if x == lang), len(kept)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}

        def p(count, of):
            return 1 + 10**9 * (count + 2) // (of + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(p(n[lang, s, t], total[s]), p(n[lang, o, t], total[o])) for t in kept), o.encode()) for o in sources if o != s]
            terms = []
            for t in kept:
                a, q = p(n[lang, s, t], total[s]), p(sum(n[lang, o, t] for o in sources), sum(total.values()))
                if n[lang, s, t] and a > q:
                    terms.append((-f(a, q), t.encode()))
            for part, found, end in (("pair", pairs, None), ("term", terms, most)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(found)[:end], 1)]
    return sorted(out)


def sample():
    r = random.Random(5)
    words = ["Alpha", "beta", "élan", "Ünder", "中文", "naïve", "𝔘x", "Zz", "x", "É", "é"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(240):
        lang, source = r.choice(["en", "de", None, ""]), r.choice(["a", "b", "ä", "B", None])
        text = "".join(r.choice(words) + r.choice([" ", ", ", "\x00", "-", "7", "\n", " "]) for _ in range(r.randrange(40)))
        rows.append((i, r.choice([text, text, text, None, "", "12 !?"]), lang, source))
    return rows + [(0, "alone", "xx", "one"), (1, None, "yy", "p"), (2, "", "yy", "q"), rows[0], rows[0]]


@pytest.mark.parametrize("cells", [1 << 18, 10])
def test_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(D, "CELLS", cells)
    rows = sample()
    docs = spark.createDataFrame([(*x, 1, "t") for x in rows], "doc_id long, text string, lang string, source string, n int, term string")
    out = D.divergences(docs, least=4, most=3)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(tuple(x) for x in out.collect())
    assert got == brute(rows, 4, 3) and len(got) > 60
    assert D.divergences(docs.limit(0)).count() == 0


def test_long_division_is_exact():
    r = random.Random(6)
    for _ in range(2000):
        total = r.randrange(1, 9 * 10**15)
        count, terms = r.randrange(total + 1), r.randrange(1, 10**6)
        assert int(D.scaled(np.array([count]), np.array([total]), terms)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def test_partial_counts_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD", 6)
    rows = sample()
    parts = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    batches = [pa.RecordBatch.from_pydict({"lang": [x[2] or "" for x in p], "source": [x[3] or "" for x in p], "text": [x[1] or "" for x in p]}) for p in parts]
    got, want = defaultdict(int), defaultdict(int)
    for b in D._partial(iter(batches)):
        for x in b.to_pylist():
            got[x["lang"], x["source"], x["term"]] += x["n"]
    for _, text, lang, source in rows:
        want[lang or "", source or "", ""] += 0
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            want[lang or "", source or "", t] += 1
    assert got == want
