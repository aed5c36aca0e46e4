import hashlib
import random

from readloom.llm import exact_dedup as X


def brute(rows):
    best, n = {}, {}
    for doc_id, text in rows:
        t = text or ""
        n[t] = n.get(t, 0) + 1
        if t not in best or best[t] is None or (doc_id is not None and doc_id > best[t]):
            best[t] = doc_id if doc_id is not None else best.get(t)
    return sorted(((d, best[t or ""], n[t or ""], d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)


def sample():
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh \n") for _ in range(60_000))
    texts = ["a", "A", "", None, " ", "é", long, long[:-1], long[:30_000] + "X" + long[30_000:], "x" * 100_000, "x" * 100_001]
    rows = [(i, r.choice(texts)) for i in range(120)]
    return rows + [(None, "only null id"), (None, "a"), (5, rows[5][1])]


def test_chunks_are_whole_and_content_defined():
    r = random.Random(4)
    data = bytes(r.randrange(256) for _ in range(300_000))
    parts = X.chunks(data)
    assert b"".join(parts) == data and all(X.LEAST <= len(p) <= X.MOST for p in parts[:-1])
    moved = X.chunks(b"inserted" + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    big = data * 8
    assert b"".join(X.chunks(big)) == big  # over several slabs
    assert X.chunks(b"") == [] and b"".join(X.chunks(b"z" * 99_999)) == b"z" * 99_999


def test_equals_brute_force_even_with_colliding_digests(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, recipe string, group_size int")
    for size in (16, 1):
        got = sorted((tuple(r) for r in X.exact_duplicates(docs, size).collect()), key=str)
        assert got == brute(rows), size
    assert X.exact_duplicates(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, keep_id string")
    out = X.distinct_documents(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t in rows})
