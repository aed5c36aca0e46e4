import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from readloom.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def test_encoder_equals_library():
    lib = Tokenizer.from_file(PATH)
    enc = K.encoder(PATH)
    r = random.Random(7)
    alphabets = ["abcdefgh THE ing.", "éÈüß ñç ΣΑΣ σς İı", "0123456789 .,'\n\t", "日本語 한국어 😀👩‍👩‍👧", "\x00\x1c\x1d\x85  　 \r\nx", "=-_#*&$% 's 'll!'", "é Å ½²Ⅷ"]
    texts = ["", "<|endoftext|> x", "a <|endoftext|> b<|startoftext|><|EndOfText|>É<|endoftext|>e\u0301 <|", "\u208f +", "a\u0378b", "\U0001fbf0", "\x00\x01 \x7f", "it's they'll !'s", "x" * 500, "ΑΣ ΑΣ. ς"] + ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(1, 60))) for _ in range(600)]
    texts += ["".join(r.choice(a) for _ in range(r.randint(1, 80))) for a in alphabets for _ in range(60)]
    texts += ["".join(chr(r.choice([r.randrange(0x300), r.randrange(0x3000), r.randrange(0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.packed(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_batches_equal_library(monkeypatch):
    """Texts of a batch share their new words' way through the library; the ids stay the library's own."""
    lib, enc = Tokenizer.from_file(PATH), K.WordEncoder(PATH)
    calls = []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(merges, name)

    merges, enc.merges = enc.merges, Counted()

    def check(texts):
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.packed_all(texts)] == want

    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioutnsrlé") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() + r.choice(["", "", ".", ",", "'s", "''re", "!'ll9", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += ["", " ", "\n\n", "<|endoftext|>", "\U0001fbf0", "a <|startoftext|>\U0001fbf0 b<|", "12 345", "q" * 300, "q" * 300 + " x"]
    check(texts)
    assert len(calls) <= 5  # 2,000 new words a call; a call a text before
    check([])
    usual = [c for c in map(chr, range(0x10000)) if enc.usual(c)]
    check([f"a{c}b {c}{c}'s{c}" for c in usual])
    check(["a\x1cb", "c d\x1f \x1d", "e\x85f\xa0g", "\x1e"])
    monkeypatch.setattr(K, "MOST_WORDS", 300)
    monkeypatch.setattr(K, "TOGETHER", 500)
    check(texts * 2)
    assert len(enc.known) <= 600
    monkeypatch.setattr(K, "MOST_IDS", 50)
    check(texts + ["z" * 5000 + " " + word() for _ in range(5)])
    assert not any(len(w) >= 64 for w in enc.known)


def check_plan(count, capacity):
    plan = K.pack_counts(count, capacity)
    seen = Counter()
    for filling, times in plan:
        assert sum(filling) <= capacity and times > 0
        for s in filling:
            seen[s] += times
    assert seen == Counter({i: int(n) for i, n in enumerate(count) if n})
    return sum(t for _, t in plan)


def exact(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_small_packings_are_optimal():
    r = random.Random(1)
    worse = 0
    for _ in range(60):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 11))]
        worse += check_plan(np.bincount(sizes, minlength=31), 30) - exact(sizes, 30)
    assert worse == 0


def test_large_packings_meet_the_bound():
    r = np.random.default_rng(2)
    sizes = np.minimum(4096, np.exp(r.normal(6, 1, 40_000)).astype(int) + 1)
    count = np.bincount(sizes, minlength=4097)
    assert check_plan(count, 4096) <= K.least_sequences(count, 4096) + 1
    assert check_plan(np.bincount([3000] * 500 + [1500] * 100, minlength=4097), 4096) == 550
    assert K.pack_counts(np.zeros(4097, int)) == []


def test_operator(spark):
    lib = Tokenizer.from_file(PATH)
    r = random.Random(3)
    texts = [None, "", "hello world", "the same", "the same"] + [" ".join(r.choice(["the", "ing", "été", "x1"]) for _ in range(r.randint(1, 900))) for _ in range(40)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "null id", None), (2, "hello world", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = K.pack(docs, PATH, 256).collect()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(x)[:5] for x in out) == want
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(x.length for x in out)
    assert len(bins) <= -(-total // 256) + 2
    assert K.pack(docs.limit(0), PATH, 256).count() == 0
    by_length = defaultdict(list)
    for x in K.numbered(K.pieces(docs, PATH, 256), len(out), 3).collect():
        by_length[x.length].append(x.number)
    assert all(sorted(v) == list(range(len(v))) for v in by_length.values())


def test_repeated_perfect_patterns():
    """Counts that fill every sequence wholly, where the least waste around the largest piece is the wrong choice."""
    for patterns, capacity, n in (([(19, 11, 10), (14, 13, 13), (18, 14, 8)], 40, 100), ([(19, 11, 10), (14, 13, 13), (18, 14, 8)], 40, 5000), ([(9, 6, 5), (8, 7, 5), (10, 6, 4)], 20, 30)):
        count = np.bincount([s for p in patterns for s in p], minlength=capacity + 1) * n
        plan = K.pack_counts(count, capacity)
        used = sum(np.bincount(f, minlength=capacity + 1) * t for f, t in plan)
        assert used.tolist() == count.tolist() and all(sum(f) <= capacity for f, _ in plan)
        assert sum(t for _, t in plan) == len(patterns) * n


def test_search_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(60):
        count = np.zeros(13, np.int64)
        for s in r.integers(2, 10, 9):
            count[s] += 1

        def least(sizes, bins, best):
            if len(bins) >= best or not sizes:
                return min(best, len(bins))
            for i in range(len(bins)):
                if bins[i] >= sizes[0] and bins[i] not in bins[:i]:
                    best = least(sizes[1:], [*bins[:i], bins[i] - sizes[0], *bins[i + 1 :]], best)
            return least(sizes[1:], [*bins, 12 - sizes[0]], best)

        want = least(sorted((s for s in range(13) for _ in range(count[s])), reverse=True), [], 99)
        assert K._Search(count, 12).plan(want - 1) is None
        plan = K._Search(count, 12).plan(want)
        assert plan is not None and sum(t for _, t in plan) == want
        assert sum(np.bincount(f, minlength=13) * t for f, t in plan).tolist() == count.tolist()


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


def test_never_worse_than_best_fit_decreasing():
    r = random.Random(6)
    for i in range(1000):
        capacity = r.choice([20, 40, 100])
        low, high = r.choice([(1, capacity), (capacity // 5, capacity // 2), (1, capacity // 3)])
        sizes = [r.randint(max(1, low), high) for _ in range(r.randint(1, 90))] * r.choice([1, 1, 3])
        count = np.bincount(sizes, minlength=capacity + 1)
        want = plain_best_fit(sizes, capacity)
        plan = K.best_fit_decreasing(count, capacity)
        assert sum(t for _, t in plan) == want
        used = sum(np.bincount(f, minlength=capacity + 1) * t for f, t in plan)
        assert used.tolist() == count.tolist() and all(sum(f) <= capacity for f, _ in plan)
        if i % 10 == 0:
            assert K.least_sequences(count, capacity) <= sum(t for _, t in K.pack_counts(count, capacity, 300)) <= want
