import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest

from readloom.llm import langid as L

PATH = P.path("piece_bpe_32k.model")


def brute(word, pieces, prob):
    """Sum over all segmentations, one after the other."""
    place = {p: i for i, p in enumerate(pieces.names)}
    text, total = L.MARK + word, np.zeros(prob.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(text[start:i])
                start = i
        p = np.ones(prob.shape[1])
        for part in parts:
            own = prob[place[part]] if part in place else np.zeros(prob.shape[1])
            p = p * (np.maximum(own, L.UNKNOWN) if len(part) == 1 else own)
        total += p
    return total


@pytest.fixture(scope="module")
def model():
    pieces = L.pieces_at(PATH)
    r = np.random.default_rng(1)
    prob = r.random((len(pieces) + 1, 3)) ** 4
    prob[-1] = 0
    return pieces, prob / prob.sum(0)


def test_forward_sums_all_segmentations(model):
    pieces, prob = model
    found = ["a", "the", "tion", "éße", "über", "ñandú", "日本", "straße"]
    want = np.log([brute(w, pieces, prob) for w in found])
    assert np.allclose(L.log_prob(found, pieces, prob), want)


def test_expected_counts_are_those_of_all_segmentations(model):
    pieces, prob = model
    e = L.expected(["tion", "the"], np.array([[1.0, 0, 2], [0, 3, 0]]), pieces, prob)
    for lang, words in ((0, {"tion": 1}), (1, {"the": 3}), (2, {"tion": 2})):
        eps = 1e-6
        for piece in ("t", "th", "on", L.MARK + "t", L.MARK + "the"):
            if piece in pieces.names:
                i = pieces.names.index(piece)
                more = prob.copy()
                more[i, lang] *= 1 + eps
                slope = sum(n * (np.log(brute(w, pieces, more)[lang]) - np.log(brute(w, pieces, prob)[lang])) for w, n in words.items()) / eps
                assert abs(slope - e[i, lang]) < 1e-3


def plain_sum(word, pieces, prob):
    """Sum over all segmentations by the rule for prefixes, in exact numbers."""
    place = {p: i for i, p in enumerate(pieces.names)}
    text, out = L.MARK + word, []
    for lang in range(prob.shape[1]):
        sums = [Fraction(1)]
        for j in range(1, len(text) + 1):
            total = Fraction(0)
            for i in range(j):
                p = prob[place[text[i:j]], lang] if text[i:j] in place else 0.0
                total += sums[i] * Fraction(float(max(p, L.UNKNOWN) if j - i == 1 else p))
            sums.append(total)
        out.append(math.log(sums[-1].numerator) - math.log(sums[-1].denominator))
    return np.array(out)


def test_long_words_and_all_pieces(model):
    """No word is cut and no piece of the vocabulary is left out, however small the probabilities."""
    pieces, prob = model
    assert pieces.most == max(map(len, pieces.names)) > 12
    longest = max(pieces.names, key=len).lstrip(L.MARK)
    found = [longest, "a" + longest * 2 + "b", "日本語ж" * 30, "straße" * 20]
    got = L.log_prob(found, pieces, prob)
    for w, x in zip(found, got, strict=True):
        assert np.allclose(x, plain_sum(w, pieces, prob))
    spans = pieces.spans(next(L.by_length(["tion"]))[1])
    for back, sums in ((False, L.forward), (True, L.backward)):
        assert np.allclose(np.exp(L.log_sums(spans, prob, back)), sums(spans, prob))
    word = "nation" * 8
    e = L.expected([word], np.array([[1.0, 2, 3]]), pieces, prob)
    for piece in ("n", "at", "ion", "tion"):
        if piece in pieces.names:
            i, eps = pieces.names.index(piece), 1e-6
            more = prob.copy()
            more[i] *= 1 + eps
            slope = (L.log_prob([word], pieces, more) - L.log_prob([word], pieces, prob))[0] / eps * [1, 2, 3]
            assert np.allclose(slope, e[i], atol=1e-3)


def test_posterior_of_a_text(spark, model):
    pieces, prob = model
    text, prior = "The straße, the über tion", np.log([2.0, 5, 3])
    total = prior + sum(np.log(brute(w, pieces, prob)) for w in L.words(text))
    want = np.exp(total - total.max())
    got = L.predict(spark.createDataFrame([(text,)], "text string"), PATH, (["x", "y", "z"], prob, prior)).first()
    assert got.lang_pred == "xyz"[int(total.argmax())] and abs(got.score - 1 / want.sum()) < 1e-9


def test_words():
    assert L.words("Über 12 l'été_x ½ ") == ["über", "l", "été", "x"]
    assert L.words("a" * 70) == ["a" * 70]
    assert L.words("12 !? \n") == []


def test_operator(spark):
    r = random.Random(2)
    vocab = {"en": ["the", "of", "and", "thing", "with", "was"], "de": ["der", "und", "die", "nicht", "über", "ein"]}
    rows = [(i, " ".join(r.choice(vocab[lang]) for _ in range(12)), lang, "s") for i, lang in enumerate(r.choice(["en", "de"]) for _ in range(80))]
    rows += [(900, None, "en", "s"), (901, "", "de", "s"), (902, "12 34 !", None, "s"), (None, "the thing was", None, None), (3, *rows[3][1:]), (904, "und die " * 20_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = L.identify(docs, PATH).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    assert [got[i].lang_pred for i in (900, 901, 902, None, 904)] == ["und", "und", "und", "en", "de"]
    for doc_id, text, lang, _ in rows[:80]:
        assert got[doc_id].lang_pred == lang and 0.5 <= got[doc_id].score <= 1
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
    # neither lang nor source nor doc_id is an input of a prediction
    blind = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'de' else lang end as lang", "score")
    assert sorted(map(str, L.identify(blind, PATH).collect())) == sorted(map(str, out))
    assert L.identify(docs.limit(0), PATH).count() == 0
