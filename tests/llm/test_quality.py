import random
import zlib

import numpy as np

from readloom.llm import quality as Q


def test_fourier_features_approximate_the_kernel():
    r = np.random.default_rng(0)
    x = r.normal(size=(40, Q.STATS))
    near = (Q.fourier(x)[:, :-1] @ Q.fourier(x)[:, :-1].T) - np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2 / Q.WIDTH**2)
    assert np.abs(near).mean() < 0.08


def test_isotonic_is_the_best_monotone_fit():
    r = np.random.default_rng(1)
    n, y = r.integers(1, 5, 7).astype(float), np.zeros(7)
    y = r.random(7) * n
    fitted = Q.isotonic(n, y)
    assert (np.diff(fitted) >= 0).all()
    loss = (n * (fitted - y / n) ** 2).sum()
    for _ in range(4000):
        other = np.sort(r.random(7))
        assert loss <= (n * (other - y / n) ** 2).sum() + 1e-9
    assert len(Q.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_operator(spark):
    r = random.Random(4)
    words = ["the", "of", "thing", "wander", "oning", "est", "rally", "mind"]

    def make(good):
        t = " ".join(r.choice(words) for _ in range(r.randint(5, 120)))
        return t.capitalize() + "." if good else r.choice([t.upper() + "!!", t.replace(" ", "### "), t.replace(" ", " | "), "spam " * 60])

    good = [r.random() < 0.7 for _ in range(400)]
    rows = [(i, make(g), "en", "s") for i, g in enumerate(good)] + [(900, None, None, "s"), (901, "", "en", None), (None, "x", "en", "s"), (3, "the thing", "en", "s"), (902, "long " * 50_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)] + [(5, None, 0), (None, 1, 0), (7, int(good[7]), 1)], "doc_id long, quality int, toxic int")
    out = Q.quality_scores(docs, labels).collect()
    assert len(out) == len(rows)
    held = [(x.score, good[x.doc_id]) for x in out if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert len(held) > 60
    hi, lo = [s for s, g in held if g], [s for s, g in held if not g]
    auc = np.mean([(a > b) + (a == b) / 2 for a in hi for b in lo])
    assert auc > 0.95
    for x in out:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
        assert x.doc_id is None or x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
    # labels of held-out rows make no difference
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    a = sorted((x.doc_id or -1, round(x.score, 6)) for x in out)
    b = sorted((x.doc_id or -1, round(x.score, 6)) for x in Q.quality_scores(docs, other).collect())
    assert a == b
    assert {x.score for x in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0


def test_summed_equations_equal_one_direct_fit(spark):
    """Weights and scores are those of one ridge fit and one isotonic fit over all labelled rows."""
    r = random.Random(9)
    words = ["the", "of", "thing", "Wander", "oning.", "###", "rally", "7"]
    rows = [(Q.statistics(" ".join(r.choice(words) for _ in range(r.randint(0, 60)))), float(r.random() < 0.6), i % 5 == 0) for i in range(300)]
    model = Q.fit(spark.createDataFrame(rows, "stats array<double>, y double, spare boolean").repartition(7))
    stats, y, spare = np.array([x[0] for x in rows], float), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    mean, scale = stats[~spare].mean(0), np.maximum(stats[~spare].std(0), 1e-9)
    z = Q.fourier(np.clip((stats - mean) / scale, -Q.CLIP, Q.CLIP))
    weight = np.linalg.solve(z[~spare].T @ z[~spare] + Q.RIDGE * np.eye(z.shape[1]), z[~spare].T @ y[~spare])
    assert np.allclose(model.raw_scores(stats), z @ weight, atol=1e-6)
    at = np.clip(((z @ weight + 0.5) / 2 * Q.BINS).astype(int), 0, Q.BINS - 1)[spare]
    bins = np.unique(at)
    n, total = np.array([(at == b).sum() for b in bins], float), np.array([y[spare][at == b].sum() for b in bins])
    assert np.allclose(model.raw, (bins + 0.5) / Q.BINS * 2 - 0.5) and np.allclose(model.score, Q.isotonic(n, total))
    assert np.allclose(model.scores(stats), np.clip(np.interp(z @ weight, model.raw, model.score), 0, 1), atol=1e-6)
