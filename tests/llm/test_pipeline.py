"""The pipeline on a small table, stage by stage, against what is right for each stage's own input."""

import random
import re

import corpus_pipeline
from readloom.llm import secrets

from test_near_dedup import classes


def make(spark, tmp_path):
    r = random.Random(8)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(40, 90))) for _ in range(30)]
    texts = [*base, base[3], base[3], base[4] + " one", base[5].replace("wa", "WA"), None, "", "12 !!", base[6] + ' token = "abcdef123456"', base[7]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path):
    sf = make(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        if name != "best-fit packing":
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        after = docs.collect()
        if name == "language id":
            assert sorted(x.doc_id for x in after) == sorted(x.doc_id for x in before if re.search("[a-z]", x.text or ""))
        if name == "exact dedup":
            best = {}
            for x in before:
                best[x.text] = max(best.get(x.text, -1), x.doc_id)
            assert sorted((x.doc_id, x.text) for x in after) == sorted((i, t) for t, i in best.items())
        if name == "near dedup":
            rows = sorted(before, key=lambda x: x.doc_id)
            cls = classes([x.text for x in rows])
            assert sorted(x.doc_id for x in after) == [rows[c].doc_id for c in sorted(set(cls))]
        if name == "secret scan":
            assert len(after) == len(before) and sorted(x.doc_id for x in after) == sorted(x.doc_id for x in before)
            assert secrets.secret_report(docs).where("spans <> ''").count() == 0
            assert all(x.n_chars == len(x.text) for x in after)
        if name == "best-fit packing":
            assert {x.doc_id for x in after} == {x.doc_id for x in before}
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_without_known_languages(spark):
    """Whether a text stays depends on its letters, not on what languages are known."""
    texts = ["some words here", None, "", "12 !!", "ein Satz", "½ ², 3", "Ж"]
    kept = [0, 4, 6]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for known in (None, "en"):
        rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)] + [(9, "some words here", known, "s", 15)]
        out = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, shape), "").collect()
        assert sorted(x.doc_id for x in out) == [*kept, 9]
        assert {x.lang for x in out} == {known}


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those that the stages use within, rows without an id, repeated rows."""
    names = ["_id", "id", "_hash", "_hash_of", "_clean", "clean", "_dropped", "dropped", "_sha", "sha", "_lang", "lang_pred", "score", "_of", "of", "digest", "_digest", "whole", "spans", "kinds", "total"]
    rows = [(i, t, None if i == 2 else "en", "s", len(t or "")) for i, t in enumerate(["some words here", 'a token = "abcdef123456" b', None, "some words here", "x y z"])] + [(None, "some words here", "en", None, 3), (None, "p q", None, None, None)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    left = {"language id": 6, "exact dedup": 5, "near dedup": 7, "secret scan": 7}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        got = out.collect()
        assert out.columns == docs.columns and len(got) == (left[name] if name != "near dedup" else len(got)), name
        assert all(list(x[5:]) == list(range(len(names))) for x in got), name
        assert name == "exact dedup" or sum(x.doc_id is None for x in got) == 2, name
