"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readloom.llm import bpe, classlm, divergence, exact_dedup, langid, near_dedup, ngram_join, packing, pii, quality, secrets, spelling, spotsigs
from readloom.llm.common import documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: The key of the surrogates; a deployment passes a secret of its own.
KEY = b"readloom example key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(documents(spark, sf_dir), KEY)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.scores(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_BPE)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), PIECES)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.neighbour_report(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii_surrogates, op2_byte_bpe, op3_exact_dedup, op4_class_lm, op5_best_fit_packing, op6_near_dedup, op7_language_id, op8_secret_scan, op9_spot_signatures, op10_quality, op11_spelling_variants, op12_source_divergence, op13_ngram_join)}


def _secret_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    kinds = []
    for i, r in enumerate(secrets.RULES):
        kinds.append(f"SELECT doc_id, rn, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS ms, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS gs, string_split_regex(t, {quoted(r.pattern)}) AS ps FROM d")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(kinds)}),
places AS (
  SELECT doc_id, rn, ord, kind, least, unnest(range(1, len(ms) + 1)) AS i, ms, gs, ps FROM found WHERE len(ms) > 0),
spans AS (
  SELECT rn, ord, kind, length(ms[i]) AS n,
         cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM places WHERE length(gs[i]) >= least),
shown AS (
  SELECT rn, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord) FILTER (ord < {len(secrets.BASE)}) AS base,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord) AS spans
  FROM spans GROUP BY rn)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN shown USING (rn)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: crc32 byte by byte from its table, which is made from the polynomial; words at one edit meet on what is left without a letter.
_SPELLING_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
each AS (SELECT w, count(*) AS k, hex(encode(coalesce(cast(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs GROUP BY doc_id, w),
summed AS (
  SELECT w, k, xor(4294967295, list_reduce(list_transform(range(1, cast(length(x) AS BIGINT), 2), lambda i: cast('0x' || substr(x, i, 2) AS BIGINT)),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h FROM each, crc),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, cast(h % length(w) AS BIGINT)) || substr(w, cast(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM summed),
words AS MATERIALIZED (SELECT word, cast(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS MATERIALIZED (SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
top AS (SELECT near.word, min(other) AS other, any_value(n_near) AS n_near, any_value(most) AS most FROM near JOIN best ON near.word = best.word AND other_n = most GROUP BY near.word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN other END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM words w LEFT JOIN top ON top.word = w.word),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL"""

_DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
found AS (SELECT rn, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rn) AS docs FROM found GROUP BY ALL),
terms AS (SELECT lang, term, cast(sum(n) AS HUGEINT) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
langs AS (SELECT lang, cast(sum(n) AS HUGEINT) AS total, count(*) AS v FROM terms GROUP BY lang),
groups AS (SELECT d.lang, d.source, coalesce(any_value(s.total), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, cast(sum(c.n) AS HUGEINT) AS total FROM counts c JOIN terms USING (lang, term) GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * cast(coalesce(c.n, 0) + 2 AS HUGEINT) // (g.total + 2 * l.v) AS p,
    1 + 1000000000 * (t.n + 2) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN terms t USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10"""

_NGRAM_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT rn, unnest(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT rn, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS content FROM grams GROUP BY rn),
nodes AS MATERIALIZED (SELECT content, min(rn) AS id, any_value(n) AS n, min(doc_id) AS first FROM sizes JOIN d USING (rn) GROUP BY content),
mine AS MATERIALIZED (SELECT id, n, g FROM nodes JOIN grams ON rn = id),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS same, any_value(a.n) AS n, any_value(b.n) AS m
  FROM mine a JOIN mine b ON a.g = b.g AND a.id <> b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.id, b.id),
links AS MATERIALIZED (SELECT a, b FROM met WHERE 100 * same >= 90 * (n + m - same)),
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
of AS (SELECT a AS id, min(first) AS component_id FROM reach JOIN nodes ON id = b GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, CASE WHEN s.n IS NULL THEN d.doc_id ELSE o.component_id END AS component_id
FROM d LEFT JOIN sizes s USING (rn) LEFT JOIN nodes USING (content) LEFT JOIN of o USING (id)"""

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_secret_scan": _secret_sql(),
    "op11_spelling_variants": _SPELLING_SQL,
    "op12_source_divergence": _DIVERGENCE_SQL,
    "op13_ngram_join": _NGRAM_SQL,
}
