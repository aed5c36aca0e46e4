"""Audit of how sources differ: divergences of term distributions by an Arrow compute pipeline.

In each task ascii_lower, split_pattern_regex, dictionary_encode and the hash group_by count terms batch by batch, without
Python strings; partial counts are merged while they are held.  Spark adds them up.  The kept terms of a language are dealt
to shards, columns of whole numbers, in which all divergences are computed exactly; shards are then summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import join_groups, small_batches, stored

#: What lies between terms: all ASCII characters but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of partial counts that a task holds; cells (terms x sources) of a shard; the scale of probabilities.
HELD, CELLS, SCALE = 400_000, 1 << 18, 1_000_000_000
KEYS = ["lang", "source", "term"]


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences), docs (rows with the term) of a batch(lang, source, text).

    Each (lang, source) also has a row with an empty term, so that groups without terms are known.
    """
    lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), BETWEEN)
    term, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(term, "")
    term, row = term.filter(some).dictionary_encode(), row.filter(some)
    per_row = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    at = per_row["row"].combine_chunks()
    keys = {"lang": lang.indices.take(at), "source": source.indices.take(at), "term": per_row["term"], "n": per_row["count_all"]}
    sums = pa.table(keys).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    named = [d.dictionary.take(sums[k].combine_chunks()) for d, k in zip((lang, source, term), KEYS, strict=True)]
    found = pa.table([*named, sums["n_sum"], sums["n_count"]], [*KEYS, "n", "docs"])
    groups = pa.table([batch.column(0), batch.column(1)], KEYS[:2]).group_by(KEYS[:2], use_threads=False).aggregate([])
    none = pa.array(np.zeros(groups.num_rows, np.int64))
    return pa.concat_tables([found, pa.table([groups["lang"], groups["source"], pa.array([""] * groups.num_rows, pa.string()), none, none], [*KEYS, "n", "docs"])])


def _merged(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns([*KEYS, "n", "docs"]).combine_chunks()


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for b in batches:
        held.append(term_counts(b))
        if sum(t.num_rows for t in held) > HELD:
            held = [_merged(held)]
            if held[0].num_rows > HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from _merged(held).to_batches()


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n of the terms that `least` rows of the language have or more; an empty term marks a group."""
    named = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = named.mapInArrow(_partial, "lang string, source string, term string, n long, docs long")
    # One exchange: a term of a language meets in one task, as one row for each source and task that has it.
    sums = partial.repartition("lang", "term").groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    all_docs = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return sums.withColumn("docs", all_docs).where((F.col("docs") >= least) | (F.col("term") == "")).select(*KEYS, "n")


def scaled(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / (totals + 2 * terms)), by long division, exact for totals up to 9e15."""
    below = totals + 2 * terms
    whole, rest = np.divmod(counts + 2, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return 1 + whole


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shard(most: int):
    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        """Sums for pairs of sources, and the first `most` terms of each source, over the terms of one shard."""
        names = groups["source"].combine_chunks()
        if not len(names):
            return pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
        lang, terms = groups["lang"][0], groups["terms"][0].as_py()
        coded = counts["term"].combine_chunks().dictionary_encode()
        n = np.zeros((len(names), len(coded.dictionary)), np.int64)
        n[pc.index_in(counts["source"].combine_chunks(), names).to_numpy(zero_copy_only=False), coded.indices.to_numpy()] = counts["n"].to_numpy()
        p = scaled(n, groups["total"].to_numpy()[:, None], terms) if terms else n
        one, two, item, value = [], [], [], []
        for i in range(len(names) - 1):
            sums = _divergences(p[i + 1 :], p[i]).sum(1)
            others = np.arange(i + 1, len(names))
            one += [np.full(len(others), i), others]
            two += [others, np.full(len(others), i)]
            value += [sums, sums]
        pairs = sum(map(len, two))
        if n.size:
            q = scaled(n.sum(0), groups["lang_total"].to_numpy()[:1], terms)
            for i in range(len(names)):
                at = np.flatnonzero((n[i] > 0) & (p[i] > q))
                f = _divergences(p[i, at], q[at])
                if most < len(at):  # those that aren't below the last rank, ties included
                    top = f >= np.partition(f, len(f) - most)[len(f) - most]
                    at, f = at[top], f[top]
                order = sorted(zip((-f).tolist(), (x.encode() for x in coded.dictionary.take(pa.array(at)).to_pylist()), at.tolist(), strict=True))[:most]
                one.append(np.full(len(order), i))
                item.append(np.array([x[2] for x in order], np.int64))
                value.append(np.array([-x[0] for x in order], np.int64))
        whole = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
        source = names.take(whole(one))
        items = pa.concat_arrays([names.take(whole(two)), coded.dictionary.take(whole(item))])
        part = pa.array(["pair"] * pairs + ["term"] * (len(source) - pairs), pa.string())
        return pa.table({"lang": pa.array([lang.as_py()] * len(source), pa.string()), "source": source, "part": part, "item": items, "value": whole(value)})

    return run


def divergences(docs: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """How the (lang, source) groups of docs(lang, source, text) differ by their terms.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.  A language keeps the V terms that
    `least` of its rows have.  A group with N occurrences of kept terms gives a term p = 1 + floor(10^9 (n + 2) / (N + 2 V)), and
    f = floor((p - q)^2 / (p + q)).  Returns lang, source, part, item, value, rank: part `pair` has the sum of f against each
    other source of the language, part `term` the `most` kept terms that the group has and uses more than its language, with
    f against the language.  Ranks are by falling value, ties by UTF-8.  Null lang, source and text count as empty; a group
    without terms has all counts 0; repeated rows count again; a language of one source has no rows; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kept = stored(kept_counts(docs, least), "kept-terms")
    terms = kept.where("term <> ''")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    sizes = terms.groupBy("lang", "term").agg(F.count("*").alias("rows")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("rows").alias("size"))
    langs = langs.join(sizes, "lang", "left").na.fill(0, ["terms", "size"])
    langs = stored(langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / CELLS))), "languages")
    total = langs.agg(F.sum("size")).first()[0] or 1
    rows = join_groups(terms, langs.select("lang", "size", "shards"), "lang", "size", total)
    rows = rows.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), "source", "term", "n")
    meta = groups.join(langs, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    meta = stored(meta.select("lang", "shard", "source", "total", "lang_total", "terms"), "language-shards")
    found = rows.groupBy("lang", "shard").cogroup(meta.groupBy("lang", "shard")).applyInArrow(_shard(most), "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= most))
