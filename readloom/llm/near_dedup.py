"""Near duplicates by ProbMinHash: weighted shingles, banding, exact verification, components.

Shingles are five words in a row, weighted by 1 + ln(count).  Each is a Poisson process whose rate is its weight and
whose arrivals fall on random registers; a register keeps the shingle that arrives first.  Two documents agree in a
register with the probability of their probability Jaccard coefficient.  A shingle's process ends as soon as it is
later than all registers.  Registers are hashed in bands; documents that share a band are candidates.

A link is defined by the shingle sets, and uneven counts can make the probability Jaccard much lower than the sets'.  So
each document has the bands of a second signature too, of weight 1 for each shingle, whose probability Jaccard is the
sets' own.  Where no shingle comes twice both are the same.

Texts of equal words are one node from the start.  In each bucket every member is compared with one leader, so work
grows with the bucket and not with its square.  Where members of one
leader are of several components afterwards, they are compared across components by an exact filter on how each differs
from the leader, so no link is lost to the star shape.  A link is a Jaccard coefficient of 0.8 or more of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import fresh, join_groups, small_batches, stored, texts_of
from readloom.llm.components import components

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Members of a bucket that are compared with one copy of their leader's text.
SHARE = 250
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def shingles(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of documents given as words: document, hash and count, by document and hash.

    A document of fewer than five words has all of them as its one shingle; one without words has none.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    word = np.fromiter((_hashes[w] for t in texts for w in t), np.uint64, total) if total else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    width = np.minimum(WORDS, lengths)[doc]
    first = np.arange(total) + width <= ends[doc]
    with np.errstate(over="ignore"):
        h = mix(word + GOLDEN)
        for j in range(1, WORDS):
            go = np.flatnonzero(width[: total - j] > j) if total > j else np.zeros(0, np.int64)
            h[go] = mix(h[go] * np.uint64(3) + word[go + j])
    doc, h = doc[first], h[first]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures [document, register] of weighted elements; documents without elements have zeros."""
    first = np.full(n_docs * registers, np.inf)
    kept = np.zeros(n_docs * registers, np.uint64)
    time, last = np.zeros(len(h)), np.full(n_docs, np.inf)
    i = 0
    while len(h):
        i += 1
        with np.errstate(over="ignore"):
            r = mix(h + np.uint64(i) * GOLDEN)
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        alive = time < last[doc]  # an element later than all its document's registers is done
        doc, h, weight, time, r = doc[alive], h[alive], weight[alive], time[alive], r[alive]
        slot = doc * registers + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        kept[slot[won]] = h[won]
        last = first.reshape(n_docs, registers).max(1)
    return kept.reshape(n_docs, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = signature.reshape(len(signature), BANDS, -1)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, rows.shape[:2]).copy()
        for j in range(rows.shape[2]):
            key = mix(key * np.uint64(5) + rows[:, :, j])
    return key.view(np.int64)


def document_bands(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """Each document's distinct bands, of the signature of its shingle set and, if counts differ from 1, of the weighted one."""
    out = list(band_keys(prob_min_hash(doc, h, np.ones(len(h)), n_docs)))
    uneven = np.unique(doc[count > 1])
    if len(uneven):
        mine = np.isin(doc, uneven)
        weighted = band_keys(prob_min_hash(np.searchsorted(uneven, doc[mine]), h[mine], 1 + np.log(count[mine]), len(uneven)))
        for i, keys in zip(uneven.tolist(), weighted, strict=True):
            out[i] = np.union1d(out[i], keys)
    return out


def split_words(text: str) -> list[str]:
    return text.lower().split()


def text_digest(text: str | Column) -> Column:
    """Tells texts of one doc_id apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text as it is), content (digest of the words in order), n (distinct shingles), bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [split_words(t) for t in b.column(2).to_pylist()]
            content = [hashlib.blake2b(" ".join(t).encode(), digest_size=16).digest() for t in texts]
            doc, h, count = shingles(texts)
            bands = document_bands(doc, h, count, len(texts))
            n = np.bincount(doc, minlength=len(texts))
            some = [x if k else None for x, k in zip(bands, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary()), pa.array(n, pa.int64()), pa.array(some, pa.list_(pa.int64()))], ["doc_id", "digest", "content", "n", "bands"])

    small_batches(docs.sparkSession)
    return texts_of(docs).select("doc_id", text_digest("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest binary, content binary, n long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """id and its distinct shingles as sorted 64-bit hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h, _ = shingles([split_words(t) for t in b.column(1).to_pylist()])
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
            packed = [h[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "set"])

    return texts.mapInArrow(run, "id long, set binary")


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and their packed sets x, y for pairs(a, b, crowd).

    `crowd` bounds how many pairs may share a: a's set is copied once per SHARE of them, and each pair picks a copy, so
    that no task gets all pairs of a leader.
    """
    copies = F.explode(F.sequence(F.lit(0), F.floor(F.col("crowd") / SHARE).cast("int")))
    left = pairs.groupBy("a").agg(F.max("crowd").alias("crowd")).join(sets.withColumnRenamed("id", "a"), "a").select("a", F.col("set").alias("x"), copies.alias("copy"))
    right = pairs.withColumn("copy", F.pmod(F.xxhash64("b"), (F.floor(F.col("crowd") / SHARE) + 1)).cast("int"))
    return right.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(left, ["a", "copy"]).select("a", "b", "x", "y")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs(a, b, crowd) of which the shingle sets have a Jaccard coefficient of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
                keep.append(same >= least * (len(p) + len(q) - same) and same > 0)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    return _met(pairs, sets).mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs(a, b, crowd) with `like` (a Jaccard coefficient of `least` or more), n (shingles of b), and how the sets
    differ: `lacks`, the shingles of a that b hasn't, and `adds`, those of b that a hasn't."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # differences may be long
                b = batch.slice(at, 64)
                like, n, lacks, adds = [], [], [], []
                for x, y in zip(b.column("x"), b.column("y"), strict=True):
                    p, q = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                    only, more = np.setdiff1d(p, q, assume_unique=True), np.setdiff1d(q, p, assume_unique=True)
                    same = len(q) - len(more)
                    like.append(same > 0 and same >= least * (len(p) + len(more)))
                    n.append(len(q))
                    lacks.append(only)
                    adds.append(more)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(v, k) for v, k in zip((like, n, lacks, adds), kinds[2:], strict=True))], ["a", "b", "like", "n", "lacks", "adds"])

    return _met(pairs, sets).mapInArrow(run, "a long, b long, like boolean, n long, lacks array<long>, adds array<long>")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and text of nodes(id, first): the text of the row that has the node's first doc_id and digest."""
    named = nodes.select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.digest").alias("digest"))
    texts = texts_of(docs).withColumn("digest", text_digest("text")).join(named, ["doc_id", "digest"])
    return texts.groupBy("id").agg(F.first("text").alias("text"))


def near_links(docs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b) between nodes(id, first, bands) that join all of them that are alike, directly or through others."""
    total = max(1, nodes.count())
    bands = nodes.where("bands is not null").select("id", F.explode("bands").alias("key"))
    crowds = stored(bands.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1"), "buckets")
    members = stored(join_groups(bands, crowds, "key", "crowd", total).where("crowd is not null"), "bucket-members")
    # The member that meets most others over all bands leads its buckets: among edited copies, one close to their source.
    known = members.groupBy("id").agg(F.sum("crowd").alias("met"))
    leaders = members.join(known, "id").groupBy("key").agg(F.max_by("id", F.struct("met", "id")).alias("leader"), F.count("*").alias("size"))
    led = join_groups(members, stored(leaders, "leaders"), "key", "size", total)
    pairs = led.where("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.max("crowd").alias("crowd"))
    pairs = stored(pairs, "leader-pairs")
    sets = stored(_sets(_texts(docs, nodes.select("id", "first").join(members.select("id").distinct(), "id", "left_semi"))), "shingle-sets")
    met = stored(_compared(pairs, sets, least), "compared")
    links = met.where("like").select("a", "b")
    return links.unionByName(_across(met, components(links), sets, least))


def _across(met: DataFrame, of: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between members of one leader that are of different components so far, by exact filters alone.

    A member is written as its difference X from the leader's set: d shingles that it lacks and e that it adds, so what
    a group of copies has in common isn't there at all.  Two members differ by the symmetric difference of X and Y, and
    are alike only if it is at most H = (n + m) (1 - least) / (1 + least).  So X and Y share at least
    k = (|X| + |Y| - H) / 2, and k - min(d, d') of that among what both add.  One of two members of different components
    isn't like the leader, which makes k positive.  If k > min(d, d'), they meet on an added shingle, else on any; and on
    one of the rarest |X| - k + 1 of each, in an order by how many members have it.  Copies that were edited each in its
    own way share no added shingle, so a group of them makes no pairs however large it is.
    """
    of = of.select(F.col("id").alias("_id"), "component")
    found = met.join(of, met["b"] == of["_id"], "left").withColumn("own", F.coalesce("component", "b")).drop("_id", "component")
    mixed = found.groupBy("a").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("size")).where("low <> high")
    mixed = mixed.join(of, mixed["a"] == of["_id"], "left").select("a", F.coalesce("component", "a").alias("home"), "size")
    mixed = stored(mixed, "mixed-leaders")
    rows = join_groups(found, mixed, "a", "size", max(1, met.count())).where("home is not null")
    rows = rows.select("a", F.col("b").alias("id"), "own", (F.col("own") != F.col("home")).alias("out"), "n", F.size("lacks").alias("d"), F.size("adds").alias("e"), "lacks", "adds")
    parts = F.concat(F.transform("adds", lambda x: F.struct(F.lit(True).alias("added"), x.alias("x"))), F.transform("lacks", lambda x: F.struct(F.lit(False).alias("added"), x.alias("x"))))
    # Rows with one key have, but for rare collisions, one leader and shingle; what a collision adds is verified away.
    each = rows.withColumn("part", F.explode(parts)).select("a", "id", "own", "out", "n", "d", "e", "part.added", F.xxhash64("a", "part.x").alias("key"))
    each = stored(each, "differences")
    often = each.groupBy("key").agg(F.count("*").alias("df"), (F.min("own") != F.max("own")).alias("apart")).where("df > 1")
    each = join_groups(each, stored(often, "difference-counts"), "key", "df", max(1, each.count())).withColumn("df", F.coalesce("df", F.lit(1)))
    order = Window.partitionBy("a", "id").orderBy("df", "key").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("rank", F.count("*").over(order)).withColumn("rank_added", F.count(F.when(F.col("added"), 1)).over(order))
    # A pair that needn't meet on an added shingle has e + e' <= H, which is at most n (1 - least) / least
    some = F.col("n") * ((1 - least) / least) + 1e-6
    may = F.col("added") | (F.col("e") <= some) & (F.col("rank") <= F.col("d") + F.col("e") - F.greatest(F.lit(1), F.ceil(F.col("d") + F.col("e") - some)) + 1)
    each = stored(each.where("apart").where(may).select("key", "id", "own", "out", "n", "d", "e", "added", "rank", "rank_added"), "difference-prefixes")
    left, right = each.where("out").alias("l"), each.alias("r")
    k = f"((l.d + l.e + r.d + r.e - (l.n + r.n) * {(1 - least) / (1 + least)!r}) / 2 - 1e-6)"
    both = f"greatest(1, ceil({k}))"
    more = f"greatest(1, ceil({k} - least(l.d, r.d)))"
    meet = f"""if({k} > least(l.d, r.d), l.added and l.rank_added <= l.e - {more} + 1 and r.rank_added <= r.e - {more} + 1,
                  l.rank <= l.d + l.e - {both} + 1 and r.rank <= r.d + r.e - {both} + 1)"""
    need = f"l.key = r.key and l.own <> r.own and (not r.out or l.id < r.id) and least(l.n, r.n) >= greatest(l.n, r.n) * {least - 1e-9!r} and {meet}"
    near = left.join(right, F.expr(need))
    pairs = near.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    pairs = stored(pairs, "difference-pairs")
    crowd = stored(pairs.groupBy("a").agg(F.count("*").alias("crowd")), "difference-crowds")
    return _verified(join_groups(pairs, crowd, "a", "crowd", max(1, pairs.count())), sets, least)


def _classified(docs: DataFrame, least: float) -> DataFrame:
    """near_duplicates with the digest of each row's text.

    Nodes are texts, not doc_ids: rows that share an id but not a text may be of different classes.
    """
    rows = stored(signed(docs), "signed")
    named = rows.where("doc_id is not null")
    groups = named.groupBy("content").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    groups = stored(groups.withColumn("id", F.monotonically_increasing_id()), "contents")
    total = rows.count()
    classes = components(near_links(docs, groups.select("id", "first", "bands"), least))
    of = groups.select("content", "first", "id", "size").join(classes, "id", "left").select("content", "first", F.coalesce("component", "id").alias("class"), "size")
    sizes = of.groupBy("class").agg(F.sum("size").alias("class_size"), F.min("first").alias("best"))
    of = stored(of.select("content", "class", F.col("size").alias("copies")), "content-classes")
    of = join_groups(of, stored(sizes, "class-sizes"), "class", "class_size", total)
    of = stored(of.where("class_size > 1").select("content", "best", "class_size", "copies"), "classes")
    out = join_groups(named.select("doc_id", "digest", "content", "n"), of, "content", "copies", total)
    mine = (F.col("best.doc_id") == F.col("doc_id")) & (F.col("best.digest") == F.col("digest"))
    out = out.select("doc_id", F.coalesce("best.doc_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(mine, F.lit(True)).alias("kept"), F.col("n").alias("n_shingles"), "digest")
    alone = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.col("n").alias("n_shingles"), "digest")
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Classes of documents that are alike, directly or through others, of docs(doc_id, text).

    Returns one row per row: doc_id, class_id (the smallest doc_id of the class), class_size (rows), kept (doc_id is
    class_id; of different texts of that id in the class, one is kept), n_shingles.  Texts of equal words (case and
    white space aside) are always of one class; so are all texts without words, null ones too.  Texts of fewer than five
    words are alike only if equal.  Repeated rows share all values; rows that share a doc_id but not a text may be of
    different classes.  A row with a null doc_id stands alone, with a null class, and is kept.  An empty table gives no
    rows.
    """
    return _classified(docs, least).drop("digest")


def without_near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs whose document is the one that its class keeps; all columns of docs, repeated rows once.

    Rows are one only if both doc_id and text are equal.  Every row with a null doc_id stays.
    """
    found = stored(_classified(docs, least), "near").where("doc_id is not null")
    key, of, mine = fresh(docs, "id", "of", "digest")
    dropped = found.where("not kept").select(F.col("doc_id").alias(key), F.col("digest").alias(of)).distinct()
    nameless, named = docs.where(docs["doc_id"].isNull()), docs.where(docs["doc_id"].isNotNull()).withColumn(mine, text_digest("text"))
    same = (F.col("doc_id").cast("long") == F.col(key)) & (F.col(mine) == F.col(of))
    kept = named.join(dropped, same, "left_anti")
    repeated = found.where("kept and class_size > 1").groupBy(F.col("doc_id").alias(key), F.col("digest").alias(of)).count().where("count > 1").drop("count")
    repeated = stored(repeated, "repeated")
    if not repeated.isEmpty():
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", mine]))
    return kept.drop(mine).unionByName(nameless)
