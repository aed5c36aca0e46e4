"""Jaccard join of word n-gram sets by size-banded tiles with hashed bitmap signatures.

Linked sets differ in size by a tenth at most, so sets are laid out in bands of which only neighbours meet.  Two linked
sets of a band differ in at most H shingles; if the hash space is cut into H + 1 parts, they agree in all of one part at
least.  A tile holds the sets of a band that agree in a part, so tiles lose no link, and shingles that many texts share
don't fill them.  Each set has a bitmap of its hashed shingles: every bit of one that the other lacks is a shingle that
they don't share, so bit counts bound the overlap from above, and only pairs that the bound lets pass go through the
exact intersection of the sorted sets.

Every member of a tile is compared with the tile's first one.  Where members of one leader are of several components
after that, those outside the leader's component are laid out by size in tiles of bounded bytes and meet each other and the
rest there, so no link is lost to the star shape; a pair of tiles hands on what joins its components, not all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import join_groups, small_batches, stored, texts_of
from readloom.llm.components import components
from readloom.llm.near_dedup import GOLDEN, WordHashes, mix, text_digest

#: Members of a leader that are compared with one copy of its set; bytes of sets in a tile of the second step.
SHARE, TILE_BYTES = 250, 4 << 20
_hashes = WordHashes()


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts: text and 64-bit hash, sorted by both.  Fewer words than a shingle's are one shingle."""
    split = [t.lower().split() for t in texts]  # of bytes: A-Z, and the six ASCII white-space characters
    lengths = np.array([len(t) for t in split], np.int64)
    total = int(lengths.sum())
    word = np.fromiter((_hashes[w] for t in split for w in t), np.uint64, total)
    doc = np.repeat(np.arange(len(split)), lengths)
    width = np.minimum(words, lengths)[doc]
    first = np.arange(total) + width <= np.cumsum(lengths)[doc]
    with np.errstate(over="ignore"):
        h = mix(word + GOLDEN)
        for j in range(1, words):
            go = np.flatnonzero(width[: max(0, total - j)] > j)
            go = go[go + j < total]
            h[go] = mix(h[go] * np.uint64(3) + word[go + j])
    doc, h = doc[first], h[first]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


class Bands:
    """Bands of set sizes: linked sets are of one band or of neighbours.  edge[b] is the least size of band b.

    The sets of bands b and b + 1 that are linked differ in at most apart[b] shingles; their hash space has parts[b] parts.
    """

    def __init__(self, percent: int, most: int):
        edges = [1, 2]
        while edges[-3:][0] <= most:
            edges.append(max(edges[-1] + 1, 100 * (edges[-1] - 1) // percent + 1))
        self.edge = np.array(edges[:-2], np.int64)
        self.apart = (100 - percent) * 2 * (np.array(edges[2:], np.int64) - 1) // (100 + percent)
        # Spare parts: a set with more empty parts than these is rare, so an empty part needn't be a meeting place.
        self.spare = np.minimum(self.apart // 8, 2)
        self.parts = self.apart + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, sizes, "right") - 1


def part_keys(doc: np.ndarray, h: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and 64-bit key of the tiles of each set: band and part, with the hash of what the set has there.

    Sets that may only be linked if equal have none.  Of two linked sets, either the spare parts outnumber the empty ones
    of one set, and then they agree in a part with shingles, or both meet in their empty parts too.
    """
    bands = Bands(percent, int(n.max(initial=1)))
    docs, keys = [], []
    for down in (0, 1):
        band = bands.of(np.maximum(n, 1)) - down
        use = (band >= 0) & (n > 0)
        use[use] = bands.apart[band[use]] > 0
        parts = np.where(use, bands.parts[band], 0)
        mine = use[doc]
        d, x = doc[mine], h[mine]
        if not len(d):
            continue
        base = np.cumsum(parts) - parts
        with np.errstate(over="ignore"):
            part = ((x >> np.uint64(32)) * parts[d].astype(np.uint64)) >> np.uint64(32)
            slot = base[d] + part.astype(np.int64)
            start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            content = np.zeros(int(parts.sum()), np.uint64)
            content[slot[start]] = np.add.reduceat(mix(x + GOLDEN), start)
            owner = np.repeat(np.arange(len(n)), parts)
            number = np.arange(len(owner)) - base[owner]
            key = mix(content * np.uint64(5) + mix((band[owner] * (1 << 32) + number).astype(np.uint64) + GOLDEN))
        full = np.zeros(len(owner), bool)
        full[slot] = True
        empty = parts - np.bincount(owner[full], minlength=len(n))
        told = full | (empty > np.where(use, bands.spare[band], 0))[owner]
        docs.append(owner[told])
        keys.append(key[told])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(keys).view(np.int64)


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, digest (of the text), content (of the set), n (its size) and keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h = shingle_sets([t.encode() for t in b.column(2).to_pylist()], words)
            n = np.bincount(doc, minlength=b.num_rows)
            cuts = np.cumsum(n)
            content = [hashlib.blake2b(h[e - k : e].tobytes(), digest_size=16).digest() for e, k in zip(cuts, n, strict=True)]
            owner, key = part_keys(doc, h, n, percent)
            key = key[np.argsort(owner, kind="stable")]
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=b.num_rows)))
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary()), pa.array(n, pa.int64()), keys], ["doc_id", "digest", "content", "n", "keys"])

    small_batches(docs.sparkSession)
    return texts_of(docs).select("doc_id", text_digest("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest binary, content binary, n long, keys array<long>")


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the hashed shingles, as 64-bit words."""
    at = np.unique((h & np.uint64(0xFFFFFFFF)) % np.uint64(bits))
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def bits_for(n: int) -> int:
    """About four bits for each shingle of the larger of two sets."""
    return 64 << max(0, int(4 * n / 64).bit_length())


def bound(x: np.ndarray, n: int, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of a set with bitmap x and size n and the sets with bitmaps y (rows) and sizes m."""
    lacks, more = np.bitwise_count(x & ~y).sum(1, dtype=np.int64), np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
    return np.minimum(n - lacks, m - more)


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether sorted sets have an intersection of `percent` hundredths of their union at least."""
    at = np.searchsorted(q, p)
    same = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(p) and len(q) else 0
    return same > 0 and 100 * same >= percent * (len(p) + len(q) - same)


def _passing(sets: list[np.ndarray], i: int, others: np.ndarray, maps: np.ndarray, percent: int) -> np.ndarray:
    """Of the others, those that size and bitmap don't rule out as links of set i."""
    n, m = len(sets[i]), np.array([len(sets[j]) for j in others], np.int64)
    fit = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    others, m = others[fit], m[fit]
    most = bound(maps[i], n, maps[others], m)
    return others[100 * most >= percent * (n + m - most)]


def _leader_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                keep = []
                for x, y in zip(b.column("x"), b.column("y"), strict=True):
                    sets = [np.frombuffer(z.as_py(), np.uint64) for z in (x, y)]
                    bits = bits_for(max(map(len, sets)))
                    maps = np.stack([bitmap(s, bits) for s in sets])
                    keep.append(len(_passing(sets, 0, np.array([1]), maps, percent)) > 0 and linked(*sets, percent))
                rows = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([b.column("a").take(rows), b.column("b").take(rows)], ["a", "b"])

    return run


def tile_links(ids: list[int], own: list[int], sets: list[np.ndarray], left: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of two tiles: members [0, left) meet those from `left` on; left 0: all meet all.

    `own` names the component that a member is of so far; members of one component aren't compared.
    """
    top = {c: c for c in own}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    bits = bits_for(max(map(len, sets), default=1))
    maps = np.stack([bitmap(s, bits) for s in sets])
    comps, out = np.array(own), []
    for i in range(left or len(ids)):
        others = np.arange(left or i + 1, len(ids))
        others = others[comps[others] != comps[i]]
        for j in _passing(sets, i, others, maps, percent).tolist():
            a, b = find(own[i]), find(own[j])
            if a != b and linked(sets[i], sets[j], percent):
                top[a] = b
                out.append((ids[i], ids[j]))
    return out


def _tile_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = b.column("left")[r].as_py()
                y = [] if b.column("s")[r].as_py() == b.column("t")[r].as_py() else b.column("right")[r].as_py()
                both = x + y
                found = tile_links([m["id"] for m in both], [m["own"] for m in both], [np.frombuffer(m["set"], np.uint64) for m in both], len(x) if y else 0, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*found, strict=True)], ["a", "b"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and packed sorted set of wanted(id, doc_id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h = shingle_sets([t.encode() for t in b.column(1).to_pylist()], words)
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
            packed = [h[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "set"])

    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))
    named = wanted.select("id", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    texts = texts_of(docs).withColumn("digest", text_digest("text")).join(named, same)
    return texts.groupBy("id").agg(F.first("text").alias("text")).mapInArrow(run, "id long, set binary")


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and their sets x, y for pairs(a, b, crowd); a's set is copied once per SHARE of the crowd, so no task gets them all."""
    copies = F.explode(F.sequence(F.lit(0), F.floor(F.col("crowd") / SHARE).cast("int")))
    left = pairs.groupBy("a").agg(F.max("crowd").alias("crowd")).join(sets.withColumnRenamed("id", "a"), "a").select("a", F.col("set").alias("x"), copies.alias("copy"))
    right = pairs.withColumn("copy", F.pmod(F.xxhash64("b"), F.floor(F.col("crowd") / SHARE) + 1).cast("int"))
    return right.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(left, ["a", "copy"]).select("a", "b", "x", "y")


def _across(pairs: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one leader that are of different components so far, by tiles of their sets.

    Members outside the leader's component meet each other and those of it, which don't meet among themselves.  Tiles
    are of one leader and band and hold TILE_BYTES of sets; neighbouring bands meet.
    """
    of = components(links).select(F.col("id").alias("_id"), "component")
    crowd = pairs.select("a", "b", "crowd").join(of, F.col("b") == F.col("_id"), "left").withColumn("own", F.coalesce("component", "b")).drop("_id", "component")
    crowd = stored(crowd, "leader-members")
    mixed = crowd.groupBy("a").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("size")).where("low <> high")
    mixed = mixed.join(of, F.col("a") == F.col("_id"), "left").select("a", F.coalesce("component", "a").alias("home"), "size")
    mixed = stored(mixed, "mixed-leaders")
    rows = join_groups(crowd, mixed, "a", "size", max(1, crowd.count())).where("home is not null")
    rows = rows.select("a", F.col("b").alias("id"), "own", (F.col("own") != F.col("home")).alias("out"))
    sized = rows.join(sets, "id").withColumn("n", F.length("set") / 8)
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("long")
    sized = stored(sized.select("a", "id", "own", "out", band.alias("band"), "set"), "tile-members")
    key = ["a", "out", "band"]
    sizes = sized.groupBy(*key).agg(F.count("*").alias("size"), F.ceil(F.sum(F.length("set")) / TILE_BYTES).alias("tiles"))
    sizes = stored(sizes.withColumn("group", F.concat_ws(" ", *key)), "tile-sizes")
    dealt = join_groups(sized.withColumn("group", F.concat_ws(" ", *key)), sizes.select("group", "size", "tiles"), "group", "size", max(1, sized.count()))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    tiles = dealt.groupBy(*key, "tile").agg(F.collect_list(F.struct("id", "own", "set")).alias("members"))
    tiles = stored(tiles.withColumn("id", F.monotonically_increasing_id()), "tiles")
    index = tiles.select("id", *key)
    left = index.where("out").select(F.col("id").alias("s"), "a", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    meets = left.join(index.withColumnRenamed("id", "t"), ["a", "band"]).where("not out or s <= t")
    meets = stored(meets.select("s", "t"), "tile-meets")
    meets = meets.join(tiles.select(F.col("id").alias("s"), F.col("members").alias("left")), "s").join(tiles.select(F.col("id").alias("t"), F.col("members").alias("right")), "t")
    return meets.select("s", "t", "left", "right").mapInArrow(_tile_links(percent), "a long, b long")


def set_links(nodes: DataFrame, members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join all nodes(id, doc_id, digest) that are linked; members(id, key, leader, crowd) of tiles."""
    pairs = members.where("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.max("crowd").alias("crowd"))
    pairs = stored(pairs, "tile-leaders")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(_sets(docs, nodes.select("id", "doc_id", "digest").join(wanted, "id"), words), "ngram-sets")
    links = stored(_met(pairs, sets).mapInArrow(_leader_links(percent), "a long, b long"), "leader-links")
    return links.unionByName(_across(pairs, links, sets, percent))


def ngram_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """Components of the texts of docs(doc_id, text) whose sets of word n-grams have a Jaccard coefficient of percent/100 or more.

    Returns one row per row: doc_id, n_shingles (size of the set), component_id (the smallest doc_id reachable by links,
    itself included).  Words are what ASCII white space parts, A-Z lower-cased; a text of fewer words than a shingle's has
    all of them as its one shingle.  Texts without words, null ones too, are linked with nothing: component_id is the
    doc_id.  Equal sets are always linked.  Repeated rows share all values; rows that share a doc_id but not a text may be
    of different components.  A row with a null doc_id takes part in links, and has a null component only if no row of
    its component has an id.  An empty table gives no rows.
    """
    if not 0 < percent < 100:
        raise ValueError("percent is to be between 0 and 100; equal sets are found by exact dedup")
    rows = stored(_signed(docs, words, percent).withColumn("row", F.monotonically_increasing_id()), "ngram-rows")
    total = max(1, rows.count())
    some = rows.where("n > 0").select("row", "doc_id", "digest", "content")
    nodes = some.groupBy("content").agg(F.min(F.struct("row", "doc_id", "digest")).alias("one"), F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    nodes = stored(nodes.select("content", F.col("one.row").alias("id"), F.col("one.doc_id").alias("doc_id"), F.col("one.digest").alias("digest"), "first", "copies"), "ngram-nodes")
    again = join_groups(some.select("row", "content"), nodes.where("copies > 1").select("content", "id", "copies"), "content", "copies", total)
    again = stored(again.where("row <> id").select("row", "id"), "ngram-copies")
    keys = rows.select("row", F.explode("keys").alias("key"))
    # All rows of a set have its keys, so the first row of a tile is the first of its set, a node.
    crowds = stored(keys.groupBy("key").agg(F.count("*").alias("crowd"), F.min("row").alias("leader"), F.max("row").alias("last")).where("leader <> last").drop("last"), "ngram-tiles")
    members = join_groups(keys, crowds, "key", "crowd", max(1, total)).where("crowd is not null and row <> leader")
    members = members.groupBy("row", "leader").agg(F.max("crowd").alias("crowd"))
    members = members.join(again, "row", "left").select(F.coalesce("id", "row").alias("id"), "leader", "crowd")
    links = set_links(nodes, members, docs, words, percent)
    of = components(links).select("id", "component")
    of = nodes.select("id", "content", "first", "copies").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = stored(of.select("content", "component", "first", "copies"), "ngram-components")
    firsts = of.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    of = join_groups(of, stored(firsts, "ngram-firsts"), "component", "size", max(1, of.count()))
    of = stored(of.select("content", "component_id", "copies"), "ngram-classes")
    named = join_groups(rows.where("n > 0").select("doc_id", "n", "content"), of, "content", "copies", total)
    named = named.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
