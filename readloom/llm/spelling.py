"""Groups of spelling variants by blocked Gram matrices of letter counts.

A word is a vector of letter counts.  One inserted or deleted letter changes one count by one, a replaced letter two, so
words at one edit are at a squared distance of 1 or 2.  Words are laid out in blocks of one length; blocks are cut
further by the counts of GROUPS groups of letters, which one edit changes by at most one each, so a block meets only
itself and its neighbours.  NumPy multiplies the count matrices of two blocks, |a|^2 + |b|^2 - 2ab gives all squared
distances, and the pairs at 2 or less are verified letter by letter.  Nothing is lost to the blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import join_groups, small_batches, stored, texts_of

#: The letters in code-point order; each has a Latin-1 byte.
LETTERS = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0xC0, 0x100))
GROUPS = 6
#: Words, and bytes of words, in one tile of a block; words that a Python worker counts before it hands them on.
TILE_WORDS, TILE_BYTES, HELD = 1024, 1 << 20, 200_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in LETTERS else 32 for c in range(256))
_CODE = np.zeros(256, np.int64)
_CODE[list(LETTERS)] = np.arange(len(LETTERS))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def misspelt(prefix: int, run: bytes, every: int) -> bytes:
    """The run, without one letter where the checksum of `<doc_id>:<run>` is a multiple of `every`; prefix: crc32 of `<doc_id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % every:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word and n (occurrences) of the words of `shortest` letters or more that occur `least` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for w, n in Counter(runs(text)).items():
                    w = misspelt(prefix, w, every)
                    if len(w) >= shortest:
                        found[w] += n
                if len(found) > HELD:
                    yield out()
                    found.clear()
        yield out()

    small_batches(docs.sparkSession)
    counted = texts_of(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def _tiles(words: DataFrame) -> DataFrame:
    """The blocks of words(word, n), cut into tiles by a hash: id, g0.. (letters of each group), words (word, n)."""
    g = [f"g{k}" for k in range(GROUPS)]
    letters = [bytes(c for c in LETTERS if c % GROUPS == k).decode("latin-1") for k in range(GROUPS)]
    counts = [F.length("word") - F.length(F.translate("word", x, "")) for x in letters]
    rows = words.select("word", "n", *[c.alias(k) for c, k in zip(counts, g, strict=True)]).withColumn("cell", F.concat_ws("-", *g))
    sizes = stored(rows.groupBy("cell").agg(F.count("*").alias("size"), F.max(F.length("word")).alias("letters")), "spelling-cells")
    total = sizes.agg(F.sum("size")).first()[0] or 1
    fit = F.greatest(F.lit(1), F.least(F.lit(TILE_WORDS), F.floor(F.lit(TILE_BYTES) / F.col("letters"))))
    rows = join_groups(rows, sizes, "cell", "size", total)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / fit)))
    tiles = rows.groupBy("cell", *g, "tile").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return stored(tiles.withColumn("id", F.monotonically_increasing_id()), "spelling-tiles")


def _cell(changed: dict[int, int]) -> Column:
    return F.concat_ws("-", *[(F.col(f"g{k}") + changed.get(k, 0)).cast("string") for k in range(GROUPS)])


def _neighbours() -> list[Column]:
    """A block, those with a letter more, and those with a letter of another group; of two neighbours one names the other."""
    more = [{k: 1} for k in range(GROUPS)]
    other = [{i: 1, j: -1} for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    return [_cell(x) for x in ({}, *more, *other)]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length as rows of Latin-1 bytes, and their letter counts."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    at = _CODE[letters] + np.arange(len(words))[:, None] * len(LETTERS)
    counts = np.bincount(at.ravel(), minlength=len(words) * len(LETTERS)).reshape(len(words), -1)
    exact = np.float32 if letters.shape[1] ** 2 * 4 < 1 << 24 else np.float64
    return letters, counts.astype(exact)


def near_pairs(left: list[str], right: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of left and right (None: left again, each pair once) that are at one edit.

    Each list has words of one length; right's are as long as left's or one letter longer.
    """
    a, x = _matrix(left)
    b, y = (a, x) if right is None else _matrix(right)
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(squares <= 2)
    if right is None:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    near, step = np.zeros(len(i), bool), max(1, TILE_BYTES // b.shape[1])
    for s in range(0, len(i), step):
        p, q = a[i[s : s + step]], b[j[s : s + step]]
        if p.shape[1] == q.shape[1]:
            near[s : s + step] = (p != q).sum(1) == 1
        else:  # the letters before the added one and those after it are the same
            head = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(1)
            tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            near[s : s + step] = head + tail >= p.shape[1]
    return i[near], j[near]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            x, y = b.column("left")[r].values, b.column("right")[r].values
            same = b.column("a")[r].as_py() == b.column("b")[r].as_py()
            i, j = near_pairs(x.field(0).to_pylist(), None if same else y.field(0).to_pylist())
            if len(i):
                p, q = x.take(pa.array(i)), y.take(pa.array(j))
                cols = [pa.concat_arrays(z) for z in ((p.field(0), q.field(0)), (q.field(0), p.field(0)), (q.field(1), p.field(1)))]
                yield pa.RecordBatch.from_arrays(cols, ["word", "other", "other_n"])


def neighbours(words: DataFrame) -> DataFrame:
    """word, other, other_n: the pairs of words(word, n) at one edit, each in both directions.

    A word of length l has at most 180 l + 90 near words whatever the vocabulary, so neither rows nor keys grow beyond it.
    """
    tiles = _tiles(words)
    index = tiles.select("id", "cell", *[f"g{k}" for k in range(GROUPS)])
    meets = index.select(F.col("id").alias("a"), "cell", F.explode(F.array(*_neighbours())).alias("next"))
    meets = meets.join(index.select(F.col("id").alias("b"), F.col("cell").alias("next")), "next").where("cell <> next or a <= b")
    pairs = stored(meets.select("a", "b"), "spelling-meets")
    pairs = pairs.join(tiles.select(F.col("id").alias("a"), F.col("words").alias("left")), "a")
    pairs = pairs.join(tiles.select(F.col("id").alias("b"), F.col("words").alias("right")), "b")
    return pairs.select("a", "b", "left", "right").mapInArrow(_met, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of forms(word, form): the end of its chain.  Each round doubles the step, and n doubles along a chain."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """Words of docs(doc_id, text) with the commoner spelling that each is near to.

    Returns word, form (the near word of largest n, ties by code points, if its n is `times` that of the word, at least 2;
    else null), root (the last of the chain of forms, or the word), n, n_near, form_n.  A run loses one letter where the
    checksum of its doc_id and itself is a multiple of `every`.  A null text has no words; a null doc_id counts as an
    empty one; repeated rows count again.  Texts without words and an empty table give no rows.
    """
    if times < 2:
        raise ValueError("times below 2 would let chains of forms run in circles")
    words = stored(word_counts(docs, shortest, least, every), "spelling-words")
    best = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    form_n = F.when(-F.col("best.less") >= F.col("n") * times, -F.col("best.less"))
    forms = words.join(best, "word", "left").select("word", F.when(form_n.isNotNull(), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))
    forms = stored(forms, "spelling-forms")
    roots = _roots(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
