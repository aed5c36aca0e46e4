"""Language-model scores by classes of words: a class follows a class, and emits a word.

Words are lower-cased runs without white space, and every text ends with an end token.  Classes come from exchange: a
word is put where the class bigrams of the corpus become most likely.

1. The START most frequent words exchange classes among themselves, on the driver, from the table of their bigrams, whose
   size is bounded by START alone.
2. The other words of the MIDDLE most frequent are put, by Spark, where their neighbours of step 1 make them likeliest.
   Then all but the START words leave their classes and are put again, with all MIDDLE words as neighbours.
3. All other words of the corpus are put, by Spark, where their neighbours among the MIDDLE words make them likeliest.
   There may be any number of them.

So every word of the training texts has a class by exchange, and all counts are taken over all training texts.  Texts are
cut into tokens twice: to count these, and to write them as numbers, which all later steps read.  A number stands for one
of the HELD most frequent words; the other words stand in a list beside the numbers, and their counts and classes meet
the texts in joins.  How many words are held is a matter of memory alone: classes and scores don't depend on it.

    log P(text) = sum over tokens of log P(class | class before) + log P(token | class)
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import crc_mod, small_batches, stored, texts_of

END = b"\n"  # can't be a word
#: Words that exchange classes on the driver, words whose classes place all rarer words, classes, rounds of exchange.
START, MIDDLE, CLASSES, ROUNDS = 2000, 20_000, 48, 6
#: Words that every task holds (all MIDDLE words are among them): memory alone, no part of the model.
HELD = 200_000
#: Weight of a class's own frequency against its frequency after the class before.
ALONE = 0.15
FLUSH = 400_000
#: Words placed at a time.
BLOCK = 4000


def tokens(text: str) -> list[bytes]:
    """bytes.lower() lowers A to Z alone, and bytes.split() cuts at space and the controls 9 to 13."""
    return [*text.encode().lower().split(), END]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The tokens of many texts in a row, after an end token: each text begins after the end of the one before."""
    for b in batches:
        out = [END]
        for text in b.column("text").to_pylist():
            out += text.lower().split()
            out.append(END)
        yield out


def _bytes(texts: DataFrame, *others: str) -> DataFrame:
    small_batches(texts.sparkSession)
    return texts.select(*others, F.col("text").cast("binary").alias("text"))


def token_counts(texts: DataFrame) -> DataFrame:
    """token, n: counts of all tokens, put together in each task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])
            counts.clear()
            return out

        for stream in _streams(batches):
            counts.update(stream[1:])
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()

    return _bytes(texts).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent tokens and their counts, the end token first; at most that many.

    Where to cut comes from counts of tokens by the logarithm of their frequency and, at the last one, by a hash, so the
    driver gets no more rows than it keeps, however many tasks there are.
    """
    step, slot = F.floor(F.log2(F.col("n").cast("double")) * 16), F.pmod(F.xxhash64("token"), F.lit(4096))
    others = counts.where(F.col("token") != END).withColumn("step", step).withColumn("slot", slot)

    def cut(by: DataFrame, column: str, falling: bool, room: int) -> tuple[int | None, int]:
        """The first value that doesn't fit as a whole, and the room left before it."""
        for r in sorted(by.groupBy(column).agg(F.count("*").alias("v")).collect(), key=lambda r: r[column], reverse=falling):
            if r.v > room:
                return r[column], room
            room -= r.v
        return None, room

    last, room = cut(others, "step", True, most - 1)
    if last is not None:
        end, _ = cut(others.where(F.col("step") == last), "slot", False, room)
        others = others.where((F.col("step") > last) | (F.col("step") == last) & (F.col("slot") < end))
    top = sorted(((r.n, bytes(r.token)) for r in others.select("token", "n").collect()), key=lambda x: (-x[0], x[1]))
    return {END: sum(r.n for r in counts.where(F.col("token") == END).collect())} | {token: n for n, token in top}


def coded(texts: DataFrame, words: list[bytes], *others: str) -> DataFrame:
    """row, the other columns, ids and rare of each of texts(text): ids are the tokens' places in words as little-endian
    32-bit numbers, -1 for those that aren't there, which stand in rare, in order.  row numbers the texts."""
    shared = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            ids, rare = [], []
            for text in b.column("text").to_pylist():
                stream = text.lower().split()
                stream.append(END)
                at = np.fromiter(map(get, stream, repeat(-1)), np.int32, len(stream))
                ids.append(at.tobytes())
                rare.append([stream[i] for i in np.flatnonzero(at < 0).tolist()])
            columns = [b.column(c) for c in ("row", *others)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], ["row", *others, "ids", "rare"])

    numbered = _bytes(texts.withColumn("row", F.monotonically_increasing_id()), "row", *others)
    kinds = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in others)
    return numbered.mapInArrow(run, f"row long, {kinds}ids binary, rare array<binary>")


def _numbers(column: pa.Array) -> np.ndarray:
    """The ids of many texts in a row, after an end token: each text begins after the end of the one before."""
    return np.frombuffer(b"".join([bytes(4), *column.to_pylist()]), np.int32).astype(np.int64)


def start_bigrams(texts: DataFrame, size: int) -> np.ndarray:
    """How often each of the first `size` words follows each, over all coded texts(ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for b in batches:
            ids = _numbers(b.column("ids"))
            left, right = ids[:-1], ids[1:]
            both = (left >= 0) & (right >= 0) & (left < size) & (right < size)
            np.add.at(table, left[both] * size + right[both], 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["pair", "n"])

    sums = texts.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = np.zeros(size * size, np.int64)
    rows = stored(sums, "start-bigrams").toArrow()  # at most the square of START
    table[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return table.reshape(size, size)


def likelihood(c: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to a constant of the words."""
    def xlogx(a):
        return float((a * np.log(np.maximum(a, 1))).sum())

    return xlogx(c) - xlogx(c.sum(1)) - xlogx(c.sum(0))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, size: int, classes: int, rounds: int) -> np.ndarray:
    """Classes of `size` units from their bigrams (left[i], right[i]) with counts n[i], by the exchange algorithm.

    Units begin in classes by rank; in each round every unit, the most frequent first, is taken out of its class and
    put where the likelihood of the class bigrams is greatest.  A move is weighed in time of the classes alone, from
    the unit's counts by class of its neighbours.
    """
    freq = np.bincount(left, n, size) + np.bincount(right, n, size)
    order = np.argsort(-freq, kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.arange(size) % classes
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    at_left, at_right = np.searchsorted(left[by_left], np.arange(size + 1)), np.searchsorted(right[by_right], np.arange(size + 1))
    table = np.zeros((classes, classes))
    np.add.at(table, (of[left], of[right]), n)

    def f(a):
        return a * np.log(np.maximum(a, 1e-300))

    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            if not freq[u]:
                continue
            out, into = by_left[at_left[u] : at_left[u + 1]], by_right[at_right[u] : at_right[u + 1]]
            own = float(n[out][right[out] == u].sum())
            after, before = np.bincount(of[right[out]], n[out], classes), np.bincount(of[left[into]], n[into], classes)
            g = of[u]
            after[g] -= own
            before[g] -= own
            table[g] -= after
            table[:, g] -= before
            table[g, g] -= own
            # Putting u into class c adds `after` to row c, `before` to column c, and `own` to the cell of both.
            gain = (f(table + after) - f(table)).sum(1) + (f(table + before[:, None]) - f(table)).sum(0)
            cell = np.diag(table)
            gain += f(cell + after + before + own) - f(cell + after) - f(cell + before) + f(cell)
            # Wherever u is put, rows gain `before` and columns `after`; row and column c gain the rest as well.
            rows, cols = table.sum(1) + before, table.sum(0) + after
            gain -= f(rows + after.sum() + own) - f(rows) + f(cols + before.sum() + own) - f(cols)
            c = int(gain.argmax())
            moved += c != g
            of[u] = c
            table[c] += after
            table[:, c] += before
            table[c, c] += own
        if not moved:
            break
    return of


def best_classes(
    table: np.ndarray, word: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, size: int, other: int, now: np.ndarray | None = None
) -> np.ndarray:
    """The class of each of `size` words in which `table`, the class bigrams, becomes most likely.

    Word word[i] comes n[i] times between the classes before[i] and after[i] (-1: not known).  The words aren't in the
    table yet, or are in the classes `now`, which each leaves alone before it is put.  One without a known neighbour
    gets the class `other`.
    """
    classes = len(table)

    def f(a):
        return a * np.log(np.maximum(a, 1e-300))

    def dense(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = at >= 0
        sums = np.bincount(word[have] * classes + at[have], n[have], size * classes)
        return sums.reshape(size, classes), np.flatnonzero(sums)

    (into, into_at), (out, out_at) = dense(before), dense(after)
    gain = np.zeros((size, classes))
    for at, sums, cells in ((out_at, out, table.T), (into_at, into, table)):
        w, c = np.divmod(at, classes)
        for some in np.array_split(np.arange(len(at)), len(at) // 20_000 + 1):
            cell = cells[c[some]]  # for words before class c: column c of the table, by the row the word would be in
            np.add.at(gain, w[some], f(cell + sums[w[some], c[some]][:, None]) - f(cell))
    cell = np.diag(table)
    gain += f(cell + out + into) - f(cell + out) - f(cell + into) + f(cell)
    outs, intos = out.sum(1, keepdims=True), into.sum(1, keepdims=True)
    rows, cols = table.sum(1) + into, table.sum(0) + out
    if now is not None:
        each = np.arange(size)
        own_out, own_into = out[each, now][:, None], into[each, now][:, None]
        to, of = table.T[now], table[now]  # cells of every class before the word's own one, and of its own one before every class
        less_to, less_of = np.maximum(to - into, 0), np.maximum(of - out, 0)
        gain += f(less_to + own_out) - f(less_to) - f(to + own_out) + f(to)
        gain += f(less_of + own_into) - f(less_of) - f(of + own_into) + f(of)
        cell = np.maximum(np.diag(table)[now] - own_out[:, 0] - own_into[:, 0], 0)
        less_to[each, now] = less_of[each, now] = cell
        stay = (f(less_of + out) - f(less_of)).sum(1) + (f(less_to + into) - f(less_to)).sum(1)
        a, b = own_out[:, 0], own_into[:, 0]
        gain[each, now] = stay + f(cell + a + b) - f(cell + a) - f(cell + b) + f(cell)
        rows, cols = rows - into, cols - out
        rows[each, now] -= outs[:, 0]
        cols[each, now] -= intos[:, 0]
    gain -= f(rows + outs) - f(rows) + f(cols + intos) - f(cols)
    best = gain.argmax(1)
    best[(intos[:, 0] == 0) & (outs[:, 0] == 0)] = other
    return best


def _placed(contexts: DataFrame, key: str, kind: str, table: np.ndarray, other: int, now: np.ndarray | None = None) -> DataFrame:
    """key, n and class of each word of contexts(key, l, r, n), classes before and after it; now: classes by key."""
    each = contexts.groupBy(key).agg(F.sum("n").alias("n"), F.collect_list(F.struct("l", "r", "n")).alias("at"))  # at most (CLASSES + 1) squared
    shared = contexts.sparkSession.sparkContext.broadcast((table, now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                b = batch.slice(first, BLOCK)
                at = b.column("at")
                lengths, flat = at.value_lengths().to_numpy(zero_copy_only=False), at.flatten()
                l, r, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("l", "r", "n"))
                classes = None if now is None else now[b.column(key).to_numpy()]
                of = best_classes(table, np.repeat(np.arange(len(b)), lengths), l, r, n, len(b), other, classes)
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("n"), pa.array(of.astype(np.int32))], [key, "n", "class"])

    return each.mapInArrow(run, f"{key} {kind}, n long, class int")


def _summed(contexts: DataFrame, key: str) -> DataFrame:
    """Sums of contexts(key, l, r, n) that tasks have put together; dealt by key, so that _placed needn't deal them again."""
    return contexts.repartition(key).groupBy(key, "l", "r").agg(F.sum("n").alias("n"))


def held_contexts(texts: DataFrame, first: int, end: int, of: np.ndarray) -> DataFrame:
    """id, l, r, n: how often each word with first <= id < end comes between which classes (-1: not known)."""
    shared = texts.sparkSession.sparkContext.broadcast(of)
    base = int(of.max()) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.append(shared.value, -1)
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            word, l, r = keys // (base * base), keys // base % base - 1, keys % base - 1
            return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (word, l, r)), pa.array(n)], ["id", "l", "r", "n"])

        for b in batches:
            ids = _numbers(b.column("ids"))
            cls = of[ids]
            at = np.flatnonzero((ids >= first) & (ids < end))
            at = at[(cls[at - 1] >= 0) | (cls[at + 1] >= 0)]
            parts.append((ids[at] * base + cls[at - 1] + 1) * base + cls[at + 1] + 1)
            if sum(map(len, parts)) > 4_000_000:
                yield flush()
        if parts:
            yield flush()

    return _summed(texts.select("ids").mapInArrow(run, "id int, l int, r int, n long"), "id")


def rare_contexts(texts: DataFrame, of: np.ndarray) -> DataFrame:
    """token, l, r, n: how often each word that isn't held comes between which classes (-1: not known)."""
    shared = texts.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = np.append(shared.value, -1), Counter()

        def flush() -> pa.RecordBatch:
            columns = [*zip(*counts, strict=True), counts.values()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["token", "l", "r", "n"])
            counts.clear()
            return out

        for b in batches:
            ids = _numbers(b.column("ids"))
            at, cls = np.flatnonzero(ids < 0), of[ids]
            counts.update(zip(b.column("rare").flatten().to_pylist(), cls[at - 1].tolist(), cls[at + 1].tolist(), strict=True))
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()

    return _summed(texts.select("ids", "rare").mapInArrow(run, "token binary, l int, r int, n long"), "token")


def known_bigrams(texts: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """How often each class follows each where both are known (not -1), over all coded texts."""
    shared = texts.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = np.append(shared.value, -1), np.zeros(classes * classes, np.int64)
        for b in batches:
            cls = of[_numbers(b.column("ids"))]
            both = (cls[:-1] >= 0) & (cls[1:] >= 0)
            table += np.bincount(cls[:-1][both] * classes + cls[1:][both], minlength=classes * classes)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["pair", "n"])

    table = np.zeros(classes * classes)
    for r in texts.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r.pair] = r.n  # at most the square of the classes
    return table.reshape(classes, classes)


def class_bigrams(texts: DataFrame, of: np.ndarray, tail: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each, over all coded texts; tail(token, class) has the words that aren't held."""
    shared = texts.sparkSession.sparkContext.broadcast(of)
    names = ["token", "other", "l", "r", "n"]
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.append(shared.value, -1)
        table, counts = np.zeros(classes * classes, np.int64), Counter()

        def flush() -> pa.RecordBatch:
            columns = [*zip(*counts, strict=True), counts.values()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            counts.clear()
            return out

        for b in batches:
            cls = of[_numbers(b.column("ids"))]
            both = (cls[:-1] >= 0) & (cls[1:] >= 0)
            table += np.bincount(cls[:-1][both] * classes + cls[1:][both], minlength=classes * classes)
            rare, at = b.column("rare").flatten().to_pylist(), np.flatnonzero(cls < 0)
            before, after = cls[at - 1], cls[at + 1]
            counts.update(zip(rare, repeat(None), before.tolist(), after.tolist()))  # noqa: B905
            counts.update((rare[i], rare[i + 1], None, None) for i in np.flatnonzero(after < 0).tolist())
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()
        at = np.flatnonzero(table)
        none = pa.nulls(len(at), pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, pa.array((at // classes).astype(np.int32)), pa.array((at % classes).astype(np.int32)), pa.array(table[at])], names)

    rows = texts.select("ids", "rare").mapInArrow(run, "token binary, other binary, l int, r int, n long")
    rows = stored(rows, "surroundings", "zstd")
    known = rows.where("token is null").select("l", "r", "n")
    mine = rows.where("token is not null and other is null").join(tail.select("token", F.col("class").alias("c")), "token")
    mine = mine.groupBy("l", "c", "r").agg(F.sum("n").alias("n"))
    two = F.array(F.struct("l", F.col("c").alias("r"), "n"), F.struct(F.col("c").alias("l"), "r", "n"))
    mine = mine.select(F.explode(two).alias("x")).select("x.*").where("l >= 0 and r >= 0")
    pairs = rows.where("other is not null").select("token", "other", "n")
    pairs = pairs.join(tail.select("token", F.col("class").alias("l")), "token").join(tail.select(F.col("token").alias("other"), F.col("class").alias("r")), "other")
    sums = np.zeros((classes, classes))
    for r in known.unionByName(mine).unionByName(pairs.select("l", "r", "n")).groupBy("l", "r").agg(F.sum("n").alias("n")).collect():
        sums[r.l, r.r] = r.n  # at most the square of the classes
    return sums


@dataclass
class Model:
    """held: words with counts, of: their classes; tail(token, n, class): all other words of the training texts.

    follow: log10 P(class | class before); spread: what log10 P(word | class) takes off log10(count + 1/2); other: the
    class of words that training hasn't seen.
    """

    held: dict[bytes, int]
    of: np.ndarray
    tail: DataFrame
    follow: np.ndarray
    spread: np.ndarray
    other: int
    total: int
    types: int


def fit(train: DataFrame, start: int = START, held: int = HELD, classes: int = CLASSES, rounds: int = ROUNDS, middle: int = MIDDLE) -> Model:
    """The model of all texts of train(text)."""
    counts = stored(token_counts(train), "token-counts")
    top = _words(counts, start, held, middle)
    return _fitted(counts, top, stored(coded(train, list(top)), "coded", "zstd"), start, classes, rounds, middle)


def _words(counts: DataFrame, start: int, held: int, middle: int) -> dict[bytes, int]:
    """The held words and their counts; the first `middle` are the same whatever `held` is."""
    middle = max(start, middle)
    top = frequent(counts, middle)
    return top | frequent(counts, held) if held > middle and len(top) == middle else top


def _fitted(counts: DataFrame, top: dict[bytes, int], texts: DataFrame, start: int, classes: int, rounds: int, middle: int) -> Model:
    """The model of coded texts, from all token counts and those of the held words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n = np.array(list(top.values()), float)
    start, middle = min(start, len(top)), min(max(start, middle), len(top))
    first = start_bigrams(texts, start)
    left, right = np.nonzero(first)
    of = np.full(len(top), -1)
    of[:start] = exchange(left, right, first[left, right].astype(float), start, classes, rounds)
    table = np.zeros((classes, classes))
    np.add.at(table, (of[left], of[right]), first[left, right])

    common = int(np.bincount(of[:start], minlength=classes).argmax())

    def place(begin: int, end: int, table: np.ndarray, now: np.ndarray | None = None) -> None:
        """Classes of the words from begin to end, at most HELD, from the classes known now."""
        rows = stored(_placed(held_contexts(texts, begin, end, of), "id", "int", table, common, now).select("id", "class"), "held-classes").toArrow()
        of[begin:end] = common
        of[rows.column("id").to_numpy()] = rows.column("class").to_numpy()

    if middle > start:
        place(start, middle, table)
        table = known_bigrams(texts, of, classes)
        place(start, middle, table, of.copy())
        table = known_bigrams(texts, of, classes)
    known = of.copy()
    if len(top) > middle:
        place(middle, len(top), table)
    tail = stored(_placed(rare_contexts(texts, known), "token", "binary", table, common), "tail-classes")
    table = class_bigrams(texts, of, tail, classes)
    alone = (table.sum(0) + 0.5) / (table.sum() + 0.5 * classes)
    # Interpolated with the classes alone, so that an odd sequence costs little more than its words do
    seen = (table + alone) / (table.sum(1, keepdims=True) + 1)
    emitted = np.stack([np.bincount(of, n, classes), np.bincount(of, minlength=classes)], 1)
    emitted[of[0]] -= [0, n[0] == 0]  # no text to learn from: no end token either
    for r in tail.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        emitted[r["class"]] += r.n, r.v
    # Each class has one more word, for all that training hasn't seen
    spread = np.log10(emitted[:, 0] + 0.5 * (emitted[:, 1] + 1))
    return Model(top, of, tail, np.log10((1 - ALONE) * seen + ALONE * alone), spread, int(emitted[:, 1].argmax()), int(total.n), int(total.v))


def scores(docs: DataFrame, folds: int = 5, held_out: int = 1, start: int = START, held: int = HELD, classes: int = CLASSES, rounds: int = ROUNDS, middle: int = MIDDLE) -> DataFrame:
    """log10 probability of every whole text of docs(doc_id, text), learned from those outside the held-out fold.

    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-half unigrams)
    and score (the class model).  Held out: crc32(doc_id as text) mod `folds` is `held_out`.  Null texts count as empty
    and are one end token.  One row per row, repeated rows too (they count as often); a null doc_id is in fold 0.
    An empty table gives no rows; without training rows all words are unknown.
    """
    texts = texts_of(docs)
    counts = stored(token_counts(texts.where(crc_mod("doc_id", folds) != held_out)), "token-counts")
    top = _words(counts, start, held, middle)
    numbers = stored(coded(texts, list(top), "doc_id"), "coded", "zstd")
    model = _fitted(counts, top, numbers.where(crc_mod("doc_id", folds) != held_out), start, classes, rounds, middle)
    out = _scored(numbers, model)
    bottom = math.log10(model.total + 0.5 * (model.types + 1))
    return out.select(
        "doc_id",
        (crc_mod("doc_id", folds) == held_out).alias("held_out"),
        "n_tokens",
        F.col("known").cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * bottom).alias("base_score"),
        (F.col("logs") + F.col("class_logs")).alias("score"),
    )


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, known, logs (sum of log10(count + 1/2)), class_logs of each of texts(doc_id, text)."""
    return _scored(stored(coded(texts, list(model.held), "doc_id"), "coded", "zstd"), model)


def _scored(numbers: DataFrame, model: Model) -> DataFrame:
    """scored() of coded texts(row, doc_id, ids, rare).

    Tokens that aren't held meet their counts and classes in joins on the token.  Those that training has often take no
    part in these, and what a text has of one is counted first, so no key is hot.
    """
    spark = numbers.sparkSession
    rows = stored(_parts(numbers, model), "scored")
    size = range(len(model.follow))
    step = F.broadcast(spark.createDataFrame([(i, j, float(model.follow[i, j])) for i in size for j in size], "l int, r int, step double"))
    off = F.broadcast(spark.createDataFrame([(i, float(model.spread[i])) for i in size], "class int, off double"))
    cls, zero = F.coalesce("class", F.lit(model.other)), F.lit(0.0)
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(model.tail, "token", "left").withColumn("class", cls)
    rare = rare.join(step.withColumnsRenamed({"r": "class", "step": "into"}), ["l", "class"], "left").join(step.withColumnsRenamed({"l": "class", "step": "out"}), ["class", "r"], "left").join(off, "class")
    rare = rare.select("row", (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * (F.coalesce("into", zero) + F.coalesce("out", zero) - F.col("off"))).alias("class_logs"))
    pairs = rows.select("row", F.explode("pairs").alias("x")).select("row", "x.*")
    pairs = pairs.join(model.tail.select("token", F.col("class").alias("l")), "token", "left").join(model.tail.select(F.col("token").alias("other"), F.col("class").alias("r")), "other", "left")
    pairs = pairs.withColumn("l", F.coalesce("l", F.lit(model.other))).withColumn("r", F.coalesce("r", F.lit(model.other))).join(step, ["l", "r"])
    pairs = pairs.select("row", zero.alias("logs"), F.lit(0).alias("known"), (F.col("times") * F.col("step")).alias("class_logs"))
    met = rare.unionByName(pairs).groupBy("row").agg(F.sum("logs").alias("more_logs"), F.sum("known").alias("more_known"), F.sum("class_logs").alias("more_class_logs"))
    out = rows.drop("rare", "pairs").join(met, "row", "left")
    return out.select("doc_id", "n_tokens", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("known", "logs", "class_logs")])


def _parts(numbers: DataFrame, model: Model) -> DataFrame:
    """Per row: what its held tokens add to the scores; its other tokens by the classes around them, and pairs of these,
    each with the times that the text has it."""
    shared = numbers.sparkSession.sparkContext.broadcast((np.array(list(model.held.values()), np.int64), model.of, model.follow, model.spread))
    times = ("times", pa.int64())
    rare_of = pa.struct([("token", pa.binary()), ("l", pa.int32()), ("r", pa.int32()), times])
    pair_of = pa.struct([("token", pa.binary()), ("other", pa.binary()), times])

    def lists(counts: Counter, texts: int, kind: pa.StructType) -> pa.ListArray:
        """Lists of structs by text, from counts of (text, *fields), texts ascending."""
        text, *columns = zip(*counts, strict=True) if counts else [()] * kind.num_fields
        flat = pa.StructArray.from_arrays([pa.array(c, k.type) for c, k in zip([*columns, list(counts.values())], kind, strict=True)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(np.array(text, np.int64), np.arange(texts + 1)), pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of, follow, spread = shared.value
        of = np.append(of, -1)
        seen, logs = np.append(n > 0, False), np.append(np.log10(n + 0.5), 0.0)
        follow, spread = np.pad(follow, (0, 1)), np.append(spread, 0.0)  # what isn't known adds nothing here
        for b in batches:
            ids, rare = _numbers(b.column("ids")), b.column("rare").flatten().to_pylist()
            begins = np.append(1, np.flatnonzero(ids[1:] == 0) + 2)  # of each text, and of what would follow the last
            cls, first = of[ids], begins[:-1]
            sums = [np.add.reduceat(x, first) for x in (seen[ids].astype(np.int64), logs[ids], follow[np.append(0, cls[:-1]), cls] - spread[cls])]
            at = np.flatnonzero(cls < 0)
            text = np.searchsorted(first, at, "right") - 1
            before, after = cls[at - 1], cls[at + 1]
            alone = Counter(zip(text.tolist(), rare, before.tolist(), after.tolist(), strict=True))
            two = np.flatnonzero(after < 0).tolist()
            pairs = Counter(zip(text[two].tolist(), [rare[i] for i in two], [rare[i + 1] for i in two], strict=True))
            found = [lists(alone, len(first), rare_of), lists(pairs, len(first), pair_of)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(np.diff(begins)), *map(pa.array, sums), *found], ["row", "doc_id", "n_tokens", "known", "logs", "class_logs", "rare", "pairs"])

    return numbers.select("row", "doc_id", "ids", "rare").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, logs double, class_logs double, rare array<struct<token:binary,l:int,r:int,times:long>>, pairs array<struct<token:binary,other:binary,times:long>>")
