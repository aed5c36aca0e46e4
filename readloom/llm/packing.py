"""Best-fit packing of documents into token sequences by bin completion.

What decides a packing is how many pieces there are of each length, so the corpus is reduced, by Spark, to at most
`capacity` counts, whatever its size.  One plan fills a sequence around the largest piece left so that it wastes
least, and uses that filling as often as its counts allow; another is best-fit decreasing.  Both depend on the number of
lengths, not of documents.  While the better one has more sequences than the lower bound, bin completion searches over (filling, times) on the
counts: around the largest piece, undominated fillings in the order of their waste, pruned by the waste that the
sequences to beat leave.  Spark then numbers the pieces of each length and each looks up the sequence that has its number.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import small_batches, stored, texts_of

CAPACITY = 4096
#: Partial fillings looked at for one sequence, and branches of the search for the last sequences.
FILLINGS, BRANCHES = 400, 20_000
#: Steps of the search over whole plans for one number of sequences; beyond, it is open whether such a plan exists.
STEPS = 60_000
#: Words whose ids a worker keeps, and ids beyond which it drops all but those in use.
MOST_WORDS, MOST_IDS = 240_000, 4_000_000
#: Characters of texts that are encoded together; a longer text is alone.
TOGETHER = 2_000_000


def _usual() -> str:
    """A pattern of characters that Python and the library surely class alike: those of Unicode 3.2's first plane."""
    old, out, first = unicodedata.ucd_3_2_0.category, [], None
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        same = kind[0] == old(chr(c))[0] and kind not in ("Cn", "Cs", "Co")
        if same and first is None:
            first = c
        elif not same and first is not None:
            out.append(f"\\u{first:04x}-\\u{c - 1:04x}")
            first = None
    return "[" + "".join(out) + "]*"


class WordEncoder:
    """ids of whole texts by a word-end BPE file of the tokenizers library.

    Texts are taken many together: Arrow parts them into words by the file's splitting pattern and finds the distinct ones.
    The ids of words are kept, since the merges never cross them.  New ones are encoded by the library, many at once,
    without its normaliser and splitting pattern, which they have behind them.  Texts with characters that Python and the
    library may class differently go through the library whole.
    """

    #: Fixed by the file: its splitting pattern is this or a run of letters.
    BETWEEN = r"'(?:[stmd]|re|ve|ll)|\p{N}|[^\s\x0b\x{85}\p{Z}\p{L}\p{N}]+"
    SPACE = r"[\s\x0b\x{85}\p{Z}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work, a task has one core
        self.path, self.merges = path, Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.usual = re.compile(_usual()).fullmatch
        #: Tokens that the library finds in a text before all else
        special = {t.content: i for i, t in self.merges.get_added_tokens_decoder().items()}
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in special.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda text: [text]
        vocabulary = self.merges.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # The library writes each byte as a printing character: itself where it is one, else the next from 256 on.
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printing]
        self.shown = "".join(chr(b if b in printing or b == 32 else 256 + rest.index(b)) for b in range(256))
        #: The row of each kept word; row r has ids[at[r]:at[r + 1]].  The empty word has none.
        self.known = {"": 0}
        self.ids, self.at = np.empty(0, "<u4"), np.zeros(2, np.int64)

    @cached_property
    def library(self):
        """The library as it is, for the few texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words, each one piece, and how many each has: they are encoded together and parted where a token ends a word."""
        ids, sizes = [], []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            line = " ".join(some)
            if not line.isascii() or not line.isprintable():
                line = codecs.charmap_decode(line.encode(), "strict", self.shown)[0]
            got = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            size = np.diff(np.flatnonzero(self.last[got]) + 1, prepend=0)
            if len(size) != len(some):
                each = [e.ids for e in self.library.encode_batch(some, add_special_tokens=False)]
                got, size = np.array([i for e in each for i in e], "<u4"), np.array([len(e) for e in each])
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the rows one after the other, and where each row's begin and the last's end."""
        first = self.at[rows]
        size = self.at[rows + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)], ends

    def _rows(self, words: list[str]) -> np.ndarray:
        """The row of each of the distinct words; new ones get rows, and long ones are found there this once only."""
        rows = np.array([self.known.get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            if len(self.known) + len(missing) > MOST_WORDS or len(self.ids) > MOST_IDS:  # only words met here stay
                kept = np.unique(np.append(rows[rows >= 0], 0))
                self.ids, self.at = self._ids_of(kept)
                rows[rows >= 0] = np.searchsorted(kept, rows[rows >= 0])
                self.known = {"": 0} | {words[i]: int(rows[i]) for i in np.flatnonzero(rows >= 0)}
            new = [words[i] for i in missing]
            ids, size = self._each(new)
            first = len(self.at) - 1
            rows[missing] = np.arange(first, first + len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
            self.known |= {w: first + i for i, w in enumerate(new) if len(w) < 64}
        return rows

    def _plain(self, texts: list[str]) -> list[bytes]:
        """ids of texts without special tokens."""
        out: list[bytes] = []
        usual = [i for i, text in enumerate(texts) if text.isascii() or self.usual(text)]
        # The library lower-cases each character alone.
        lower = [(text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower() for text in map(texts.__getitem__, usual)]
        apart = pc.replace_substring_regex(pa.array(lower, pa.large_string()), self.BETWEEN, r" \0 ")
        # Arrow's own white space has four control characters that the library's hasn't.
        odd = any(c in text for text in lower for c in "\x1c\x1d\x1e\x1f")
        words = pc.split_pattern_regex(apart, self.SPACE) if odd else pc.utf8_split_whitespace(apart)
        coded = words.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, ends = self._ids_of(rows[coded.indices.to_numpy()])
        ends = ends[words.offsets.to_numpy()]
        have = {i: ids[a:b].tobytes() for i, a, b in zip(usual, ends, ends[1:], strict=False)}
        for i, text in enumerate(texts):
            out.append(have[i] if i in have else np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        return out

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        parts, ends = [], [0]
        for text in texts:
            parts += self.parts(text) if "<|" in text else [text]
            ends.append(len(parts))
        found = list(map(self.special.get, parts))
        plain = iter(self._plain([part for part, ids in zip(parts, found, strict=True) if ids is None]))
        found = [next(plain) if ids is None else ids for ids in found]
        return (b"".join(found[a:b]) for a, b in zip(ends, ends[1:], strict=False))

    def packed_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        some: list[str] = []
        size = 0
        for text in texts:
            if some and size + len(text) > TOGETHER:
                yield from self._group(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            yield from self._group(some)

    def packed(self, text: str) -> bytes:
        return next(self.packed_all([text]))


_made: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _made:
        _made[path] = WordEncoder(path)
    return _made[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and end_id, cut every `capacity` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, data in zip(b.column(0).to_pylist(), enc.packed_all(b.column(1).to_pylist()), strict=True):
                data += end
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    ids.append(doc_id)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_fit(count: np.ndarray, room: int) -> tuple[int, ...]:
    """The largest piece that fits, again and again."""
    out: list[int] = []
    left: dict[int, int] = {}
    while room > 0:
        have = np.flatnonzero(count[1 : room + 1])
        size = next((int(s) + 1 for s in have[::-1] if count[s + 1] > left.get(int(s) + 1, 0)), 0)
        if not size:
            break
        times = min(int(count[size]) - left.get(size, 0), room // size)
        out += [size] * times
        left[size] = left.get(size, 0) + times
        room -= size * times
    return tuple(out)


def _completion(count: np.ndarray, room: int) -> tuple[int, ...]:
    """The filling of `room` that wastes least; of equals, the one of fewest and largest pieces.

    A single piece that fills the room dominates all other fillings, so it is taken at sight.  Fillings of two pieces
    are all looked at together.  Beyond, pieces are placed from the largest on and the rest is filled by one or two,
    until nothing is wasted or FILLINGS are seen.
    """
    if room <= 0:
        return ()
    if count[room]:
        return (room,)
    best = _best_fit(count, room)
    waste = room - sum(best)
    if waste == 0 and len(best) <= 2:
        return best
    seen = 0

    def pair(count: np.ndarray, room: int) -> tuple[int, ...]:
        have = count[: room + 1] > 0
        if have[room]:
            return (room,)
        # largest[x]: the largest length up to x that is there
        largest = np.maximum.accumulate(np.where(have, np.arange(room + 1), 0))
        a = np.flatnonzero(have)
        if not len(a):
            return ()
        b = largest[room - a]
        same = (a == b) & (count[a] < 2)
        b = np.where(same, largest[np.maximum(a - 1, 0)], b)
        k = len(a) - 1 - int(np.argmax((a + b)[::-1]))
        return tuple(x for x in (int(a[k]), int(b[k])) if x)

    def search(count: np.ndarray, room: int, top: int, taken: tuple[int, ...]) -> bool:
        """True once nothing is wasted."""
        nonlocal best, waste, seen
        seen += 1
        last = pair(count, room)
        if room - sum(last) < waste:
            best, waste = taken + last, room - sum(last)
        if waste == 0:
            return True
        for size in np.flatnonzero(count[1 : min(top, room) + 1])[::-1] + 1:
            if seen >= FILLINGS:
                return False
            count[size] -= 1
            done = search(count, room - int(size), int(size), (*taken, int(size)))
            count[size] += 1
            if done:
                return True
        return False

    if waste:
        search(count, room, room, ())
    return tuple(sorted(best, reverse=True))


def least_sequences(count: np.ndarray, capacity: int) -> int:
    """A bound from below: by total tokens, and by pieces that can't share a sequence whatever else (Martello and Toth)."""
    sizes = np.arange(len(count))
    bound = -(-int((count * sizes).sum()) // capacity)
    over = np.cumsum(count[::-1])[::-1]
    for k in range(1, capacity // 2 + 1):
        alone = int(over[capacity - k + 1]) if capacity - k + 1 < len(over) else 0
        half = int(over[capacity // 2 + 1] - alone) if capacity // 2 + 1 < len(over) else 0
        mid = np.arange(capacity // 2 + 1, min(capacity - k, len(count) - 1) + 1)
        free = half * capacity - int((count[mid] * mid).sum())
        small = np.arange(k, min(capacity // 2, len(count) - 1) + 1)
        need = int((count[small] * small).sum()) - free
        bound = max(bound, alone + half + max(0, -(-need // capacity)))
    return bound


def _few(sizes: list[int], capacity: int, goal: int) -> list[tuple[int, ...]] | None:
    """Branch and bound over whole packings of few pieces: at most `goal` sequences, or None if not found in time."""
    branches = 0

    def fillings(rest: list[int], room: int) -> list[tuple[int, ...]]:
        out: set[tuple[int, ...]] = set()

        def grow(i: int, room: int, taken: tuple[int, ...]) -> None:
            if len(out) >= 200:
                return
            fits = False
            last = None
            for j in range(i, len(rest)):
                if rest[j] <= room and rest[j] != last:
                    fits, last = True, rest[j]
                    grow(j + 1, room - rest[j], (*taken, rest[j]))
            if not fits:
                out.add(taken)

        grow(0, room, ())
        found = sorted(out, key=lambda f: (-sum(f), len(f)))
        return [f for k, f in enumerate(found) if not any(_dominates(g, f) for g in found[:k])]

    def solve(rest: list[int], left: int) -> list[tuple[int, ...]] | None:
        nonlocal branches
        if not rest:
            return []
        branches += 1
        if branches > BRANCHES or sum(rest) > left * capacity:
            return None
        for f in fillings(rest[1:], capacity - rest[0]):
            after = rest[1:]
            for s in f:
                after.remove(s)
            if (tail := solve(after, left - 1)) is not None:
                return [(rest[0], *f), *tail]
        return None

    return solve(sorted(sizes, reverse=True), goal)


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether every piece of b finds a piece of a of its own that is as large: then a may replace b in any packing."""
    return len(a) >= len(b) and all(x >= y for x, y in zip(sorted(a, reverse=True), sorted(b, reverse=True)))


class _Search:
    """Plans of at most `goal` sequences for count[length] pieces, by bin completion over (filling, times).

    All sequences of the largest length left are decided first, in the order of their fillings' waste.  A filling to
    which a piece left can be added, or in which one can be replaced by a larger one left, is dominated: exchanging the
    pieces makes no plan worse.  A branch ends where more is wasted than `goal` sequences have room for.  The k-th choice
    counts as k - 1 discrepancies; plans with few of them are searched first.
    """

    def __init__(self, count: np.ndarray, capacity: int, most_steps: int = STEPS):
        self.most_steps = most_steps
        self.count, self.capacity = [int(n) for n in count], capacity
        self.lengths = [s for s in range(len(count) - 1, 0, -1) if count[s]]
        self.tokens = sum(s * self.count[s] for s in self.lengths)
        # below[i]: bits of the sums that lengths[i:] can make, however many there are
        mask, sums = (1 << capacity + 1) - 1, 1
        self.below = [1]
        for s in reversed(self.lengths):
            by = s
            while by <= capacity:
                sums |= sums << by & mask
                by *= 2
            self.below.append(sums)
        self.below.reverse()
        self.steps = 0

    def _exact(self, room: int, i: int) -> Iterator[tuple[int, ...]]:
        """Ways to fill `room` wholly with pieces of lengths[i:], the largest first."""
        taken: list[int] = []
        todo = [i]
        while todo and self.steps < self.most_steps:
            self.steps += 1
            if not room:
                yield tuple(self.lengths[k] for k in taken)
            k = todo[-1] if room else len(self.lengths)
            while k < len(self.lengths) and (self.lengths[k] > room or self.count[self.lengths[k]] <= taken.count(k)):
                k += 1
            if k < len(self.lengths) and self.below[k] >> room & 1:
                todo[-1] = k + 1
                taken.append(k)
                todo.append(k)
                room -= self.lengths[k]
            else:
                todo.pop()
                if taken:
                    room += self.lengths[taken.pop()]

    def _dominated(self, filling: tuple[int, ...], waste: int) -> bool:
        if not waste:
            return False
        self.steps += len(self.lengths) // 10
        free = [s for s in self.lengths if self.count[s] > filling.count(s)]
        return any(s <= waste for s in free) or any(x < s <= x + waste for x in set(filling) for s in free)

    def _choices(self, top: int, spare: int, after: tuple) -> Iterator[tuple[tuple[int, ...], int, tuple]]:
        """(filling, times, key) around lengths[top]: each filling as often as can be, then also fewer times."""
        size, fewer = self.lengths[top], []
        room = self.capacity - size
        self.count[size] -= 1
        listed = []
        for waste in range(min(spare, room) + 1):
            if not self.below[top] >> room - waste & 1:
                continue
            for rest in self._exact(room - waste, top):
                key = (waste, tuple(-x for x in rest))
                if key >= after and not self._dominated(rest, waste):
                    self.count[size] += 1
                    filling = (size, *rest)
                    most = min(self.count[s] // filling.count(s) for s in set(filling))
                    if waste:
                        most = min(most, spare // waste)
                    if most:
                        yield filling, most, key
                    listed.append((filling, key))
                    fewer.append(self._fewer(most))
                    for (f, k), times in zip(listed, fewer, strict=True):
                        if (t := next(times, 0)):
                            yield f, t, k
                    self.count[size] -= 1
        self.count[size] += 1
        while fewer:
            left = [(f, k, times, t) for (f, k), times in zip(listed, fewer, strict=True) if (t := next(times, 0))]
            for f, k, _, t in left:
                yield f, t, k
            listed, fewer = [(f, k) for f, k, _, _ in left], [times for _, _, times, _ in left]

    @staticmethod
    def _fewer(most: int) -> Iterator[int]:
        """1 to most - 1, the middle first, then the middles of the halves."""
        spans = [(1, most - 1)]
        for low, high in spans:
            if low <= high:
                yield (middle := (low + high) // 2)
                spans += [(low, middle - 1), (middle + 1, high)]

    def plan(self, goal: int) -> list[tuple[tuple[int, ...], int]] | None:
        spare = goal * self.capacity - self.tokens
        if spare < 0:
            return None
        self.steps = 0
        most = 0
        while self.steps < self.most_steps:
            found, cut = self._within(spare, most)
            if found is not None or not cut:
                return found
            most = most + 1 if most < 4 else most * 2
        return None

    def _within(self, spare: int, most: int) -> tuple[list[tuple[tuple[int, ...], int]] | None, bool]:
        """A plan with at most that many discrepancies; whether any choice was left out for them."""
        plan: list[tuple[tuple[int, ...], int, int]] = []
        given, levels, cut, used, top, after = list(self.count), [], False, 0, 0, ()
        while True:
            while top < len(self.lengths) and not self.count[self.lengths[top]]:
                top, after = top + 1, ()
            if top == len(self.lengths):
                for choices, *_ in levels:
                    choices.close()
                self.count = given
                return [(f, t) for f, t, _ in plan], cut
            levels.append([self._choices(top, spare, after), top, used, 0])
            while levels:
                choices, top, used, tried = levels[-1]
                if len(plan) == len(levels):  # the choice made here has failed
                    filling, times, waste = plan.pop()
                    spare += waste
                    for s in filling:
                        self.count[s] += times
                self.steps += 1
                if self.steps >= self.most_steps:
                    chosen = None
                elif used + tried > most:
                    chosen, cut = None, True
                else:
                    chosen = next(choices, None)
                if chosen is None:
                    choices.close()
                    levels.pop()
                    continue
                filling, times, after = chosen
                levels[-1][3] += 1
                used += tried
                waste = times * (self.capacity - sum(filling))
                spare -= waste
                for s in filling:
                    self.count[s] -= times
                plan.append((filling, times, waste))
                break
            else:
                self.count = given
                return None, cut


def _fewest(plan: list[tuple[tuple[int, ...], int]], count: np.ndarray, bound: int, capacity: int, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """The plan, or one of fewer sequences if the search finds any."""
    search, low = _Search(count, capacity, steps), bound
    goal = low
    while low < (total := sum(t for _, t in plan)):
        better = search.plan(goal)
        if better is not None:
            plan = better
        else:
            low = goal + 1
        goal = (low + min(total, sum(t for _, t in plan))) // 2
    return plan


def best_fit_decreasing(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan that puts each piece, the largest first, where it leaves least room.

    Sequences of one room are kept together, so the work depends on the number of lengths: of sequences with room for k
    pieces of a length, each takes k before the next is touched.
    """
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(filling: tuple[int, ...], room: int, times: int) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((filling, times))

    for size in np.flatnonzero(count[1:])[::-1] + 1:
        size, left = int(size), int(count[size])
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                put((), capacity, -(-left // (capacity // size)))
                continue
            room = rooms[at]
            filling, times = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
            k = room // size
            full = min(times, left // k)
            if full:
                put(filling + (size,) * k, room - size * k, full)
                left, times = left - full * k, times - full
            if times and left and left < k:
                put(filling + (size,) * left, room - size * left, 1)
                left, times = 0, times - 1
            if times:
                put(filling, room, times)
    return [x for some in open_at.values() for x in some if x[0]]


def pack_counts(count: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many sequences are filled so) for count[length] pieces of each length.

    The plan to beat is the better one of least-waste fillings and best-fit decreasing, so no plan is worse than the
    latter.  While it has more sequences than the lower bound, bin completion looks for fewer: all undominated fillings
    around the largest piece, pruned by waste, until `steps` are spent for a number of sequences.
    """
    given, bound = np.asarray(count, np.int64), least_sequences(np.asarray(count, np.int64), capacity)
    count, out = given.copy(), []
    top = len(count) - 1
    while True:
        while top > 0 and not count[top]:
            top -= 1
        if top == 0:
            break
        count[top] -= 1
        filling = (top, *_completion(count, capacity - top))
        count[top] += 1
        need = np.bincount(filling, minlength=len(count))
        used = np.flatnonzero(need)
        times = int((count[used] // need[used]).min())
        count[used] -= need[used] * times
        out.append((filling, times))
    if sum(t for _, t in out) > bound:
        out = min(out, best_fit_decreasing(given, capacity), key=lambda plan: sum(t for _, t in plan))
    total = sum(t for _, t in out)
    if total > bound:  # take the last, emptiest sequences apart and look for a packing of theirs that is one shorter
        for n in (8, 14, 20):
            flat = [f for f, t in out for _ in range(min(t, n))][-n:]
            better = _few([s for f in flat for s in f], capacity, len(flat) - 1)
            if better:
                keep = out.copy()
                for f in flat:
                    k = max(i for i, (g, t) in enumerate(keep) if g == f and t)
                    keep[k] = (keep[k][0], keep[k][1] - 1)
                out = [x for x in keep if x[1]] + [(f, 1) for f in better]
                break
        out = _fewest(out, given, bound, capacity, steps)
    return out


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: from which number of its pieces on, sequence and offset of the first such piece."""
    at: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for size in filling:
            at.setdefault(size, []).append((used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        sequence += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in at.items()}


def numbered(parts: DataFrame, total: int, each: int = 20_000) -> DataFrame:
    """parts with `number`, from 0 within each length.  A common length is split by a hash, so that no task gets it all."""
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(total // each + 1))
    parts = parts.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    inner = parts.withColumn("inner", F.row_number().over(order) - 1)
    return inner.join(first, ["length", "salt"]).withColumn("number", F.col("first") + F.col("inner")).drop("salt", "first", "inner")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pack docs(doc_id, text) into as few sequences of at most `capacity` tokens as found.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Only documents longer
    than a sequence are cut.  A null or empty text is the end token alone.  Repeated rows are packed as often as they
    come, a null doc_id like any other.  An empty table gives no rows.  The driver sees a count per length, no more.
    """
    parts = stored(pieces(docs, path, capacity, end_id), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # at most `capacity` rows
        count[length] = n
    places = parts.sparkSession.sparkContext.broadcast(_places(pack_counts(count, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                first, to, at = places.value[int(size)]
                mine = np.flatnonzero(length == size)
                k = np.searchsorted(first, number[mine], "right") - 1
                sequence[mine], offset[mine] = to[k] + number[mine] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = numbered(parts, int(count.sum()))
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
