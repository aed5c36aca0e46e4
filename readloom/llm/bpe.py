"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A sequence of tokens is what BPE yields for its bytes exactly when every two neighbours are what BPE yields for the
bytes of the two.  Read left to right, a prefix of the input thus has one last token, and the token that ends a longer
prefix starts where a vocabulary entry is still open.  A state is the set of those open starts: for each, the tokens
from the last one emitted up to it, and the node of the vocabulary's trie that the bytes since then have reached.  A
byte moves every open start down the trie; what all remaining starts have in common is emitted.  Starts die once no
vocabulary entry goes on, so output lags the input by less than the longest entry.  States and moves are made when
first met, kept in tables of bounded size, and made again after a table was emptied.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from readloom.llm.common import small_batches, texts_of

MOST_STATES, MOST_PAIRS, MOST_WORDS = 150_000, 400_000, 400_000
#: Bytes up to which a piece may be held whole.
LONG = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(ranks: dict[bytes, int], data: bytes, below: int = 1 << 60) -> list[int]:
    """BPE by its definition, with merges of a rank under `below`: the leftmost pair of lowest rank until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes one piece of text (one match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.edges: dict[int, int] = {}
        self.ends = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.edges.get(key) or self.edges.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = rank
        self.pairs: dict[int, bool] = {}
        # The two parts that the last merge of each token joins; a token that its own bytes don't yield has none.
        self.parts: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
            elif len(ids := merge(ranks, token, rank)) == 2:
                self.parts[rank] = (ids[0], ids[1])
        self.joined = {left << 20 | right: rank for rank, (left, right) in self.parts.items() if left != rank}
        self.ends = [t if t in self.parts else -1 for t in self.ends]
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = [(((-1,), 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.linked: dict[int, list[tuple]] = {}
        self.unkept = 0

    def fit(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of the two tokens yields these two (left -1: right alone, if it yields itself).

        Merges are undone from the last on; the two fit if nothing across their border would have merged before what
        in fact was merged inside them.
        """
        if left < 0:
            return True
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fit(left, right)
        return known

    def _fit(self, left: int, right: int) -> bool:
        # A merge inside the left token comes first among equals, one inside the right token after one across.
        parts, limit = self.parts, 1 << 60
        while True:
            across = self.joined.get(left << 20 | right)
            if across is not None and across < limit:
                return False
            left_whole, right_whole = parts[left][0] == left, parts[right][0] == right
            if left_whole and right_whole:
                return True
            if right_whole or (not left_whole and left > right):
                limit, left = left, parts[left][1]
            else:
                limit, right = right + 1, parts[right][0]

    def _move(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        edges, ends, opened, done = self.edges, self.ends, [], None
        for path, node in state:
            node = edges.get(node << 8 | byte)
            if node is not None:
                if done is None and (t := ends[node]) >= 0 and self.fit(path[-1], t):
                    done = (*path, t)
                opened.append((path, node))
        opened.append((done, 0))
        first = opened[0][0]
        same = len(first)
        for path, _ in opened:
            if path[:same] != first[:same]:
                same = min(same, len(path))
                while path[:same] != first[:same]:
                    same -= 1
        if same == 1:
            return tuple(opened), ()
        return tuple([(p[same - 1 :], n) for p, n in opened]), first[1:same]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of a stream of bytes, each given out as soon as no later byte can change it."""
        state, at = self.states[0], 0
        for byte in data:
            move = self.moves.get(at << 8 | byte) if at >= 0 else None
            if move is not None:
                at, out = move
                state = self.states[at]
            else:
                before = at
                state, out = self._move(state, byte)
                at = self.number.get(state, -1)
                if at < 0 and len(self.states) < MOST_STATES:
                    at = self.number[state] = len(self.states)
                    self.states.append(state)
                if at >= 0 and before >= 0:
                    self.moves[before << 8 | byte] = at, out
                elif at < 0:
                    self.unkept += 1
            if out:
                yield from out
        yield from state[-1][0][1:]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece.  A piece that is itself in the vocabulary is that token, reachable by merges or not.

        Once the table of states is full, a short piece that leaves it is finished by moving its open starts alone,
        without naming further states that hardly any other piece would meet.
        """
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        if len(data) > LONG or len(self.states) < MOST_STATES:
            return list(self.stream(data))
        at, out, get = 0, [], self.moves.get
        for i, byte in enumerate(data):
            move = get(at << 8 | byte)
            if move is None:
                return out + self._finish(at, data[i:])
            at = move[0]
            if move[1]:
                out += move[1]
        return out + list(self.states[at][-1][0][1:])

    def _finish(self, at: int, data: bytes) -> list[int]:
        opened = self.linked.get(at)
        if opened is None:  # the open starts again, with their tokens as links that later ones can hang on to
            links: dict[tuple, tuple] = {(): None}
            for path, _ in self.states[at]:
                for k, token in enumerate(path):
                    links.setdefault(path[: k + 1], (links[path[:k]], token))
            opened = self.linked[at] = [(links[path], node) for path, node in self.states[at]]
        edges, ends, pairs = self.edges, self.ends, self.pairs
        for byte in data:
            after, done = [], None
            for link, node in opened:
                node = edges.get(node << 8 | byte)
                if node is not None:
                    if done is None and (t := ends[node]) >= 0:
                        left = link[1]
                        if left < 0 or (fit := pairs.get(left << 20 | t)) or (fit is None and self.fit(left, t)):
                            done = (link, t)
                    after.append((link, node))
            after.append((done, 0))
            opened = after
        self.unkept += len(data)
        if self.unkept > 100 * MOST_STATES:  # the text has changed: other states are worth keeping
            self._forget()
        link, out = opened[-1][0], []
        while link[0] is not None:
            out.append(link[1])
            link = link[0]
        return out[::-1]


class Encoder:
    """Splits whole texts and encodes each piece; ids come packed as little-endian unsigned 32-bit integers.

    A text is first cut into runs without white space, each with one space that may stand before it, and the white
    space left between them.  The pattern's matches never cross these cuts, so what was worked out for a run is kept.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        white = "".join(c for c in map(chr, range(0x3100)) if regex.fullmatch(r"\s", c))
        self.runs = re.compile(rf" ?[^{white}]+|[{white}]+(?![^{white}])|[{white}]").findall
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        runs, known = self.runs(text), self.known
        out = list(map(known.get, runs))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    run = runs[i]
                    ids = out[i] = known.get(run) or self.older.get(run) or self._ids(run)
                    if len(run) < LONG:
                        known[run] = ids
            if len(known) > MOST_WORDS:  # runs not met since stay findable for one more round
                self.older, self.known = known, {}
        return b"".join(out)

    def _ids(self, run: str) -> bytes:
        pieces, ids = [run] if run.isalpha() or run[1:].isalpha() and run[0] == " " else self.split(run), []
        if len(pieces) > 1:
            return b"".join(self.known.get(p) or self.older.get(p) or self._ids(p) for p in pieces)
        for piece in pieces:
            ids += self.transducer.piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)


def _utf8_states() -> list[list[int]]:
    """The machine of well-formed UTF-8: next state by state and byte.  0: between characters, 8: ill-formed."""
    table = [[8] * 256 for _ in range(9)]
    for low, high, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        table[0][low : high + 1] = [to] * (high - low + 1)
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state][low : high + 1] = [to] * (high - low + 1)
    return table


UTF8 = _utf8_states()


class StreamDecoder:
    """Turns ids into text as they come.  Bytes of an unfinished character wait for the next ids; bytes that can't be
    part of well-formed UTF-8 become U+FFFD, as Python's "replace" does."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.held = tokens, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        keep = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:  # the last character begins here: run the machine over it
                state = 0
                for byte in data[-back:]:
                    state = UTF8[state][byte]
                if 0 < state < 8:
                    keep -= back
                break
        self.held = data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def end(self) -> str:
        last, self.held = self.held.decode("utf-8", "replace"), b""
        return last


_made: dict[tuple, tuple[Encoder, list[bytes]]] = {}


def codec(path: str, pattern: str) -> tuple[Encoder, list[bytes]]:
    """Encoder and vocabulary for a rank file, made once in each Python worker."""
    if (path, pattern) not in _made:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _made[path, pattern] = Encoder(ranks, pattern), tokens
    return _made[path, pattern]


STEP = 8192


def decoded(tokens: list[bytes], ids: list[int]) -> Iterator[str]:
    decoder = StreamDecoder(tokens)
    for at in range(0, len(ids), STEP):
        yield decoder.feed(ids[at : at + STEP])
    yield decoder.end()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text.  Null text: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = codec(path, pattern)
        for b in batches:
            ids = [np.frombuffer(encoder.packed(t), "<u4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids): the inverse of encode.  Null ids: empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = codec(path, pattern)
        for b in batches:
            text = ["".join(decoded(tokens, ids or [])) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(encoded["doc_id"].cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every whole text of docs(doc_id, text).

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of
    the bytes of the text that the streaming decoder gives for the ids).  One row per row: null text counts as empty,
    an empty text has no tokens, repeated rows give repeated rows, an empty table gives none.  A text of any length
    is encoded whole; it has no shuffle, so an uneven key can't gather rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = codec(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                packed = encoder.packed(text)
                digest = hashlib.sha256()
                for part in decoded(tokens, np.frombuffer(packed, "<u4").tolist()):
                    digest.update(part.encode())
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
