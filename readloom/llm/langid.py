"""Language identification by unigram pieces, summed over all segmentations.

A word is a run of letters, lower-cased, with the vocabulary's word mark before it.  In a language it has the
probability that the forward algorithm gives: the sum, over all ways to cut it into vocabulary pieces, of the product
of the pieces' probabilities.  These are learned for each language by expectation-maximisation, whose expected counts
run over the corpus's table of (word, language) counts.  A text scores the sum over its words, so equal words need the
sum over segmentations once; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import crc_mod, small_batches, stored, texts_of

MARK = "▁"
#: Longer words are summed in logarithms, as their probabilities may be too small for numbers.
LONGEST = 32
MOST_WORDS = 200_000
SLOTS = 18
#: Probability of a letter that no piece holds, and what is added to each expected count.
UNKNOWN, ADDED = 1e-7, 1e-3
BASE = np.uint64(0x9E3779B97F4A7C15)
letters_of = regex.compile(r"\p{L}+").findall
has_letter = regex.compile(r"\p{L}").search
words_of = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased, whole."""
    found = words_of(text.lower())
    if not all(map(str.isalpha, found)):  # numerals that aren't digits
        found = letters_of(text.lower())
    return found


class Pieces:
    """The vocabulary's pieces of letters, looked up for many words at once by a hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.names = sorted(p for p in found if p.replace(MARK, "", 1).isalpha() and MARK not in p[1:] and p == p.lower())
        self.most = max(map(len, self.names))
        self.seed = next(seed for seed in range(1000) if self._fill(seed))

    def _fill(self, seed: int) -> bool:
        """Put the pieces into two tables by different bits of their hash, those whose place in the first is taken into
        the second; False if that is taken too."""
        none, hashes = len(self.names), [self._hash(p, seed) for p in self.names]
        self.hashes = np.array([*hashes, 0], np.uint64)
        self.first, self.second = (np.full(1 << SLOTS, none, np.int32) for _ in range(2))
        for i, h in enumerate(hashes):
            table, slot = self.first, h >> 64 - SLOTS
            if table[slot] != none:
                table, slot = self.second, h >> 20 & (1 << SLOTS) - 1
            if table[slot] != none:
                return False
            table[slot] = i
        return True

    def __len__(self) -> int:
        return len(self.names)

    @staticmethod
    def _hash(piece: str, seed: int) -> int:
        h = seed
        for c in piece:
            h = (h ^ ord(c)) * int(BASE) & (1 << 64) - 1
            h ^= h >> 29
        return h

    def spans(self, codes: np.ndarray) -> list[np.ndarray]:
        """For words of one length as rows of characters: at [k - 1][:, i] the piece of k characters from i, or len(self)."""
        n, length = codes.shape
        out, none = [], len(self)
        with np.errstate(over="ignore"):
            h = np.full((n, length + 1), self.seed, np.uint64)
            for k in range(1, min(self.most, length) + 1):
                h = (h[:, :-1] ^ codes[:, k - 1 :]) * BASE  # from the hash of one character less
                h ^= h >> np.uint64(29)
                at = self.first[h >> np.uint64(64 - SLOTS)]
                lost = (at < none) & (self.hashes[at] != h)
                if lost.any():
                    other = h[lost]
                    again = self.second[other >> np.uint64(20) & np.uint64((1 << SLOTS) - 1)]
                    at[lost] = np.where(self.hashes[again] == other, again, none)
                out.append(at)
        return out


def by_length(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the list and characters (with the mark) of words of one length, some 20,000 words or fewer at a time."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    for length in np.unique(lengths):
        where = np.flatnonzero(lengths == length)
        for part in np.array_split(where, min(len(where), len(where) * max(1, int(length) // LONGEST) // 20_000 + 1)):
            data = "".join([found[i] for i in part.tolist()]).encode("utf-32-le")
            codes = np.frombuffer(data, "<u4").reshape(len(part), length).astype(np.uint64)
            yield part, np.hstack([np.full((len(part), 1), ord(MARK), np.uint64), codes])


def forward(spans: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """Probability of every prefix of every word in every language: [word, prefix length, language]."""
    n, length = spans[0].shape
    alpha = np.zeros((n, length + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, length + 1):
        for k in range(1, min(len(spans), j) + 1):
            p = prob[spans[k - 1][:, j - k]]
            if k == 1:
                p = np.maximum(p, UNKNOWN)
            alpha[:, j] += alpha[:, j - k] * p
    return alpha


def backward(spans: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    n, length = spans[0].shape
    beta = np.zeros((n, length + 1, prob.shape[1]))
    beta[:, length] = 1
    for j in range(length - 1, -1, -1):
        for k in range(1, min(len(spans), length - j) + 1):
            p = prob[spans[k - 1][:, j]]
            if k == 1:
                p = np.maximum(p, UNKNOWN)
            beta[:, j] += beta[:, j + k] * p
    return beta


def log_sums(spans: list[np.ndarray], prob: np.ndarray, back: bool = False) -> np.ndarray:
    """Logarithms of forward(), or of backward(), for words of any length."""
    n, length = spans[0].shape
    with np.errstate(divide="ignore"):
        logs = np.log(prob)
    out = np.zeros((n, length + 1, prob.shape[1]))
    for j in range(length - 1, -1, -1) if back else range(1, length + 1):
        parts = []
        for k in range(1, min(len(spans), length - j if back else j) + 1):
            p = logs[spans[k - 1][:, j if back else j - k]]
            parts.append(out[:, j + k if back else j - k] + (np.maximum(p, np.log(UNKNOWN)) if k == 1 else p))
        top = np.max(parts, 0)
        out[:, j] = top + np.log(np.exp(np.array(parts) - top).sum(0))
    return out


def log_prob(found: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """log probability of each word in each language, over all segmentations."""
    out = np.empty((len(found), prob.shape[1]))
    for where, codes in by_length(found):
        spans = pieces.spans(codes)
        out[where] = np.log(forward(spans, prob)[:, -1]) if codes.shape[1] <= LONGEST else log_sums(spans, prob)[:, -1]
    return out


def expected(found: list[str], counts: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected uses [piece, language] of the pieces in words that occur `counts` [word, language] times."""
    n_pieces, n_langs = len(pieces), prob.shape[1]
    out = np.zeros((n_pieces + 1) * n_langs)
    for where, codes in by_length(found):
        spans = pieces.spans(codes)
        if codes.shape[1] <= LONGEST:
            alpha, beta = forward(spans, prob), backward(spans, prob)
            weight = counts[where] / alpha[:, -1]
        else:
            alpha, beta, weight = log_sums(spans, prob), log_sums(spans, prob, back=True), counts[where]
        for k, ids in enumerate(spans, 1):
            for i in range(ids.shape[1]):
                have = ids[:, i] < n_pieces
                if have.any():
                    p = ids[have, i]
                    if codes.shape[1] <= LONGEST:
                        use = weight[have] * alpha[have, i] * prob[p] * beta[have, i + k]
                    else:
                        use = weight[have] * prob[p] * np.exp(alpha[have, i] + beta[have, i + k] - alpha[have, -1])
                    out += np.bincount((p[:, None] * n_langs + np.arange(n_langs)).ravel(), use.ravel(), len(out))
    return out.reshape(n_pieces + 1, n_langs)[:n_pieces]


_made: dict[str, Pieces] = {}


def pieces_at(path: str) -> Pieces:
    if path not in _made:
        _made[path] = Pieces(path)
    return _made[path]


FLUSH = 200_000


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all rows of docs(lang, text) with both; counted per task first, so common words move once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, counts.values())) > FLUSH:
                yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    rows = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str, rounds: int = 2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities [piece, language] and log priors from all rows of docs(text, lang).

    The driver gets one row per language, and per round one row per piece of the fixed vocabulary.
    """
    spark = docs.sparkSession
    parts = 3 * spark.sparkContext.defaultParallelism  # the rounds' work lies in the words, so they are spread by them
    table = stored(word_counts(docs).repartition(parts, "word", "lang"), "lang-words")
    langs = sorted(r.lang for r in table.select("lang").distinct().collect())
    pieces = pieces_at(path)
    size = np.array([len(p) for p in pieces.names])
    prob = np.vstack([np.repeat((0.2**size / (0.2**size).sum())[:, None], len(langs), 1), np.zeros((1, len(langs)))])
    place = {lang: i for i, lang in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        known = spark.sparkContext.broadcast(prob)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            pieces, prob = pieces_at(path), known.value
            total = np.zeros((len(pieces), len(place)))
            for b in batches:
                at = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
                found = b.column(1).to_pylist()
                counts = np.zeros((len(found), len(place)))
                counts[np.arange(len(found)), at] = b.column(2).to_numpy()
                total += expected(found, counts, pieces, prob)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20_000)
        sums = table.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        total = np.full((len(pieces), len(langs)), ADDED)
        for r in sums.toLocalIterator():
            total[r.piece, r.lang] += r.n
        prob = np.vstack([total / total.sum(0), np.zeros((1, len(langs)))])
        small_batches(spark)
    seen = {r.lang: r.n for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    prior = np.log(np.array([seen[x] for x in langs], float) + 1) if langs else np.zeros(0)
    return langs, prob, prior


def predict(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray, np.ndarray], names: tuple[str, str] = ("lang_pred", "score"), lettered: bool = False) -> DataFrame:
    """docs(text, ...) with two more columns, called by `names`: the likeliest language and its posterior probability.

    A text that is null or without a letter, and any text where no language was learned, gets `und` and score 0.  With
    `lettered`, rows whose text is null or without a letter are left out.
    """
    langs, prob, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((prob, prior - prior.max() if len(prior) else prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, (prob, prior) = pieces_at(path), shared.value
        place: dict[str, int] = {}
        table = np.empty((0, len(langs)))
        for b in batches:
            if lettered:
                b = b.filter(pa.array([has_letter(t or "") is not None for t in b.column("text").to_pylist()], pa.bool_()))
            texts = [words(t) if t and langs else [] for t in b.column("text").to_pylist()]
            new = list(set().union(*texts).difference(place)) if len(place) < MOST_WORDS else None
            if new is None:  # begin anew, so that memory stays bounded
                place, new = {}, list(set().union(*texts))
                table = table[:0]
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            table = np.vstack([table, log_prob(new, pieces, prob)])
            pred, score = [], []
            for found in texts:
                if not found:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = table[np.fromiter(map(place.__getitem__, found), np.int64, len(found))].sum(0) + prior
                best = int(total.argmax())
                pred.append(langs[best])
                score.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *names])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def identify(docs: DataFrame, path: str, rounds: int = 2, folds: int = 3, held: int = 1) -> DataFrame:
    """Predict the language of every row of docs(doc_id, text, lang).

    Learns from the rows whose crc32(doc_id as text) mod `folds` is not `held`.  Returns doc_id, held_out, lang_pred,
    score; one row per row, repeated rows too.  Null or empty texts and texts without letters get `und`; a null doc_id
    is in fold 0; an empty table gives no rows, as does one without languages give `und` throughout.
    """
    model = train(docs.where(crc_mod("doc_id", folds) != held), path, rounds)
    out = predict(texts_of(docs), path, model)
    return out.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
