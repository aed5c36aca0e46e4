"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Statistics of each whole text are standardised and mapped to cosines of random directions, whose inner products
approximate a Gaussian kernel.  Every partition of labelled rows sums its part of the normal equations; Spark adds the
parts up in two levels, and the driver solves one small system.  Raw scores of labelled rows that the fit hasn't seen
are counted in bins, and the calibration is the non-decreasing function of the raw score that fits these counts best.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import crc_mod, small_batches, stored, texts_of

FEATURES, WIDTH, RIDGE, SEED, BINS, CLIP = 128, 4.0, 1.0, 11, 400, 6.0
#: Bytes by kind; statistics are shares of these.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".,;:'\"-()", "!?", "|", "#$%&*+=<>@[]\\^_`{}~/")
KIND = np.full(256, len(KINDS), np.int64)
for _i, _chars in enumerate(KINDS):
    KIND[np.frombuffer(_chars.encode(), np.uint8)] = _i
STATS = len(KINDS) + 1 + 9


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; all 0 for an empty one."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return [0.0] * STATS
    count = np.bincount(data, minlength=256)
    kinds = np.bincount(KIND, count, len(KINDS) + 1) / len(data)
    some = count[count > 0] / len(data)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    return [
        *kinds.tolist(),
        float(np.log1p(len(data))),
        float(-(some * np.log2(some)).sum()),
        float(lengths.mean()),
        float(lengths.std()),
        distinct / n,
        float(np.log1p(distinct) / np.log1p(n)),
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(str.isalpha, words)) / n,
        len(set(lines)) / len(lines),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of double) of each row of docs(doc_id, text); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    small_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    raw: np.ndarray  # calibration: raw scores, ascending, and the score at each
    score: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return fourier(self.standard(stats)) @ self.weight

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(stats), self.raw, self.score), 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant: inner products approximate exp(-|a-b|^2 / 2 WIDTH^2)."""
    r = np.random.default_rng(SEED)
    direction = r.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
    phase = r.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ direction + phase), np.ones((len(x), 1))])


def isotonic(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The non-decreasing means that are closest to y / n by weight n: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for k, total in zip(n, y, strict=True):
        blocks.append([float(k), float(total), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            k, t, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k, blocks[-1][1] + t, blocks[-1][2] + m]
    return np.concatenate([np.full(int(m), t / k) for k, t, m in blocks]) if blocks else np.zeros(0)


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return np.array(b.column("stats").to_pylist(), float).reshape(-1, STATS)


def fit(rows: DataFrame) -> Model | None:
    """Fit on rows (stats, y, spare): `spare` rows calibrate, the others are regressed on.  None without rows.

    The driver gets a mean per statistic, one row per feature and one per bin, whatever the number of rows.
    """
    stats = F.posexplode("stats").alias("i", "v")
    moments = {r.i: r for r in rows.where("not spare").select(stats).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    if not moments:
        return None
    mean = np.array([moments[i].m for i in range(STATS)])
    scale = np.array([max(moments[i].s, 1e-9) for i in range(STATS)])
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = fourier(model.standard(_rows(b)))
            gram += z.T @ np.hstack([z, b.column("y").to_numpy()[:, None]])
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(range(len(gram)), pa.int32()), pa.array([int(part)] * len(gram), pa.int32()), pa.array(gram.tolist(), pa.list_(pa.float64()))], ["i", "part", "row"])

    def added(name: str) -> F.Column:
        return F.expr(f"aggregate(collect_list({name}), array_repeat(0D, {FEATURES + 2}), (a, x) -> zip_with(a, x, (p, q) -> p + q))").alias("row")

    parts = rows.where("not spare").select("stats", "y").mapInArrow(sums, "i int, part int, row array<double>")
    gram = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in parts.groupBy("i", "part").agg(added("row")).groupBy("i").agg(added("row")).collect():
        gram[r.i] = r.row
    model.weight = np.linalg.solve(gram[:, :-1] + RIDGE * np.eye(FEATURES + 1), gram[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip(((model.raw_scores(_rows(b)) + 0.5) / 2 * BINS).astype(np.int32), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("y")], ["bin", "y"])

    bins = rows.where("spare").select("stats", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    if bins:
        model.raw = np.array([(r.bin + 0.5) / BINS * 2 - 0.5 for r in bins])
        model.score = isotonic(np.array([r.n for r in bins], float), np.array([r.y for r in bins], float))
    else:  # too few labels to spare any
        model.raw, model.score = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """Score every row of docs(doc_id, text) as labels(doc_id, quality) mark it.

    Learns from labels of rows whose crc32(doc_id as text) mod `folds` is not `held`; of those, one in five calibrates.
    Returns doc_id, held_out, score, predicted.  One row per row, repeated rows too; null text counts as empty; null
    labels are no labels, several labels of one document count as their mean; without any label all scores are 0.5.
    """
    stats = stored(features(docs), "statistics")
    marks = labels.where("doc_id is not null and quality is not null").select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y"))
    marks = marks.groupBy("doc_id").agg(F.avg("y").alias("y")).where(crc_mod("doc_id", folds) != held)
    rows = stats.join(marks, "doc_id").select("stats", "y", (F.floor(crc_mod("doc_id", folds * 5) / folds) == 0).alias("spare"))
    model = fit(stored(rows, "labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(_rows(b)) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
