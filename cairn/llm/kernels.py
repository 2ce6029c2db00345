"""Quality scores: random Fourier features of document statistics, ridge regression from summed normal equations, isotonic calibration."""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty, written

#: Features of the kernel, seed of their directions, folds, ridge strengths tried, and steps of a raw score's histogram.
FEATURES, SEED, FOLDS, STRENGTHS, STEPS = 256, 12, 4, (1e-4, 1e-3, 1e-2, 1e-1, 1.0), 1000
THRESHOLD, HELD_OUT = 0.7, 2
#: Bytes of a text that are looked at together (more where a word or line is longer), words and lines of a window.
PIECE, WORDS, LINES = 1 << 20, 256, 32
STATISTICS = ("log_words", "word_bytes", "upper", "digits", "symbols", "exclaims", "stops", "not_ascii", "short_words", "again", "distinct", "line_words", "line_again", "entropy")
_SPACE, _NEWLINE = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"\n")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_LOWER, _UPPER, _DIGIT = _class(b"abcdefghijklmnopqrstuvwxyz"), _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"0123456789")
_BLANK, _SYMBOL, _EXCLAIM, _STOP = _class(b" \t\n\v\f\r"), _class(b"#*$%&|<>~^=_\\/{}[]"), _class(b"!?"), _class(b".,;:")
_HIGH = np.r_[np.zeros(128), np.ones(128)]


def _pieces(data: bytes, cut: re.Pattern):
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            found = cut.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def _windows(parts, size: int):
    held: list[bytes] = []
    for part in parts:
        held += part
        full = len(held) // size * size
        for at in range(0, full, size):
            yield held[at : at + size]
        held = held[full:]
    if held:
        yield held


def statistics(data: bytes) -> list[float]:
    """STATISTICS of a whole text in UTF-8; numbers that do not grow with it, but for log_words. An empty text has zeros.

    Distinct words are counted in windows of WORDS words, lines seen before in windows of LINES lines with a word."""
    histogram = np.zeros(256)
    words = short = again = distinct = lines = lines_again = 0
    last = None
    for window in _windows((p.split() for p in _pieces(data, _SPACE)), WORDS):
        words += len(window)
        again += (window[0] == last) + sum(map(operator.eq, window, window[1:]))
        distinct += len(set(window))
        short += sum(len(w) == 1 for w in window)
        last = window[-1]
    for piece in _pieces(data, _NEWLINE):
        histogram += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
    for window in _windows(([x for x in p.split(b"\n") if x.strip()] for p in _pieces(data, _NEWLINE)), LINES):
        lines += len(window)
        lines_again += len(window) - len(set(window))
    if not words:
        return [0.0] * len(STATISTICS)
    total, letters = histogram.sum() - histogram @ _BLANK, max(histogram @ (_LOWER + _UPPER), 1.0)
    share = histogram[histogram > 0] / histogram.sum()
    return [
        math.log1p(words), math.log(total / words), histogram @ _UPPER / letters, histogram @ _DIGIT / total, histogram @ _SYMBOL / total, histogram @ _EXCLAIM / total,
        histogram @ _STOP / total, histogram @ _HIGH / total, short / words, again / words, distinct / words, math.log(words / max(lines, 1)), lines_again / max(lines, 1), float(-(share * np.log2(share)).sum()),
    ]


def _measured(batches):
    for batch in batches:
        rows = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))], ["id", *STATISTICS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one column for each of STATISTICS) of each row."""
    small_batches(docs.sparkSession)
    bare = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return bare.mapInArrow(_measured, f"id long, {', '.join(f'{s} double' for s in STATISTICS)}")


def remainder(id_col: Column, of: int = 4) -> Column:
    """crc32 of an id as text, modulo a number; a null id is the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % of


@dataclass
class KernelRidge:
    """Standardised statistics -> cosines of random directions -> ridge weights -> calibrated score. All of bounded size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    fold_weights: list[np.ndarray]
    knots: tuple[list[float], list[float]] = ((0.0,), (0.5,))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel whose width is the square root of the number of statistics, and a constant."""
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((x.shape[1], FEATURES)) / math.sqrt(x.shape[1])
        phases = rng.uniform(0, 2 * math.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[math.sqrt(2 / FEATURES) * np.cos(z @ directions + phases), np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, *self.knots), 0, 1)


def _solve(gram: np.ndarray, moment: np.ndarray, rows: float, strength: float) -> np.ndarray:
    ridge = np.full(len(gram), strength * max(rows, 1.0) / len(gram))
    ridge[-1] = 1e-6  # the constant is free
    return np.linalg.solve(gram + np.diag(ridge), moment)


def isotonic(values: list[float], weights: list[float]) -> list[tuple[int, int, float]]:
    """Blocks (first, last, mean) of the non-decreasing sequence nearest to values in weighted squares: neighbours that fall are pooled."""
    blocks: list[list] = []
    for i, (v, w) in enumerate(zip(values, weights)):
        blocks.append([i, i, v, w])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            first, _, a, wa = blocks[-2]
            _, last, b, wb = blocks.pop()
            blocks[-1] = [first, last, (a * wa + b * wb) / (wa + wb), wa + wb]
    return [(a, b, v) for a, b, v, _ in blocks]


def fit(labelled: DataFrame) -> KernelRidge:
    """labelled(fold, y 0 or 1, STATISTICS) -> model. Every labelled row counts; each partition gives sums of fixed size, which are added
    in a tree. The ridge strength is that of least squared error over folds left out, which follows from the folds' sums; the isotonic
    steps are of scores from folds left out, in a histogram of fixed steps. No rows: every score is 0.5."""
    names = list(STATISTICS)
    row = labelled.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    mean = np.array([row[f"m_{c}"] or 0.0 for c in names])
    scale = np.array([row[f"s_{c}"] or 0.0 for c in names])
    blank = KernelRidge(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), [])
    size = FEATURES + 3  # features, constant, target, and a one that counts

    def summed(frames):
        total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
        for f in frames:
            a = np.c_[blank.features(f[names].to_numpy(np.float64)), f.y.to_numpy(np.float64)]
            for fold in range(FOLDS):
                mine = a[f.fold.to_numpy() == fold]
                total[fold] += mine.T @ mine
        yield pd.DataFrame({"sums": [total.tobytes()]})

    whole = lambda r: np.frombuffer(bytes(r.sums)).reshape(FOLDS, size - 1, size - 1)
    folds = labelled.mapInPandas(summed, "sums binary").rdd.map(whole).treeAggregate(np.zeros((FOLDS, size - 1, size - 1)), operator.add, operator.add)
    gram, moment, squares, rows = folds[:, :-1, :-1], folds[:, :-1, -1], folds[:, -1, -1], folds[:, -2, -2]
    if not rows.sum():
        return blank

    def left_out(strength: float) -> tuple[float, list[np.ndarray]]:
        error, kept = 0.0, []
        for k in range(FOLDS):
            w = _solve(gram.sum(axis=0) - gram[k], moment.sum(axis=0) - moment[k], rows.sum() - rows[k], strength)
            error += squares[k] - 2 * w @ moment[k] + w @ gram[k] @ w
            kept.append(w)
        return error, kept

    tried = [(*left_out(s), s) for s in STRENGTHS]
    _, fold_weights, strength = min(tried, key=lambda t: t[0])
    model = KernelRidge(blank.mean, blank.scale, _solve(gram.sum(axis=0), moment.sum(axis=0), rows.sum(), strength), fold_weights)

    def scored(frames):
        for f in frames:
            each = np.stack([model.features(f[names].to_numpy(np.float64)) @ w for w in fold_weights], axis=1) if len(f) else np.zeros((0, FOLDS))
            raw = np.clip(each[np.arange(len(f)), f.fold.to_numpy()], -1, 2)
            yield pd.DataFrame({"step": np.floor(raw * STEPS).astype(np.int32), "raw": raw, "y": f.y.to_numpy(np.float64)})

    steps = labelled.mapInPandas(scored, "step int, raw double, y double").groupBy("step").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("step").collect()
    n = [float(s.n) for s in steps]
    blocks = isotonic([s.y for s in steps], n)
    at = [sum(steps[i].raw * n[i] for i in range(a, b + 1)) / sum(n[a : b + 1]) for a, b, _ in blocks]
    model.knots = (at, [v for _, _, v in blocks])
    return model


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A row per row of docs: id, held_out, score (0 to 1, higher where label 1 is likelier) and predicted.

    Labels are rows (id, 0 or 1); others are left out, as are ids without a document and those whose crc32, as text, is HELD_OUT
    modulo 4. An id labelled twice counts twice. Inputs are STATISTICS of whole texts and nothing else; a null text is an empty one, and
    is scored like others. Rows with a null id are scored, never labelled nor held out. No usable label: every score is 0.5.
    """
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("y in (0, 1)").where(remainder(F.col("id")) != HELD_OUT)
    fold = F.floor(remainder(F.col("id"), 4 * FOLDS) / 4).cast("int").alias("fold")
    labelled = written(stats.join(marked, "id").select(fold, "y", *STATISTICS), "labelled")
    model, names = fit(labelled), list(STATISTICS)

    def run(frames):
        for f in frames:
            score = model.score(f[names].to_numpy(np.float64).reshape(-1, len(names)))
            yield pd.DataFrame({"id": f.id.astype("Int64"), "score": score})

    out = stats.mapInPandas(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), (remainder(F.col("id")) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
