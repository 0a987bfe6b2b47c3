"""Regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of transformed statistics. The moments of both
classes (count, sum, sum of outer products) are added up over all labelled rows
in tasks and merged by a shuffle; the driver gets their sums, shrinks the class
covariances towards their diagonal and the pooled covariance, and caches their
Cholesky factors. A score is the logistic of the tempered difference of
the two log densities plus the log prior ratio.

Defined results: null and empty texts have the vector of a text without words and
get a score; repeated labels count repeatedly; a label null is not used; if either
class has fewer than two rows every score is the prior (0.5 without labels);
repeated documents each get a row; extra columns are ignored. Labels, lang,
source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules as qr
from . import textnum as tn
from .folders import shared_folder

FOLDS = 5
SHRINK_DIAGONAL = 0.1
SHRINK_POOLED = 0.05
TEMPERATURE = 4.0
CUT = 0.3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?;:()[]{}\"'=+/\\_~^@`")] = True
NAMES = ("words", "length", "symbols", "upper", "digits", "marks", "stops", "lines", "repeats", "dup_lines", "distinct", "longest", "letters", "short")
D = len(NAMES)


def statistics(buf: np.ndarray) -> list[float]:
    starts, ends = tn.spans(buf)
    n = len(starts)
    if not n:
        return [0.0] * D
    h = tn.word_hashes(buf, starts, ends)
    size = ends - starts
    chars = float(size.sum())
    counts = np.bincount(buf, minlength=256)
    share = lambda mask: float(counts[mask].sum()) / chars
    root = lambda x: float(np.sqrt(x))
    lines = counts[10] + 1
    return [
        float(np.log1p(n)), float(np.log(chars / n)), root(share(qr.SYMBOLS)), root(counts[65:91].sum() / chars), root(counts[48:58].sum() / chars), root(share(_MARK)),
        root((counts[46] + counts[44]) / n), float(np.log1p(n / lines)), qr.repeated_words(h) / n, qr.repeated_lines(buf) / float(lines),
        len(np.unique(h)) / n * float(np.log1p(n)), float(np.log(size.max())), share(_LETTER), float((size <= 2).mean()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array x of statistics, a row for each row of docs."""
    tn.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = [statistics(v) for v in tn.views(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id="doc_id"):
    return (F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0)


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each class: rows, sum, sum of outer products."""

    def run(batches):
        total = {}
        for b in batches:
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, D)
            y = b.column("quality").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                z = x[y == c]
                n, s, q = total.get(c, (0, np.zeros(D), np.zeros((D, D))))
                total[c] = (n + len(z), s + z.sum(0), q + z.T @ z)
        rows = [(c, i, v) for c, (n, s, q) in total.items() for i, v in enumerate([float(n), *s, *q.ravel()])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["c", "i", "v"])

    flat = labelled.select("x", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v"))
    out = {}
    values = np.zeros((2, 1 + D + D * D))
    for r in flat.collect():  # 2 * (1 + D + D * D) numbers
        values[r.c, r.i] = r.v
    for c in (0, 1):
        out[c] = (values[c, 0], values[c, 1 : 1 + D], values[c, 1 + D :].reshape(D, D))
    return out


class Discriminant:
    def __init__(self, m: dict[int, tuple[float, np.ndarray, np.ndarray]], diagonal: float = SHRINK_DIAGONAL, pooled: float = SHRINK_POOLED, temperature: float = TEMPERATURE):
        n = {c: m[c][0] for c in (0, 1)}
        self.prior = (n[1] + 1) / (n[0] + n[1] + 2)
        self.flat = min(n.values()) < 2
        self.temperature = temperature
        if self.flat:
            return
        mean = {c: m[c][1] / n[c] for c in (0, 1)}
        cov = {c: m[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
        both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.mean, self.root, self.log_det = mean, {}, {}
        for c in (0, 1):
            s = (1 - pooled) * cov[c] + pooled * both
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-4 * np.eye(D)
            low = np.linalg.cholesky(s)
            self.root[c] = np.linalg.inv(low)
            self.log_det[c] = 2 * float(np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        density = {c: -0.5 * (((x - self.mean[c]) @ self.root[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] for c in (0, 1)}
        z = (density[1] - density[0]) / self.temperature + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    return Discriminant(moments(stats.where(~held_out()).join(known, "doc_id")))


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each row of docs (doc_id, text)."""
    shared_folder(docs.sparkSession)
    stats = document_statistics(docs).checkpoint()  # a short row for each document, read for the fit and for the scores
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))  # a few small matrices

    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, D)
            s = model.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that score cut or more; the model is fitted on the labelled rows among docs."""
    stats = document_statistics(docs)  # joined to the labels as short rows, not as texts
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    def run(batches):
        for b in batches:
            x = np.array([statistics(v) for v in tn.views(b.column("text"))], dtype=float).reshape(-1, D)
            yield b.filter(pa.array(model.value.score(x) >= cut))

    return docs.mapInArrow(run, docs.schema)
