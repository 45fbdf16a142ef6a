"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and a multiple of the
identity. A score comes from the difference of the two Mahalanobis log-densities; the inverse
Cholesky factors and log-determinants are computed once and travel with the scoring function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_columns, staged

TO_POOLED, TO_SPHERE = 0.15, 0.02
#: Divides the log-density difference: neighbouring statistics are correlated beyond the Gaussian model, so raw odds are too sure.
TEMPERATURE = 2.0
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 6))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?", b"#*$%&|<>", b"!")):
    _CLASSES[list(_chars), _i] = 1
_CLASSES[128:, 5] = 1
NAMES = ("log_words", "log_lines", "word_length", "word_spread", "upper", "digits", "stops", "symbols", "bangs", "beyond_ascii", "dup_lines", "distinct", "top_word", "words_a_line", "short")
D = len(NAMES)


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [0.0] * D
    upper, digits, stops, symbols, bangs, beyond = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES).tolist()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    return [
        np.log1p(n),
        np.log1p(len(lines)),
        np.log(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(20 * upper / size),
        np.log1p(20 * digits / size),
        np.log1p(20 * stops / size),
        np.log1p(20 * symbols / size),
        np.log1p(20 * bangs / size),
        np.log1p(5 * beyond / size),
        np.log1p(5 * (1 - len(set(lines)) / len(lines))),
        np.log(len(counts) / n) + 0.12 * np.log(n),
        np.log(max(counts.values()) / n) + 0.3 * np.log(n),
        np.log(n / len(lines)),
        float((lengths <= 3).mean()),
    ]


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = np.array([features(t.as_py()) for t in batch.column(1)])
    return pa.record_batch({"doc_id": batch.column(0), "x": pa.FixedSizeListArray.from_arrays(rows.ravel(), D).cast(pa.list_(pa.float64()))})


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, D)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of each class in a partition."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        if b.num_rows:
            x, y = _matrix(b.column(1)), np.asarray(b.column(0))
            for k in (0, 1):
                own = np.column_stack([np.ones((y == k).sum()), x[y == k]])
                total[k] = total.get(k, 0) + own.T @ own
    if total:
        yield pa.record_batch({"y": pa.array(list(total), pa.int32()), "s": pa.array([m.ravel().tolist() for m in total.values()])})


@dataclass
class Model:
    """Means and inverse Cholesky factors of standardised statistics, log-determinants and the log prior odds of class 1."""

    centre: np.ndarray
    scale: np.ndarray
    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log_density = [-0.5 * np.square((z - m) @ w.T).sum(1) - 0.5 * d for m, w, d in zip(self.mean, self.whiten, self.log_det, strict=True)]
        odds = np.clip((log_density[1] - log_density[0]) / TEMPERATURE + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-odds))


def model_from_sums(sums: dict[int, np.ndarray]) -> Model | None:
    """None if a class has no rows."""
    if len(sums) < 2 or any(m[0, 0] < 1 for m in sums.values()):
        return None
    n = [sums[k][0, 0] for k in (0, 1)]
    mean = [sums[k][0, 1:] / n[k] for k in (0, 1)]
    cov = [sums[k][1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    centre, scale = (n[0] * mean[0] + n[1] * mean[1]) / sum(n), np.sqrt(np.maximum(np.diag(pooled), 1e-4))
    unit = np.outer(scale, scale)
    whiten, log_det = [], []
    for c in cov:
        c = ((1 - TO_POOLED) * c + TO_POOLED * pooled) / unit
        c = (1 - TO_SPHERE) * c + TO_SPHERE * max(np.trace(c) / D, 1e-3) * np.eye(D)
        low = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(low).round(10))
        log_det.append(round(float(2 * np.log(np.diag(low)).sum()), 10))
    return Model(centre.round(10), scale.round(10), [((m - centre) / scale).round(10) for m in mean], whiten, log_det, float(np.log(n[1] / n[0])))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Fitted on all labelled rows (quality 0 or 1; other values and nulls are ignored) whose document
    is not held out; only sums by class reach the driver. Texts are read once. Null and empty texts
    are scored by their statistics, all zero. Without labels of both classes every score is 0.5.
    Repeated rows give a row each; a document labelled twice counts twice. Extra columns are ignored.
    """
    found = map_columns(docs.select(F.col("doc_id").cast("long"), "text"), _describe, "doc_id long, x array<double>")
    found = staged(found.withColumn("held_out", held_out(F.col("doc_id"))), "quality-stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)")
    rows = found.filter("not held_out").join(known, "doc_id").select("y", "x")
    part = rows.mapInArrow(_sums, "y int, s array<double>").select("y", F.posexplode("s").alias("i", "v"))
    sums: dict[int, np.ndarray] = {}
    for y, i, v in part.groupBy("y", "i").agg(F.sum("v")).collect():
        sums.setdefault(y, np.zeros((D + 1) ** 2))[i] = v
    model = model_from_sums({y: m.reshape(D + 1, D + 1) for y, m in sums.items()})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.full(batch.num_rows, 0.5) if model is None else model.score(_matrix(batch.column(1))).round(9)
        return pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(2), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    return map_columns(found.select("doc_id", "x", "held_out"), work, "doc_id long, held_out boolean, score double, predicted int")
