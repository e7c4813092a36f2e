"""Text quality by regularised quadratic discriminant analysis of document statistics.

Every text becomes a vector of transformed statistics.  Each class has a mean and a covariance, shrunk towards the
pooled covariance and towards its own average variance.  The score is the difference of the Mahalanobis log densities,
taken with factors that are computed once, and calibrated to a probability on the training rows.  Sums and products
are merged in Spark, so training sees all labelled rows of the training folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, prefix_hash, ship_code, span_hash, text_chunks, valid_text, words_of

STATS = ("words", "chars_per_word", "chars_spread", "distinct", "repeat_next", "top_word", "upper", "digit", "symbol", "bang", "stop", "other_punct", "lines", "long_words")
DIM = len(STATS)
#: Weight of the pooled covariance, and of the average variance, in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.02
#: Variance that every statistic has at least: statistics that are constant in a class must not decide alone.
LEAST_VARIANCE = 0.05
#: Bins of the squashed log-density difference in which the calibration counts its rows.
BINS, REACH = 400, 10.0

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 symbol, 4 bang, 5 stop, 6 other punctuation
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _KIND[_c] = 6
_KIND[[ord(c) for c in "#*$%&|<>"]] = 3
_KIND[ord("!")] = 4
_KIND[[ord(c) for c in ".,;:?"]] = 5


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text; finite for any text, the empty one included."""
    n = len(offsets) - 1
    start, end, row = words_of(data, offsets)
    words = np.bincount(row, minlength=n).astype(float)
    # code points: bytes that do not continue a character
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    width = (lead[end] - lead[start]).astype(float)
    chars = np.bincount(row, width, n)
    squares = np.bincount(row, width * width, n)
    safe = np.maximum(words, 1)
    mean = chars / safe
    spread = np.sqrt(np.maximum(squares / safe - mean * mean, 0))
    h = span_hash(prefix_hash(data), start, end)
    same = np.bincount(row[1:], (h[1:] == h[:-1]) & (row[1:] == row[:-1]), n) if len(h) else np.zeros(n)
    distinct, top = np.zeros(n), np.zeros(n)
    first = np.searchsorted(row, np.arange(n + 1))
    for r in range(n):
        if first[r + 1] > first[r]:
            s = np.sort(h[first[r] : first[r + 1]])
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[r], top[r] = len(cut) - 1, np.diff(cut).max()
    kind = _KIND[data]
    at = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(at * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    lines = np.bincount(at, data == 10, n)
    long_words = np.bincount(row, width > 25, n)
    ratio = lambda x, per: np.log((x + 0.02) / (np.maximum(per, 1) + 0.02))
    share = lambda x, per: np.sqrt(x / np.maximum(per, 1))
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), share(distinct, words) * np.log1p(words) ** 0.5, 4 * share(same, words), share(top, words),
        4 * share(table[:, 1], chars), share(table[:, 2], chars), ratio(table[:, 3], words), ratio(table[:, 4], words), ratio(table[:, 5], words), ratio(table[:, 6], words),
        np.log1p(lines) - np.log1p(words), share(long_words, words),
    ])


@dataclass
class Model:
    """Means, factors (inverse Cholesky) and log determinants of class 0 and 1; then the calibration."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, count: np.ndarray, total: np.ndarray, product: np.ndarray) -> Model:
        mean = total / count[:, None]
        cov = product / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * count[:, None, None]).sum(0) / count.sum()
        factors, dets = [], []
        for c in cov:
            s = (1 - TO_POOLED) * c + TO_POOLED * pooled
            s = (1 - TO_DIAGONAL) * s + (TO_DIAGONAL * np.trace(s) / DIM + LEAST_VARIANCE) * np.eye(DIM)
            low = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(low))
            dets.append(2 * np.log(np.diag(low)).sum())
        return cls(mean, np.array(factors), np.array(dets), float(count[1] / count.sum()))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, plus the prior's log odds; squashed to within +-REACH or so."""
        far = [np.square((x - self.mean[k]) @ self.factor[k].T).sum(1) + self.log_det[k] for k in (0, 1)]
        d = 0.5 * (far[0] - far[1]) + np.log(self.prior / (1 - self.prior))
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def calibrate(at: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Platt's logistic fit to counts of either class at given margins, by Newton steps with a weak prior."""
    t1, t0 = (n1.sum() + 1) / (n1.sum() + 2), 1 / (n0.sum() + 2)
    w, y = n0 + n1, (n1 * t1 + n0 * t0) / np.maximum(n0 + n1, 1e-9)
    design = np.column_stack([at, np.ones_like(at)])
    beta = np.array([1.0, 0.0])
    prior = np.diag([1e-2, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        g = design.T @ (w * (p - y)) + prior @ (beta - np.array([1.0, 0.0]))
        hess = (design * (w * p * (1 - p) + 1e-9)[:, None]).T @ design + prior
        step = np.linalg.solve(hess, g)
        beta = beta - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cut, data, offsets in text_chunks(batches):
        x = statistics(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, DIM * len(x) + 1, DIM), pa.int32()), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([cut.column("doc_id"), lists], names=["doc_id", "x"])


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, DIM)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, place, value): the task's count, sums and products of either class."""
    acc = np.zeros((2, 1 + DIM + DIM * DIM))
    for batch in batches:
        x, y = _vectors(batch), batch.column("label").to_numpy()
        for k in (0, 1):
            m = x[y == k]
            acc[k] += np.concatenate([[len(m)], m.sum(0), (m.T @ m).reshape(-1)])
    k, place = np.nonzero(acc)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(acc[k, place])], names=["label", "place", "value"])


def train(features: DataFrame, labels: DataFrame) -> Model | None:
    """Fit to ``features`` (doc_id, x) joined with ``labels`` (doc_id, label 0/1); None if a class has no rows."""
    rows = features.join(labels, "doc_id").where("label IN (0, 1)").select(F.col("label").cast("int").alias("label"), "x")
    acc = np.zeros((2, 1 + DIM + DIM * DIM))
    for r in rows.mapInArrow(_sums, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():  # 2 * (1 + DIM + DIM^2) rows at most
        acc[r.label, r.place] = r.value
    if not acc[:, 0].all():
        return None
    model = Model.fit(acc[:, 0], acc[:, 1 : 1 + DIM], acc[:, 1 + DIM :].reshape(2, DIM, DIM))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.clip((model.margin(_vectors(b)) + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(m)], names=["label", "bin"])

    n = np.zeros((2, BINS))
    for r in rows.mapInArrow(margins, "label int, bin int").groupBy("label", "bin").count().collect():  # 2 * BINS rows at most
        n[r.label, r.bin] = r["count"]
    model.slope, model.shift = calibrate((np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH, n[0], n[1])
    return model


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text); learn from ``labels`` (doc_id, ``label_col`` 0/1) outside the held-out fold.

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.  Null text is empty and scored;
    rows without doc_id are scored, not held out and never learned from; labels other than 0 and 1, null ones and those
    of unknown documents are not used; repeated rows weigh and are scored each.  If a class has no labelled row, every
    score is 0.5.  Equal texts score alike; texts are read whole, however long; bytes that are no UTF-8 read as U+FFFD.
    Empty tables give no rows; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    features = materialize(base.mapInArrow(_measure, "doc_id long, x array<double>"), "statistics")
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(fold(F.col("doc_id"), folds) != held)
    model = train(features, learn)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_vectors(b)) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = features.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
