"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes a short vector of transformed statistics (log lengths, logits
of shares).  Each class has a mean and a covariance shrunk towards the pooled one
and towards a multiple of the identity; their Cholesky factors are kept, and the
score is the calibrated difference of the two log-densities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_batches

FEATURES = (
    "log_words", "log_distinct", "distinct_share", "top_word_share", "word_length", "lines_per_word", "dup_line_share",
    "upper", "digit", "stop", "bang", "symbol", "pipe", "other_ascii", "high", "space",
)
#: Rows that the classifier is fitted on, at most; the bound of the labelled sample.
MAX_FIT_ROWS = 20_000
#: Added before logarithms and logits.
SMOOTH = 1e-3

_CLASS = np.full(256, 7, dtype=np.uint8)  # other ASCII
for _codes, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b".,;:?'\"()-", 3), (b"!", 4), (b"#*$%&<>", 5), (b"|", 6), (range(128, 256), 8), ((32, *range(9, 14)), 9)):
    for _c in _codes:
        _CLASS[_c] = _k


def statistics(text: str | None) -> np.ndarray:
    """The vector of a whole text; an empty or null text has one, too."""
    raw = (text or "").encode()
    counts = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=10)
    words = raw.split()
    n, n_bytes = len(words), max(len(raw), 1)
    tally = Counter(words)
    lines = [x for x in re.split(rb"\n", raw) if x.strip()]
    logit = lambda share: np.log((share + SMOOTH) / (1 - share + SMOOTH))
    out = [
        np.log1p(n), np.log1p(len(tally)), logit(len(tally) / n if n else 0.5),
        logit(max(tally.values()) / n if n else 0.5), np.log1p((n_bytes - counts[9]) / n if n else 0.0),
        np.log(len(lines) / n + SMOOTH) if n else np.log(SMOOTH), logit(1 - len(set(lines)) / len(lines) if lines else 0.0),
        *(logit(counts[i] / n_bytes) for i in range(1, 10)),
    ]
    return np.array(out)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x array<double>`` for every row, whole texts, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            flat = pa.array(np.concatenate(x) if x else np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    means: np.ndarray  # class x feature
    factors: np.ndarray  # inverses of the Cholesky factors
    log_dets: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        dens = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            dens.append(-0.5 * (z * z).sum(1) - 0.5 * self.log_dets[k])
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.2, to_identity: float = 0.05) -> Discriminant:
    """Fit class densities, and a logistic curve over their difference.

    With one class only, or none, every score is the share of that class (0.5).
    """
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, float(np.log(p / (1 - p))))
    centred = [x[y == k] - x[y == k].mean(0) for k in (0, 1)]
    pooled = sum(c.T @ c for c in centred) / len(x)
    means, factors, log_dets = [], [], []
    for k, c in enumerate(centred):
        s = (1 - to_pooled) * (c.T @ c) / len(c) + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * np.trace(s) / d * np.eye(d) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(s)
        means.append(x[y == k].mean(0))
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    model = Discriminant(np.array(means), np.array(factors), np.array(log_dets))
    model.slope, model.offset = _curve(model.difference(x), y)
    return model


def _curve(diff: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps with a weak penalty."""
    scale = max(float(np.median(np.abs(diff))), 1e-9)
    a = np.stack([np.clip(diff / scale, -20, 20), np.ones_like(diff)], 1)
    w = np.array([1.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = a.T @ (p - y) + 1e-2 * w
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0) / scale), float(w[1])


def score(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_FIT_ROWS, label: str = "quality") -> DataFrame:
    """Every row's score, learnt from the labelled rows where ``learn`` holds.

    Columns doc_id, score (0 to 1, higher: label 1 likelier).  ``learn`` reads
    doc_id only.  The fit takes ``max_rows`` labelled rows of least hash;
    labels other than 0 and 1 and rows without doc_id aren't learnt from, several
    labels of one doc_id count each.  Null and empty texts are scored like any
    other; repeated rows repeat; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = materialize(features(docs), "quality-features")
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    sample = rows.where(learn).join(known, F.col("doc_id") == F.col("_id")).select("x", "y", F.xxhash64("doc_id", "y").alias("h"))
    share = min(1.0, 2.0 * max_rows / max(sample.count(), 1))  # thinned by the hash before rows are sent
    near = sample.where(F.shiftrightunsigned("h", 34) <= int(share * (1 << 30)))
    found = near.orderBy(F.shiftrightunsigned("h", 1), "x").limit(max_rows).collect()
    x = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES))
    model = spark.sparkContext.broadcast(fit(x, np.array([r["y"] for r in found], dtype=float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = np.asarray(batch.column(1).flatten()).reshape(n, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(vectors) if n else np.empty(0))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
