"""Language identification by sparse multinomial logistic regression.

Texts become TF-IDF vectors of hashed character n-grams (letters in lower case,
every run of other characters one blank).  Weights are learnt with
follow-the-regularised-leader steps under an elastic-net penalty, so most stay
exactly zero; one temperature, fitted on rows kept aside, calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, small_batches, unused

DIM_BITS = 15
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
#: Bounds of the labelled sample that weights are fitted on: texts of one language, texts of all.
MAX_PER_LANGUAGE, MAX_TEXTS = 400, 20_000
#: More values than this aren't taken for languages: fitting stops with an error.
MAX_LANGUAGES = 1000
#: Random cuts of each sampled text that are learnt as well, for short texts.
CUTS, CUT_CHARS = 2, (12, 120)
UNKNOWN = "und"


@lru_cache
def _letters() -> np.ndarray:
    """Of every code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text: positions and counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
    letters = _letters()[points]
    points = np.where(letters, points, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first of a run of other characters
    points = points[keep]
    if len(points) and points[0] != 32:
        points = np.concatenate(([np.uint32(32)], points))
    if len(points) < 2:
        return np.empty(0, dtype=np.int64), np.empty(0)
    codes, h = [], np.zeros(len(points), dtype=np.uint32)
    for k in range(max(ORDERS)):
        if k >= len(points):
            break
        h = (h[: len(points) - k] * np.uint32(0x01000193)) ^ (points[k:] * np.uint32(0x9E3779B1))
        if k + 1 in ORDERS:
            x = h ^ (h >> np.uint32(15))
            codes.append(((x * np.uint32(0x85EBCA6B + 2 * k)) >> np.uint32(32 - DIM_BITS)).astype(np.int64))
    codes = np.concatenate(codes)
    if len(codes) < 4000:
        return np.unique(codes, return_counts=True)
    counts = np.bincount(codes, minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x language
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (vector(at, counts, self.idf) @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def document_frequencies(rows: DataFrame, fan_in: int = 32) -> tuple[np.ndarray, int]:
    """In how many rows each hashed n-gram occurs, over all rows; and the rows.

    A task emits one vector of DIM counts; vectors are summed in a tree, so no
    task and not the driver gets more than a fixed number of them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[ngrams(text)[0]] += 1
                df[DIM] += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()])], names=["df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                df += np.frombuffer(raw, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()])], names=["df"])

    sums = small_batches(rows).select("text").mapInArrow(count, "df binary")
    sums = materialize(sums, "langid-df")
    n = sums.count()
    while n > 1:
        n = -(-n // fan_in)
        sums = sums.repartition(n).mapInArrow(add, "df binary")
    got = [np.frombuffer(r["df"], dtype=np.int64) for r in sums.collect()]
    total = sum(got, np.zeros(DIM + 1, dtype=np.int64))
    return total[:DIM], int(total[DIM])


def sample(rows: DataFrame, per_language: int, most: int) -> DataFrame:
    """Rows of every language, those of least hash: ``per_language`` of each, or fewer so that all are ``most`` at most."""
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1)
    number = counts.count()
    if number > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    each = max(1, min(per_language, most // max(number, 1)))
    shares = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(4.0 * each) / F.col("count")).alias("_p"))
    spot = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # thinned by a hash before rows of a language meet
    near = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).withColumn("_h", spot).where(F.col("_h") < F.col("_p"))
    w = Window.partitionBy("lang").orderBy("_h", "doc_id")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).select("lang", "text", "_h")


def _examples(chosen: DataFrame) -> pd.DataFrame:
    """n-grams of the sampled texts and of random cuts of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = np.random.default_rng(int(h * (1 << 30)))
                parts = [text or ""]
                for _ in range(CUTS):
                    size = int(r.integers(*CUT_CHARS))
                    if len(parts[0]) > size:
                        start = int(r.integers(0, len(parts[0]) - size))
                        parts.append(parts[0][start : start + size])
                for i, part in enumerate(parts):
                    at, counts = ngrams(part)
                    if len(at):
                        out.append((lang, h, i, at.astype(np.int32).tobytes(), counts.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, [pa.string(), pa.float64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["lang", "h", "part", "at", "n"])

    return chosen.mapInArrow(run, "lang string, h double, part int, at binary, n binary").toPandas()


def train(examples: pd.DataFrame, df: np.ndarray, n: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3) -> Model:
    """Follow-the-regularised-leader; a fifth of the texts sets the temperature."""
    languages = sorted(set(examples["lang"]))
    idf = np.log((n + 1) / (df + 1)) + 1
    k = len(languages)
    at = [np.frombuffer(x, dtype=np.int32) for x in examples["at"]]
    x = [vector(a, np.frombuffer(c, dtype=np.float32).astype(float), idf) for a, c in zip(at, examples["n"], strict=True)]
    y = np.searchsorted(languages, examples["lang"].to_numpy()) if k else np.empty(0, dtype=int)
    aside = (examples["h"].to_numpy() * (1 << 30)).astype(int) % 5 == 0 if k else np.empty(0, dtype=bool)
    z, g2 = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    order = np.random.default_rng(0)

    def current(a):
        zz = z[a]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(g2[a])) / alpha + l2))

    at = [np.append(a, DIM) for a in at]  # the last coordinate is the bias
    x = [np.append(v, 1.0) for v in x]
    for _ in range(epochs if k > 1 else 0):
        for i in order.permutation(np.flatnonzero(~aside)):
            a, v = at[i], x[i]
            w = current(a)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(g2[a] + g * g) - np.sqrt(g2[a])) / alpha
            z[a] += g - sigma * w
            g2[a] += g * g
    w = current(np.arange(DIM + 1))
    model = Model(languages, idf, w[:DIM].astype(np.float32), w[DIM])
    held = np.flatnonzero(aside)
    if k > 1 and len(held):
        s = np.array([x[i] @ w[at[i]] for i in held])
        model.temperature = _temperature(s, y[held])
    return model


def _temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The least negative log-likelihood on a fine grid of temperatures."""
    def loss(t):
        q = s / t
        m = q.max(1)
        return (m + np.log(np.exp(q - m[:, None]).sum(1)) - q[np.arange(len(y)), y]).mean()

    return float(min(np.geomspace(0.05, 10, 120), key=loss))


def fit(docs: DataFrame, learn: Column, per_language: int = MAX_PER_LANGUAGE, most: int = MAX_TEXTS) -> Model:
    """A model from text and non-null lang of the rows where ``learn`` holds.

    Document frequencies cover all of these rows; weights a bounded sample, in
    which every language has its share.  Rows with a null text or lang aren't
    learnt from, rows that repeat count each, other columns are not read; an
    empty table gives a model that answers ``und``.
    """
    rows = docs.where(learn).select("doc_id", "text", "lang").where("lang is not null and text is not null")
    df, n = document_frequencies(rows)
    return train(_examples(sample(rows, per_language, most)), df, n)


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` and the predicted language and its probability, for every row, whole texts, no shuffle.

    ``und`` with score 0 for a null text, one without a letter, and if nothing
    was learnt.  ``names`` are the two new columns; ``keep`` may have any other
    names, ``text`` as well.  Repeated rows repeat; an empty table gives no rows.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # DIM weights for each language

    @F.arrow_udf("lang string, score double")  # only the text goes to Python
    def best(texts: pa.Array) -> pa.Array:
        m, langs, scores = shared.value, [], []
        for text in texts:
            at, counts = ngrams(text.as_py())
            if len(at) and m.languages:
                p = m.probabilities(at, counts)
                k = int(p.argmax())
                langs.append(m.languages[k])
                scores.append(float(p[k]))
            else:
                langs.append(UNKNOWN)
                scores.append(0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    found = unused(docs, "found")
    kept = [f"`{c}`" for c in keep]
    return docs.select(*kept, best("text").alias(found)).select(*kept, F.col(found)["lang"].alias(names[0]), F.col(found)["score"].alias(names[1]))
