"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > k | x) = sigmoid(w.x - t_k) with one weight vector for all grades and ordered thresholds t_1 < t_2 < ...
A text's features are shares of its words: hashed words, hashed word shapes, and hashed signs of repetition. The fit
uses a bounded sample of rated rows; every row of the table is scored on its whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_repeats, bounded_sample, table

BUCKETS = 2048
SAMPLE_ROWS = 8_000
RIDGE = 1e-4
_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0")]


def _bucket(kind: bytes, value: bytes, buckets: int) -> int:
    return zlib.crc32(kind + value) % buckets


class _Words(dict):
    """Word -> its two buckets; forgets all when it grows beyond a bound."""

    def __init__(self, buckets: int, most: int = 300_000):
        self.buckets, self.most = buckets, most

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > self.most:
            self.clear()
        shape = word
        for pattern, sign in _RUNS:
            shape = pattern.sub(sign, shape)
        self[word] = found = (_bucket(b"w", word.lower(), self.buckets // 2), self.buckets // 2 + _bucket(b"s", shape[:12], self.buckets // 2))
        return found


def features(text: str | None, words: _Words) -> np.ndarray:
    """float32 vector of BUCKETS; all zero but the length sign for a null, empty or blank text."""
    found = (text or "").encode("utf-8", "surrogatepass").split()
    n, size = len(found), words.buckets
    out = np.zeros(size, np.float32)
    if n:
        pairs = np.array([words[w] for w in found], np.int64)
        out += np.bincount(pairs[:, 0], minlength=size).astype(np.float32) / n
        out += np.bincount(pairs[:, 1], minlength=size).astype(np.float32) / n
        lines = [s for s in (text or "").split("\n") if s.strip()]
        half = size // 2
        for name, share in (
            (b"again", sum(map(bytes.__eq__, found, found[1:])) / n),
            (b"unlike", len(set(found)) / n),
            (b"lines", 1 - len(set(lines)) / len(lines)),
        ):
            out[half + _bucket(b"r", name, half)] += share
    out[size // 2 + _bucket(b"l", str(min(n.bit_length(), 16)).encode(), size // 2)] += 0.1
    return out


@dataclass
class CumulativeLink:
    """grades: the distinct ratings, ascending; P(grade >= grades[k + 1]) = sigmoid(x @ weights - thresholds[k])."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - (x @ self.weights)[:, None], -40, 40)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(x: np.ndarray, ratings: np.ndarray, ridge: float = RIDGE, rounds: int = 300) -> CumulativeLink:
    """Maximum likelihood with a ridge, by Adam over all rows; thresholds stay ordered as a first one plus positive gaps."""
    grades = np.unique(ratings)
    d = x.shape[1]
    if len(grades) < 2:
        return CumulativeLink(grades if len(grades) else np.zeros(1), np.zeros(d), np.zeros(0))
    level = np.searchsorted(grades, ratings)
    k = len(grades) - 1
    share = [np.clip((level > j).mean(), 1e-3, 1 - 1e-3) for j in range(k)]
    first = [-math.log(s / (1 - s)) for s in share]
    mean = x.mean(0)
    spread = np.maximum(x.std(0), 0.01)
    z = ((x - mean) / spread).astype(np.float32)
    p = np.concatenate([np.zeros(d), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(x)
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        t = np.concatenate([[-np.inf], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))]), [np.inf]])
        score = z @ p[:d].astype(np.float32)
        # P(level) = s(t[level + 1] - score) - s(t[level] - score)
        s = 1 / (1 + np.exp(np.clip(score[:, None] - t[None], -40, 40)))
        s[:, 0], s[:, -1] = 0, 1
        hi, lo = s[rows, level + 1], s[rows, level]
        like = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / like / n, lo * (1 - lo) / like / n
        by_t = np.bincount(level + 1, -dhi, k + 2) + np.bincount(level, dlo, k + 2)
        by_t = by_t[1 : k + 1]
        gap = np.exp(p[d + 1 :])
        tail = np.cumsum(by_t[::-1])[::-1]
        grad = np.concatenate([(dhi - dlo).astype(np.float32) @ z + ridge * p[:d], tail[:1], tail[1:] * gap])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = p[:d] / spread
    t = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
    return CumulativeLink(grades.astype(float), w, t + mean @ w)


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> CumulativeLink:
    """docs(doc_id, text), ratings(doc_id, rating): fits on at most about `sample_rows` rated rows, chosen by a hash of
    doc_id. Features are made in Spark tasks; the driver gets sample_rows x buckets numbers."""
    rated = ratings.where("rating IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("rating").cast("double").alias("rating"))
    chosen = bounded_sample(rated, "doc_id", sample_rows)
    sample = bounded_repeats(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "rating")).select("text", "rating")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(buckets)
        for batch in batches:
            found = [features(t, words).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(1)], ["x", "rating"])

    xs, ys = [], []
    for r in sample.mapInArrow(run, "x binary, rating double").toLocalIterator():
        xs.append(np.frombuffer(r["x"], np.float32))
        ys.append(r["rating"])
    order = np.lexsort((np.array([zlib.crc32(x.tobytes()) for x in xs]), np.array(ys))) if xs else []
    return fit(np.array([xs[i] for i in order]).reshape(-1, buckets), np.array([ys[i] for i in order]))


def grade(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, expected_grade, tails (P(grade >= k) for each grade above the lowest).

    Null, empty and blank texts are scored like any other; rows are kept one to one; with fewer than two different
    ratings the expected grade is the one there is (0 without any) and tails are empty. A null doc_id stays null; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = _Words(len(m.weights))
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            x = np.array([features(t, words) for t in batch.column(1).to_pylist()])
            tails = m.tails(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.expected(tails)), pa.array(tails.tolist(), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def select_quality(docs: DataFrame, model: CumulativeLink, least: float = 0.5) -> DataFrame:
    """docs whose probability of a grade above the lowest reaches `least`; all columns stay, nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = _Words(len(m.weights))
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            tails = m.tails(np.array([features(t, words) for t in batch.column(place).to_pylist()]))
            good = tails[:, 0] >= least if tails.shape[1] else np.ones(batch.num_rows, bool)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def quality_model(spark: SparkSession, sf_dir: str) -> CumulativeLink:
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("rating"))
    return train(table(spark, sf_dir, "documents").select("doc_id", "text"), ratings)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grade(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    top = F.coalesce(F.get("tails", F.lit(0)), F.lit(1.0))
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round(top, 6).alias("tail_probability"), (top >= 0.5).alias("kept"))
