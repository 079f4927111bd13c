"""Quality scores by Bradley-Terry pairwise ranking.

A bounded sample of labelled rows gives preference pairs (a good text over a poor one). Logistic loss on the
difference of their features teaches a weight for each feature; a text's strength is its weighted sum. A quantile of
the strengths seen in training is the threshold: scores are logistic in the distance to it.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKS = b".,;:!?|#$%&*<>{}[]()=/\\_-+@'\"~^`"
NAMES = ["log_words", "word_length", "short_words", "long_words", "upper", "digit", "space", "high", "distinct_words", "top_word", "repeated_lines", "line_words", "stop_ends", "word_spread", *(f"mark_{chr(b)}" for b in MARKS)]


def features(data: bytes) -> list[float]:
    """Shape of a whole text (UTF-8): rates of kinds of letters and marks, repetition of words and lines."""
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = max(len(data), 1)
    words = data.lower().split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    marks = hist[list(MARKS)] / n
    return [
        np.log1p(len(words)),
        lengths.sum() / n,
        (lengths <= 3).sum() / n,
        (lengths >= 14).sum() / n,
        hist[65:91].sum() / size,
        hist[48:58].sum() / size,
        (hist[9] + hist[10] + hist[13] + hist[32]) / size,
        hist[128:].sum() / size,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        (hist[46] + hist[33] + hist[63]) / max(len(lines), 1) / 8,
        float(lengths.std()) if len(words) else 0.0,
        *np.sqrt(marks),
    ]


@dataclass
class Model:
    """A strength is weights . clip((x - mean) / scale, -bound, bound)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    steepness: float = 1.0
    bound: float = 6.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -self.bound, self.bound) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.steepness * (self.strength(x) - self.threshold), -30, 30)))


def with_features(rows: DataFrame, keep: str, kind: str) -> DataFrame:
    """keep and the array of features of each row's text."""

    def work(batches):
        for batch in batches:
            x = [features(t) for t in common.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])

    return rows.select(keep, "text").mapInArrow(work, f"{keep} {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6000, pairs: int = 60_000, learn: Column | None = None, quantile: float | None = None, seed: int = 7) -> Model:
    """Learn from at most max_rows labelled rows (the smallest hashes of their ids) that pass learn.

    quantile: which quantile of the training strengths is the threshold; None takes the one with the
    fewest training errors. With one label only, or none, all strengths are 0 and scores follow the label
    that was seen (0.75 for 1, 0.25 for 0, 0.5 for none)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known if learn is None else known.where(learn)
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # The sample has max_rows rows of two numbers at most, so its broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    got = with_features(rows, "label", "int").toArrow()
    y = got.column("label").to_numpy()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(len(y), len(NAMES))
    order = np.lexsort((*x.T[::-1], y))  # the same pairs whatever order rows arrive in
    x, y = x[order], y[order]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(good) or not len(bad):
        sure = 0.0 if not len(y) else np.log(3) * (1 if len(good) else -1)
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), threshold=-sure)
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(len(NAMES)))
    z = np.clip((x - model.mean) / model.scale, -model.bound, model.bound)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(30):  # Newton's method on the mean logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(axis=0) + 1e-3 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    model.weights = w
    s = np.sort(model.strength(x))
    if quantile is None:
        strengths, truth = model.strength(x), y == 1
        grid = np.linspace(0, 1, min(2 * len(s) + 1, 4001))
        quantile = grid[np.argmin([((strengths >= t) != truth).sum() for t in np.quantile(s, grid)])]
    model.threshold = float(np.quantile(s, quantile))
    return model


def score(docs: DataFrame, model: Model, keep: str = "doc_id", kind: str = "long") -> DataFrame:
    """keep, score (0 to 1) and predicted (1 from 0.5 on) of each row; null and empty texts are scored alike.

    Repeated rows and null ids stay; no other column is read."""

    def work(batches):
        for batch in batches:
            x = np.array([features(t) for t in common.text_bytes(batch.column("text"))], dtype=np.float64).reshape(-1, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[keep, "score", "predicted"])

    return docs.select(F.col(keep).cast(kind).alias(keep), "text").mapInArrow(work, f"{keep} {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject."""
    names = docs.columns
    schema = docs.schema
    at = names.index("text")

    def work(batches):
        for batch in batches:
            x = np.array([features(t) for t in common.text_bytes(batch.column(at))], dtype=np.float64).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(x) >= 0.5))
        common.give_back()

    return docs.mapInArrow(work, schema)
