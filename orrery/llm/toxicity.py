"""Toxicity grades by cumulative-link ordinal regression over sparse word features.

The labels at hand are 0 and 1, so the two grades above 0 are told apart by us: a marked document is
grade 2 if it holds many of the words that most raise the odds of the label. Severity says how much of
such wording a document has, not how grave a person would find it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .shared import mapped, written

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class OrdinalModel:
    """P(grade <= k) = logistic(cut[k] - weights of the words present); the weights serve all cuts."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, cuts: np.ndarray) -> None:
        self.place, self.weights, self.cuts = {w: i for i, w in enumerate(vocabulary)}, weights, cuts

    def features(self, text: str | None) -> list[int]:
        place = self.place
        return sorted({place[w] for w in words(text) if w in place})

    def probabilities(self, at: list[int]) -> np.ndarray:
        below = 1 / (1 + np.exp(-(self.cuts - self.weights[at].sum())))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = 0.05, rounds: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts of largest penalised likelihood, by gradient steps of adaptive size."""
    n, m = x.shape
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(m), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    first = second = np.zeros_like(theta)
    for t in range(1, rounds + 1):
        gaps = np.exp(theta[m + 1 :])
        cuts = theta[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        line = (x @ theta[:m].astype(x.dtype)).astype(np.float64)  # of one type: else x is copied in every round
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - line[:, None], -40, 40)))
        edges = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slope = edges * (1 - edges)
        p = np.maximum(edges[np.arange(n), y + 1] - edges[np.arange(n), y], 1e-12)
        upper, lower = slope[np.arange(n), y + 1] / p, slope[np.arange(n), y] / p
        by_cut = np.array([upper[y == k].sum() - lower[y == k + 1].sum() for k in range(grades - 1)])
        grad = np.concatenate([-((upper - lower).astype(x.dtype) @ x) - ridge * theta[:m], [by_cut.sum()], [gaps[j] * by_cut[j + 1 :].sum() for j in range(grades - 2)]]) / n
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:m], theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 30_000, size: int = 400, markers: int = 40) -> OrdinalModel:
    """Learns from documents that `labels` marks 0 or 1 and that are not held out.

    At most about max_rows labelled documents are used, chosen by a hash of their ids; the driver gets
    their places among the `size` words that most raise or lower the odds of the label, never their texts.
    Marked documents are graded: 2 if they hold at least as many of the strongest `markers` words as the
    median marked document and more than one, else 1. Unmarked ones are grade 0.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & F.col("__id").isNotNull() & ~held_out(F.col("__id"))).groupBy("__id").agg(F.max("y").alias("y"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(known, "__id").select("__id", "y", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(set(words(t.as_py()))) for t in b.column(1)], pa.list_(pa.string()))], names=["y", "words"])

    kind = known.schema["y"].dataType.simpleString()
    rows = written(mapped(rows.select("y", "text"), each, f"y {kind}, words array<string>"), "toxic-words")
    counts = {bool(r["y"]): r["count"] for r in rows.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    marked, clean = counts.get(True, 0), counts.get(False, 0)
    if not marked or not clean:
        return OrdinalModel([], np.zeros(0), np.array([20.0, 21.0]))
    each_word = rows.select((F.col("y") > 0).cast("int").alias("m"), F.explode("words").alias("word")).groupBy("word").agg(F.sum("m").alias("a"), F.count("*").alias("n"))
    odds = F.log((F.col("a") + 0.5) / (marked - F.col("a") + 0.5)) - F.log((F.col("n") - F.col("a") + 0.5) / (clean - F.col("n") + F.col("a") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    best = each_word.where(F.col("n") >= min(5, marked, clean)).withColumn("z", odds / error).orderBy(F.abs("z").desc(), "word").limit(size).select("word", "z").collect()
    vocabulary = [r["word"] for r in best]
    strongest = {r["word"] for r in sorted(best, key=lambda r: -r["z"])[:markers] if r["z"] > 3}
    wanted = F.array_intersect("words", F.lit(vocabulary)).alias("words")
    sample = rows.select((F.col("y") > 0).cast("int").alias("y"), wanted).toArrow()
    y, found = sample.column("y").to_numpy(), sample.column("words").to_pylist()
    place = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(y), len(vocabulary)), np.float32)
    for i, ws in enumerate(found):
        x[i, [place[w] for w in ws]] = 1
    hits = np.array([len(strongest.intersection(ws)) for ws in found])
    grade = np.where(y == 0, 0, np.where(hits >= max(2.0, np.median(hits[y == 1])), 2, 1))
    weights, cuts = fit_ordinal(x, grade, 3)
    return OrdinalModel(vocabulary, weights, cuts)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id_col, grade (likeliest), severity (expected grade), p_toxic, toxic (0 or 1).

    Whole texts are scored; null is empty. Without labels of both kinds all documents are grade 0.
    """
    model = learn(docs, labels, label_col, id_col, text_col, **options)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([model.probabilities(model.features(t.as_py())) for t in b.column(1)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.argmax(1), pa.int32()), pa.array(p @ np.arange(3.0), pa.float64()), pa.array(1 - p[:, 0], pa.float64())], names=[id_col, "grade", "severity", "p_toxic"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    out = mapped(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, grade int, severity double, p_toxic double")
    return out.withColumn("toxic", (F.col("p_toxic") >= threshold).cast("int"))
