"""Quality scores: document statistics, random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mapped, spread, written

#: Bytes that a statistic counts; each group's share of the text is one statistic.
GROUPS = (b"|", b"%", b"#", b"*", b"&", b"$", b"@", b"<>", b"{}[]", b"()", b"=+~^", b"_-", b"/\\", b"'\"`", b".", b",", b";:", b"!?", b"\n", b"\t\r\x0b\x0c", b" ", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FEATURES = len(GROUPS) + 7
#: Labelled rows whose normal equations one task sums.
ROWS_A_PART = 65_536
_MEMBER = np.zeros((256, len(GROUPS)), np.float64)
for _g, _bytes in enumerate(GROUPS):
    _MEMBER[list(_bytes), _g] = 1


def held_out(doc_id: Column) -> Column:
    """Rows that no model of this subpackage learns from: those whose id's CRC-32 is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def statistics(text: str) -> np.ndarray:
    """Shares of byte groups and of distinct words and lines, word lengths, size; all bounded or logarithmic."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, words, lines = max(1, len(raw)), text.split(), text.split("\n")
    shares = np.bincount(raw, minlength=256) @ _MEMBER / n
    count = max(1, len(words))
    rest = (np.count_nonzero(raw >= 128) / n, np.count_nonzero(raw < 32) / n)
    own = (len(set(words)) / count, len(set(lines)) / len(lines), np.log1p(len(raw) / count), np.log1p(len(words)), np.log1p(len(raw) / len(lines)))
    return np.concatenate([np.log1p(1000 * np.array([*shares, *rest])), own])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x): the statistics of each whole text; null is empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or "") for t in b.column(1)], np.float64).reshape(-1, FEATURES)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[id_col, "x"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return mapped(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, x array<double>")


class QualityModel:
    """Ridge weights over random Fourier features of standardised statistics, and a calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.scale, self.size = mean, scale, size
        self.turn, self.shift = draw.normal(0, 1 / width, (len(mean), size)), draw.uniform(0, 2 * np.pi, size)
        self.weights, self.at, self.level = np.zeros(size + 1), np.array([0.0]), np.array([0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The Fourier features, whose inner products approximate a Gaussian kernel, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / self.size) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.level)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, FEATURES))


def isotonic(at: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing levels for ascending places, weighted by counts."""
    blocks: list[list[float]] = []
    for x, h, n in zip(at, hits, counts):
        blocks.append([x * n, h, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def fit(rows: DataFrame, size: int = 384, width: float = 6.0, ridge: float = 1e-4, seed: int = 7, bins: int = 400, parts: int = 24) -> QualityModel:
    """Learns from all rows (id, x, y), y 0 or 1.

    Rows are dealt to the parts by a hash of x and id, so that copies of a text spread; there are more
    parts where `parts` would get more than ROWS_A_PART rows each. Each part sums its own share of the
    normal equations; the driver gets a matrix of size + 1 rows and a calibration table of `bins` rows.
    Without rows of both kinds, every score is the share of 1 among them, or 0.5 without any.
    """
    parts = max(parts, spread(rows, ROWS_A_PART))
    rows = written(rows.select("id", "x", F.col("y").cast("double").alias("y")).repartition(parts, F.xxhash64("x", "id")), "labelled")
    moments = rows.agg(F.count("*"), F.avg("y"), *(f(F.get("x", F.lit(i))) for i in range(FEATURES) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0] or moments[1] in (0.0, 1.0):
        model = QualityModel(np.zeros(FEATURES), np.ones(FEATURES), size, width, seed)
        model.level = np.array([0.5 if not moments[0] else moments[1]])
        return model
    model = QualityModel(np.array(moments[2::2]), np.maximum(np.array(moments[3::2]), 1e-3), size, width, seed)

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, n = np.zeros((size + 1, size + 1)), np.zeros(size + 1), 0
        for b in batches:
            z = model.lift(_matrix(b["x"]))
            left, right, n = left + z.T @ z, right + z.T @ b["y"].to_numpy(), n + len(b)
        yield pd.DataFrame({"i": np.arange(size + 1), "v": list(np.column_stack([left, right]))})

    def added(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.stack(b["v"].to_numpy()), axis=0)]})

    kind = "i int, v array<double>"
    sums = rows.mapInPandas(share, kind).groupBy("i").applyInPandas(added, kind).orderBy("i").collect()
    system = np.array([r["v"] for r in sums])
    model.weights = np.linalg.solve(system[:, :-1] + ridge * moments[0] * np.eye(size + 1), system[:, -1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = model.raw(_matrix(b["x"]))
            yield pd.DataFrame({"bin": np.clip((raw + 0.5) / 2 * bins, 0, bins - 1).astype(np.int32), "raw": raw, "y": b["y"]})

    table = rows.mapInPandas(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw"), F.sum("y"), F.count("*")).orderBy("bin").collect()
    model.at, model.level = isotonic(*np.array([tuple(r)[1:] for r in table]).T)
    return model


def scored(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """(id_col, score) of document_statistics()' rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "score": np.clip(model.score(_matrix(b["x"])), 0, 1)})

    kind = stats.schema[id_col].dataType.simpleString()
    return stats.select(id_col, "x").mapInPandas(each, f"`{id_col}` {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1), predicted (1 from the threshold on).

    Scores depend on the text alone. Labels are learnt from rows that are not held out; null labels and
    labels without a document are ignored, conflicting ones all count. Null texts are empty and are scored.
    """
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("__id")))
    model = fit(stats.join(known, stats[id_col] == known["__id"]).select(F.col("__id").alias("id"), "x", "y"), **options)
    out = scored(stats, model, id_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
