"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking.

How many lists a query looks into is measured, not guessed: for TRIED queries the true neighbours are found
by comparing all vectors, and as many lists are probed as hold GOAL of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import joined_to_groups, ship, written

#: Vectors of a list that are searched together, and queries; longer lists are cut into chunks, more queries into parts.
CHUNK, ASKS = 4096, 512
#: Numbers of a distance table that are held at once, and vectors that the quantiser learns from at most.
TABLE, SAMPLE = 1 << 22, 200_000
#: Queries whose true neighbours are found by brute force, those of the smallest hash, and the part of
#: these neighbours that the probed lists must hold.
TRIED, GOAL = 200, 0.95


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0)


def _home(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some rows at a time."""
    step = max(1, TABLE // len(centres))
    return np.concatenate([_nearest(x[i : i + step], centres).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres by k-means; centres without rows keep their place."""
    draw = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _home(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centroids, and a codebook for each part of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int, seed: int) -> None:
        self.coarse = _means(sample, lists, seed)
        residuals = sample - self.coarse[_home(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.books = [_means(residuals[:, c], codes, seed + 1 + i) for i, c in enumerate(self.cuts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = _home(x, self.coarse)
        rest = x - self.coarse[home]
        return home, np.stack([_home(rest[:, c], b) for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)

    def errors(self, x: np.ndarray, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each vector lies from what its codes stand for."""
        rest = x - self.coarse[home]
        return np.sqrt(sum(((rest[:, c] - b[codes[:, i]]) ** 2).sum(1) for i, (c, b) in enumerate(zip(self.cuts, self.books))))

    def lists(self, x: np.ndarray, reach: int) -> np.ndarray:
        """The nearest lists of each row, nearest first."""
        step = max(1, TABLE // len(self.coarse))
        return np.concatenate([np.argsort(_nearest(x[i : i + step], self.coarse), axis=1, kind="stable")[:, :reach] for i in range(0, len(x), step)])

    def distances(self, query: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of a whole query to coded vectors, from one table for each part."""
        rest = query - self.coarse[home]
        total = np.zeros(len(codes))
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            total += ((b - rest[c]) ** 2).sum(1)[codes[:, i]]
        return total


def usable(vector: Column) -> Column:
    """Not null, not all zero, no null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def fit(vectors: DataFrame, lists: int | None, parts: int = 16, codes: int = 128, max_rows: int | None = None, seed: int = 11) -> Quantiser:
    """Lists grow as half the root of the number of vectors.

    Learns from about max_rows vectors at most, chosen by a hash of their values: by default 25 a list,
    20,000 at least and SAMPLE at most.
    """
    total = vectors.count()
    lists = lists or max(4, round(total**0.5 / 2))
    max_rows = max_rows or min(SAMPLE, max(20_000, 25 * lists))
    sample = vectors if total <= max_rows else vectors.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))
    rows = sample.select("vec").toArrow().column("vec").combine_chunks()
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return Quantiser(x, lists, parts, codes, seed)


def measured_probes(index: DataFrame, asked: DataFrame, model: Quantiser, k: int) -> int:
    """The fewest lists a query must look into to find GOAL of the true k nearest others of TRIED queries; 0 without any."""
    tried = asked.orderBy(F.xxhash64("id"), "id").limit(TRIED).toPandas()
    if not len(tried):
        return 0
    asks, x = tried["id"].to_numpy(), np.stack(tried["vec"].to_numpy()).astype(np.float64)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far, homes = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int32)
        for b in batches:
            if len(b):
                d = np.where(b["id"].to_numpy()[None, :] == asks[:, None], np.inf, _nearest(x, np.stack(b["vec"].to_numpy())))
                d = np.concatenate([far, d], 1)
                h = np.concatenate([homes, np.broadcast_to(b["home"].to_numpy(), (len(x), len(b)))], 1)
                best = np.argpartition(d, k - 1, axis=1)[:, :k]
                far, homes = np.take_along_axis(d, best, 1), np.take_along_axis(h, best, 1)
        yield pd.DataFrame({"query": np.repeat(np.arange(len(x)), k), "home": homes.ravel(), "far": far.ravel()})

    order = Window.partitionBy("query").orderBy("far")
    true = index.select("id", "vec", "home").mapInPandas(nearest, "query int, home int, far double").where(F.col("far") < float("inf"))
    true = true.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).toPandas()
    if not len(true):
        return 0
    place = np.argsort(np.argsort(_nearest(x, model.coarse), axis=1, kind="stable"), axis=1)
    places = np.sort(place[true["query"], true["home"]])
    return int(places[int(np.ceil(GOAL * len(places))) - 1]) + 1


def search(vectors: DataFrame, queries: Column, k: int = 10, lists: int | None = None, probes: int | None = None, shortlist: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, id_col, score): each query row's k nearest others found, by Euclidean distance.

    Every usable vector is indexed. Of equal vectors only the k + 1 smallest ids can be among the nearest,
    so further copies are left out without loss, and queries of equal vectors are searched once, for k + 1.
    A query looks into its `probes` nearest lists, by default as many as measured_probes() finds, 8 and
    three times the root of their number at least; the `shortlist` best of each chunk by coded distance
    are compared exactly, and then all vectors that may be nearer than the last of these, going by how far
    their codes are off. Equal distances go to smaller ids. Vectors of another length than the most common
    one take no part, nor do null ids. Ids are unique; of repeated ones each row counts.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), queries.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = rows.schema["id"].dataType.simpleString()
    result = f"query_id {kind}, rank int, `{id_col}` {kind}, score double"
    if common is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("vec") == common["n"])
    alike = Window.partitionBy("vec").orderBy("id")
    kept = written(rows.select("id", "vec").withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    model = fit(kept, lists, **options)
    count = len(model.coarse)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                home, codes = model.encode(np.stack(b["vec"].to_numpy()))
                yield pd.DataFrame({"home": home.astype(np.int32), "id": b["id"], "codes": [c.tobytes() for c in codes], "off": model.errors(np.stack(b["vec"].to_numpy()), home, codes), "vec": b["vec"]})

    index = written(kept.mapInPandas(coded, f"home int, id {kind}, codes binary, off double, vec array<double>"), "index")
    asking = written(rows.where("asks").select("id", "vec"), "queries")
    reach = min(count, probes or max(8, int(np.ceil(3 * count**0.5)), measured_probes(index, asking, model, k)))
    different = written(asking.groupBy("vec").agg(F.min("id").alias("ask"), F.count("*").alias("n")), "different-queries")

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = model.lists(np.stack(b["vec"].to_numpy()), reach)
                yield pd.DataFrame({"home": near.ravel().astype(np.int32), "ask": np.repeat(b["ask"].to_numpy(), near.shape[1])})

    looks = written(different.select("ask", "vec").mapInPandas(probed, f"home int, ask {kind}"), "looks")
    sizes = index.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    parts = looks.groupBy("home").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
    cuts = sizes.join(parts, "home")  # at most one row for each list
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = index.join(F.broadcast(cuts), "home").select("home", "id", "codes", "off", "vec", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), each("parts").alias("part"))
    asked = looks.join(F.broadcast(cuts), "home").select("home", "ask", F.pmod(F.xxhash64("ask"), F.col("parts")).cast("int").alias("part"), each("chunks").alias("chunk"))
    asked = asked.join(different.select("ask", "vec"), "ask")
    wanted = k + 1

    def compared(key: tuple, cell: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cell) and len(asks):
            ids, vecs, off = cell["id"].to_numpy(), np.stack(cell["vec"].to_numpy()), cell["off"].to_numpy()
            codes = np.frombuffer(b"".join(cell["codes"]), np.uint8).reshape(len(cell), -1)
            for ask, vec in zip(asks["ask"], asks["vec"]):
                far = model.distances(vec, key[0], codes)
                best = np.arange(len(far))
                if len(far) > max(shortlist, wanted):
                    best = np.argpartition(far, max(shortlist, wanted))[: max(shortlist, wanted)]
                    last = np.partition(np.sqrt(((vecs[best] - vec) ** 2).sum(1)), wanted - 1)[wanted - 1]
                    best = np.flatnonzero(np.sqrt(far) - off <= last * (1 + 1e-9) + 1e-9)
                exact = np.sqrt(((vecs[best] - vec) ** 2).sum(1))
                order = np.lexsort((ids[best], exact))[:wanted]
                out.append(pd.DataFrame({"ask": ask, "id": ids[best][order], "score": exact[order]}))
        return pd.concat(out) if out else pd.DataFrame({"ask": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    by = ("home", "chunk", "part")
    found = cells.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(compared, f"ask {kind}, id {kind}, score double")
    order = Window.partitionBy("ask").orderBy("score", "id")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    nearest = first.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("nearest"))  # k + 1 at most
    answers = written(different.join(nearest, "ask").select("vec", "n", "nearest"), "answers")
    out = joined_to_groups(asking.withColumnRenamed("id", "query_id"), answers, "vec", "n")
    others = F.slice(F.filter("nearest", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "of"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("of.id").alias(id_col), F.col("of.score").alias("score"))
