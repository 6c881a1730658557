"""Sources and sinks: in-memory rows, several stores as one, snapshots, cached results, lineage cuts, sets of members."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.model import Model, ModelError, Store
from orrery.plans.compiler import fetch
from orrery.plans.request import Request


def memory_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of Python rows; missing values are null."""
    empty = spark.createDataFrame([], schema)
    return spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in rows], empty.schema)


def store_from(spark: SparkSession, model: Model, path: str, read_only: bool = False) -> Store:
    """A store over Parquet tables named path/<table>.parquet."""
    names = {model.root(e).table for e in model.entities.values()} | {r.bridge[0] for e in model.entities.values() for r in e.relationships if r.bridge}
    return Store(spark, model, {n: spark.read.parquet(f"{path}/{n}.parquet") for n in sorted(names)}, read_only=read_only)


def save_store(store: Store, path: str) -> None:
    """Writes every table to a new folder; the tables being read stay as they are."""
    for name, df in store.tables.items():
        df.write.parquet(f"{path}/{name}.parquet")


def fetch_all(stores: list[Store], request: Request) -> DataFrame:
    """The rows of a request on every store, one after the other; columns missing in one are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [fetch(s, request) for s in stores])


#: Readers of stores by kind: functions of a session, a model and a path.
STORES: dict[str, Callable[[SparkSession, Model, str], Store]] = {}


def register(kind: str, reader: Callable[[SparkSession, Model, str], Store]) -> None:
    """Adds a kind of store for opened(); of one name, the last reader counts."""
    STORES[kind] = reader


def opened(spark: SparkSession, model: Model, kind: str, path: str) -> Store:
    """A store of a registered kind; "parquet" is there from the start, and "xml" once its module is imported."""
    if kind not in STORES:
        raise ModelError(f"no store of kind {kind!r}")
    return STORES[kind](spark, model, path)


register("parquet", store_from)


def analyzed(spark: SparkSession, table: str, columns: tuple[str, ...] = ()) -> None:
    """Gathers a catalog table's statistics, of all columns where none are named."""
    which = f"FOR COLUMNS {', '.join(f'`{c}`' for c in columns)}" if columns else "FOR ALL COLUMNS"
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS {which}")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, in the folder that spark.checkpoint.dir names; lost executors can be replaced.

    Where that setting is missing, a local session gets a folder of its own, and any other is refused.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ModelError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="orrery-"))
    return df.checkpoint()


class ResultCache:
    """Cached results by request and generation; a write starts a new generation and frees the old one's."""

    def __init__(self, store: Store) -> None:
        self.store, self.generation, self.kept = store, 0, {}

    def fetch(self, request: Request) -> DataFrame:
        if not request.cacheable():
            return fetch(self.store, request)
        key = request.key(self.generation)
        if key not in self.kept:
            self.kept[key] = fetch(self.store, request).cache()
        return self.kept[key]

    def changed(self, store: Store) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.store, self.generation, self.kept = store, self.generation + 1, {}


def pages(store: Store, request: Request, key: str, size: int):
    """Consecutive DataFrames of at most `size` rows by ascending key; each starts after the last key seen.

    Each page is computed once, and the next one starts from the greatest key in it.
    """
    rows, last = fetch(store, request), None
    while True:
        page = cut((rows if last is None else rows.where(F.col(key) > F.lit(last))).orderBy(key).limit(size))
        last, n = page.agg(F.max(key), F.count("*")).first()
        if not n:
            return
        yield page
        if n < size:
            return


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of either of two relationships, once each; the sides have the same columns."""
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of one of two relationships but not of both; the sides are read and shuffled once."""
    names = a.columns
    sides = a.select(*names, F.lit(1).alias("__side")).union(b.select(*b.columns, F.lit(2)))
    return sides.groupBy(*names).agg(F.count_distinct("__side").alias("__n")).where("__n = 1").select(*names)
