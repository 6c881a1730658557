"""Change history: differences of snapshots, logs with tokens, and a stream of new changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.model import ModelError

CHANGE = "transaction bigint, at timestamp_ntz, entity string, kind string, id bigint, updated array<string>, tombstone map<string,string>"


def difference(before: DataFrame, after: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kind, id, updated, tombstone): one row for each inserted, updated or deleted key.

    updated lists changed columns; tombstone holds the columns `keep` of deleted rows. Keys are unique.
    """
    columns = [c for c in before.columns if c != key]
    a = before.select(F.col(key).alias("__a"), *(F.col(c).alias(f"a__{c}") for c in columns))
    b = after.select(F.col(key).alias("__b"), *(F.col(c).alias(f"b__{c}") for c in columns))
    rows = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a__{c}").eqNullSafe(F.col(f"b__{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").when(F.size(changed) > 0, "update")
    grave = F.create_map(*(x for c in keep for x in (F.lit(c), F.col(f"a__{c}").cast("string")))) if keep else F.create_map().cast("map<string,string>")
    out = rows.select(kind.alias("kind"), F.coalesce("__a", "__b").alias("id"), F.when(kind == "update", changed).alias("updated"), F.when(kind == "delete", grave).alias("tombstone"))
    return out.where(F.col("kind").isNotNull())


def logged(changes: DataFrame, log: DataFrame | None, entity: str, at: Column) -> DataFrame:
    """changes as rows of one new transaction, numbered after the log's last."""
    last = F.lit(0) if log is None else F.lit((log.agg(F.max("transaction")).first() or [0])[0] or 0)
    return changes.select((last + 1).cast("bigint").alias("transaction"), at.cast("timestamp_ntz").alias("at"), F.lit(entity).alias("entity"), "kind", F.col("id").cast("bigint").alias("id"), "updated", "tombstone")


def after(log: DataFrame, token: int | None = None, date=None, transactions: list[int] | None = None, matching: Column | None = None) -> DataFrame:
    """Changes strictly after a token or a date, of given transactions, and meeting a condition."""
    if token is not None:
        log = log.where(F.col("transaction") > token)
    if date is not None:
        log = log.where(F.col("at") > F.lit(date).cast("timestamp_ntz"))
    if transactions is not None:
        log = log.where(F.col("transaction").isin(transactions))
    return log if matching is None else log.where(matching)


def purged(log: DataFrame, token: int | None = None, date=None) -> DataFrame:
    """The log without changes strictly before a token or a date."""
    if token is None and date is None:
        raise ModelError("a purge needs a token or a date")
    keep = F.col("transaction") >= token if token is not None else F.col("at") >= F.lit(date).cast("timestamp_ntz")
    return log.where(keep)


def shaped(log: DataFrame, result: str) -> DataFrame:
    """status, count, ids, transactions, changes (one row each), or transactions with their changes nested.

    Nesting puts all changes of a transaction into one row, so it is for single transactions and short logs;
    `changes` sorted by transaction is the same without that limit.
    """
    if result == "status":
        return log.agg((F.count("*") >= 0).alias("status"))
    if result == "count":
        return log.agg(F.count_distinct("transaction").alias("count"))
    if result == "ids":
        return log.select("entity", "id").distinct()
    if result == "transactions":
        return log.select("transaction", "at").distinct()
    if result == "changes":
        return log
    if result != "nested":
        raise ModelError(f"unknown result {result!r}")
    item = F.struct("id", "kind", "entity", "updated")
    return log.groupBy("transaction", "at").agg(F.sort_array(F.collect_list(item)).alias("changes"))


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The log's new files as a stream; the checkpoint of the query that reads it is its token."""
    return spark.readStream.schema(CHANGE).parquet(path)


def latest_token(log: DataFrame) -> DataFrame:
    return log.agg(F.max("transaction").alias("token"))


def notify(spark: SparkSession, path: str, checkpoint: str, callback) -> object:
    """Calls callback(token, changes) for each batch of new changes that has any."""

    def each(batch: DataFrame, _: int) -> None:
        token = batch.agg(F.max("transaction")).first()[0]
        if token is not None:
            callback(token, batch)

    return stream(spark, path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def merged_inserts(rows: DataFrame, log: DataFrame, remote: DataFrame, key: str, entity: str) -> DataFrame:
    """rows with what another store's log says it has inserted: those of remote's rows whose key is not here yet."""
    new = log.where((F.col("kind") == "insert") & (F.col("entity") == entity)).select(F.col("id").alias("__id")).distinct()
    found = remote.join(new, remote[key] == F.col("__id"), "left_semi")
    own = rows.select(F.col(key).alias("__own"))
    return rows.unionByName(found.join(own, found[key] == F.col("__own"), "left_anti").select(*rows.columns))
