"""Uniqueness, optimistic locking and merge policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("error", "store", "object", "overwrite", "rollback")


def unique_conflicts(stored: DataFrame, pending: DataFrame, unique: tuple[str, ...], key: str) -> DataFrame:
    """(id, origin, unique...): pending rows whose unique columns equal another pending or another stored row's.

    The columns count as a tuple; a null in it never conflicts. The two tables are grouped together once.
    """
    both = stored.select(key, *unique, F.lit(False).alias("__p")).unionByName(pending.select(key, *unique, F.lit(True).alias("__p")))
    both = both.dropna(subset=list(unique))
    group = both.groupBy(*unique).agg(F.count_distinct(key).alias("__n"), F.max("__p").alias("__any"))
    hot = group.where("__n > 1 AND __any").select(*(F.col(u).alias(f"__{u}") for u in unique))
    rows = pending.join(hot, [pending[u] == F.col(f"__{u}") for u in unique], "left_semi")
    return rows.select(F.col(key).alias("id"), *unique)


def version_conflicts(base: DataFrame, stored: DataFrame, key: str, version: str) -> DataFrame:
    """(id, base_version, stored_version): rows changed in the store since base was read, or gone from it."""
    b = base.select(F.col(key).alias("id"), F.col(version).alias("base_version"))
    s = stored.select(F.col(key).alias("__k"), F.col(version).alias("stored_version"))
    rows = b.join(s, F.col("id") == F.col("__k"), "left")
    return rows.where(~F.col("base_version").eqNullSafe(F.col("stored_version"))).select("id", "base_version", "stored_version")


def merged(base: DataFrame, local: DataFrame, stored: DataFrame, key: str, columns: list[str], policy: str) -> DataFrame:
    """Rows with `key` and `columns` after a conflict.

    A side has changed a column when it differs from base. `store`: columns that the store changed win, then
    local ones; `object`: the other way round; `overwrite`: all local; `rollback`: all stored; `error`: an
    error for any row that both changed. Rows without a stored counterpart are left out.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    b = base.select(F.col(key).alias("__bk"), *(F.col(c).alias(f"b__{c}") for c in columns))
    m = local.select(key, *(F.col(c).alias(f"l__{c}") for c in columns))
    s = stored.select(F.col(key).alias("__sk"), *(F.col(c).alias(f"s__{c}") for c in columns))
    rows = m.join(s, F.col(key) == F.col("__sk")).join(b, F.col(key) == F.col("__bk"), "left")

    def pick(c: str) -> Column:
        own, other, was = F.col(f"l__{c}"), F.col(f"s__{c}"), F.col(f"b__{c}")
        mine, theirs = ~own.eqNullSafe(was), ~other.eqNullSafe(was)
        if policy == "store":
            return F.when(theirs, other).otherwise(own)
        if policy == "object":
            return F.when(mine, own).otherwise(other)
        if policy == "error":
            return F.when(mine & theirs & ~own.eqNullSafe(other), F.raise_error(F.concat(F.lit("conflict at "), F.col(key).cast("string")))).otherwise(F.when(mine, own).otherwise(other))
        return own if policy == "overwrite" else other

    return rows.select(key, *(pick(c).alias(c) for c in columns))
