"""Live queries: sections of a result, and the moves between two states of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.model import Store
from orrery.plans.compiler import fetch
from orrery.plans.request import Request


def sections(rows: DataFrame, by: str, order: list[str], key: str = "objectID") -> DataFrame:
    """(section, title, n, ids): rows by section, ids in order within it; title is the upper-case initial."""
    item = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col(key).alias("id"))
    grouped = rows.groupBy(F.col(by).alias("section")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("section", F.upper(F.left(F.col("section").cast("string"), F.lit(1))).alias("title"), "n", F.transform("items", lambda x: x["id"]).alias("ids"))


def ranked(rows: DataFrame, order: list, within: str, key: str = "objectID") -> DataFrame:
    """(id, section, rank): places from 0 within each section."""
    return rows.select(F.col(key).alias("id"), F.col(within).alias("section"), (F.row_number().over(Window.partitionBy(within).orderBy(*order, key)) - 1).alias("rank"))


def moves(before: DataFrame, after: DataFrame, compared: list[str] = ()) -> DataFrame:
    """(id, change, from_section, from_rank, to_section, to_rank) of two ranked() results.

    insert, delete, move (another section or rank) or update (same place, another value in `compared`).
    """
    b = before.select(F.col("id").alias("__b"), F.col("section").alias("from_section"), F.col("rank").alias("from_rank"), *(F.col(c).alias(f"b__{c}") for c in compared))
    a = after.select(F.col("id").alias("__a"), F.col("section").alias("to_section"), F.col("rank").alias("to_rank"), *(F.col(c).alias(f"a__{c}") for c in compared))
    rows = b.join(a, F.col("__b") == F.col("__a"), "full_outer")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"a__{c}").eqNullSafe(F.col(f"b__{c}"))
    change = F.when(F.col("__b").isNull(), "insert").when(F.col("__a").isNull(), "delete").when(~F.col("from_section").eqNullSafe(F.col("to_section")) | (F.col("from_rank") != F.col("to_rank")), "move").when(~same, "update")
    out = rows.select(F.coalesce("__b", "__a").alias("id"), change.alias("change"), "from_section", "from_rank", "to_section", "to_rank")
    return out.where(F.col("change").isNotNull())


class LiveQuery:
    """A request run anew on each state of a store; the predicate is tested every time."""

    def __init__(self, request: Request, section: str, order: list) -> None:
        self.request, self.section, self.order, self.last = request, section, order, None

    def refresh(self, store: Store) -> DataFrame:
        """The moves since the last refresh; the first one inserts all rows."""
        now = ranked(fetch(store, self.request), self.order, self.section)
        was, self.last = self.last, now
        return moves(was if was is not None else now.where(F.lit(False)), now)
