"""Mixing sources to target weights by Pfair scheduling.

Each source is a lane of blocks of `block_rows` documents, whatever the number of sources. In the ideal
mixture all lanes advance at once, each by its weight, until it runs out; from then on the others share by
their weights. Lane i of weight w has done min(blocks, w * v) at the moment v, so that slot
t(v) = sum of min(blocks, w * v) over the lanes is reached. Block k is released at slot floor(t(k / w)) and
due at ceil(t((k + 1) / w)). In every slot the released block with the earliest deadline goes next: every
slot's share of the ideal is whole, so all deadlines hold, and no lane ever deviates from its target by a
whole block. Weights are not rounded.

The slots are dealt in stretches of STRETCH, all at once: which blocks are done when a stretch starts is
first guessed (those due, and of those begun the ones that are due first), then each stretch is dealt,
and every stretch that does not start where the one before it ends is dealt again from there, until all
agree. The first stretch starts from nothing, so what they then agree on is the schedule from slot to slot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .shared import sized, written

#: Rows of a lane that are numbered together in one window, and buckets of a lane that are added up together.
ROWS_A_BUCKET, BUCKETS_A_SUM = 1024, 1024
#: Bytes of a row of a block.
BYTES_A_BLOCK = 48
#: A list of so many sources at most is sent to the rows; with more, rows and sources meet by shuffle.
FEW_SOURCES = 100_000
#: Slots of a stretch, and slots whose blocks are listed before they are added to the stretch's list.
STRETCH, RUN = 4096, 64
#: A slot's bound this close to a whole number counts as that number.
CLOSE = 1e-7


def lanes(docs: DataFrame, source_col: str, weights: dict | None, power: float) -> list[Row]:
    """(source, n, weight), heaviest first: a lane for each source, by weights given, or the number of documents to the given power."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        counts = counts.withColumn("weight", F.coalesce(F.element_at(given, F.col("source").cast("string")), F.lit(0.0)).cast("double"))
    else:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    return counts.withColumn("weight", F.greatest("weight", F.lit(0.0))).orderBy(F.desc("weight"), F.asc_nulls_first("source")).collect()


class _Lanes:
    """Columns over the lanes' weights and blocks, all weights above 0."""

    def __init__(self, weights: list[float], blocks: list[int]) -> None:
        self.size = len(weights)
        self.all = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(n).cast("bigint").alias("n")) for w, n in zip(weights, blocks)))
        # From each moment at which a lane runs out to the next: (slot, moment, weight of the lanes left).
        ends = sorted((n / w, w) for w, n in zip(weights, blocks))
        left, slot, moment, legs = sum(weights), 0.0, 0.0, []
        for end, w in ends:
            legs.append((slot, moment, left))
            slot, moment, left = slot + (end - moment) * left, end, max(left - w, 0.0)
        self.legs = F.array(*(F.struct(F.lit(t).alias("slot"), F.lit(v).alias("v"), F.lit(r).alias("rate")) for t, v, r in legs))

    def slot(self, v: Column) -> Column:
        """t(v)."""
        return F.aggregate(self.all, F.lit(0.0), lambda t, lane: t + F.least(lane["n"].cast("double"), lane["w"] * v))

    def block(self, lane: Column, k: Column) -> Column:
        """Block k of a lane: its number, whether the lane has it, its release and its deadline."""
        release = F.floor(self.slot(k / lane["w"]) + CLOSE)
        due = F.ceil(self.slot((k + 1) / lane["w"]) - CLOSE)
        return F.struct(k.alias("k"), (k < lane["n"]).alias("left"), release.alias("release"), due.alias("due"))

    def guess(self, slot: Column) -> Column:
        """How many blocks of each lane are likely done when so many slots are."""
        leg = F.element_at(F.filter(self.legs, lambda x: x["slot"] <= slot), -1)
        moment = leg["v"] + (slot - leg["slot"]) / F.greatest(leg["rate"], F.lit(1e-300))
        return F.transform(self.all, lambda lane: F.floor(F.least(lane["n"].cast("double"), lane["w"] * moment) + CLOSE))

    def start(self, slot: Column) -> Column:
        """guess() made whole: of the blocks begun, those due first are done, as many as slots are left for."""

        def made_whole(whole: Column) -> Column:
            missing = slot - F.aggregate(whole, F.lit(0).cast("bigint"), lambda a, n: a + n)
            begun = F.filter(F.zip_with(F.sequence(F.lit(0), F.lit(self.size - 1)), F.zip_with(self.all, whole, self.block), lambda i, b: F.struct(b["left"].alias("left"), b["due"].alias("due"), i.alias("lane"))), lambda x: x["left"])
            chosen = F.transform(F.slice(F.array_sort(begun), F.lit(1), F.greatest(missing, F.lit(0)).cast("int")), lambda x: x["lane"])
            return _let(chosen, lambda some: F.transform(whole, lambda n, i: n + F.array_contains(some, i).cast("bigint")))

        return _let(self.guess(slot), made_whole)

    def deal(self, first: Column, slots: Column, start: Column) -> Column:
        """(at, dealt): how many blocks of each lane are done in the end, and (lane, block) of each slot from first on."""
        state_type = "struct<at:array<struct<k:bigint,left:boolean,release:bigint,due:bigint>>,dealt:array<struct<lane:int,block:bigint>>>"
        none = F.array().cast("array<struct<lane:int,block:bigint>>")

        def step(state: Column, now: Column) -> Column:
            # A released block before any other, then by deadline, then by lane.
            key = lambda b, i: F.struct(F.when(~b["left"], 2).when(b["release"] <= now, 0).otherwise(1).alias("late"), F.when(b["release"] <= now, b["due"]).otherwise(b["release"]).alias("by"), b["due"].alias("due"), i.alias("lane"))
            pick = F.array_min(F.transform(state["at"], key))["lane"]

            def taken(own: Column, lane: Column) -> Column:
                after = F.transform(own["at"], lambda b, i: F.when(i == lane, self.block(F.get(self.all, i), b["k"] + 1)).otherwise(b))
                one = F.struct(lane.alias("lane"), F.get(own["at"], lane)["k"].alias("block"))
                return F.struct(after.alias("at"), F.concat(own["dealt"], F.array(one)).alias("dealt")).cast(state_type)

            return F.aggregate(F.array(pick), state, taken)

        def run(state: Column, at: Column) -> Column:
            own = F.struct(state["at"].alias("at"), none.alias("dealt")).cast(state_type)
            dealt = F.aggregate(F.sequence(at, F.least(at + RUN, first + slots) - 1), own, step)
            return F.aggregate(F.array(dealt), state, lambda s, r: F.struct(r["at"].alias("at"), F.concat(s["dealt"], r["dealt"]).alias("dealt")).cast(state_type))

        nothing = F.struct(F.zip_with(self.all, start, self.block).alias("at"), none.alias("dealt")).cast(state_type)
        ended = F.aggregate(F.sequence(first, first + slots - 1, F.lit(RUN).cast("bigint")), nothing, run)
        return _let(ended, lambda e: F.struct(F.transform(e["at"], lambda b: b["k"]).alias("at"), e["dealt"].alias("dealt")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def schedule(spark: SparkSession, weights: list[float], blocks: list[int]) -> DataFrame:
    """(lane, block, slot) of every block. A lane of weight 0 follows when all others have run out."""
    kept = [(w, n, i) for i, (w, n) in enumerate(zip(weights, blocks)) if w > 0 and n > 0]
    total, parts = sum(n for _, n, _ in kept), []
    if kept:
        some, first = _Lanes([w for w, _, _ in kept], [n for _, n, _ in kept]), F.col("stretch") * STRETCH
        slots = F.least(F.lit(STRETCH).cast("bigint"), F.lit(total).cast("bigint") - first)
        count = -(-total // STRETCH)
        rows = spark.range(0, count, 1, min(count, 4096)).select(F.col("id").alias("stretch")).withColumn("start", some.start(first))
        run = written(rows.withColumn("end", some.deal(first, slots, F.col("start"))).select("stretch", "start", "end.at", "end.dealt"), "stretches")
        while True:
            before = run.select((F.col("stretch") + 1).alias("stretch"), F.col("at").alias("due_start"))
            wrong = written(run.select("stretch", "start").join(before, "stretch").where("start != due_start").select("stretch", F.col("due_start").alias("start")), "wrong-starts")
            if wrong.isEmpty():
                break
            again = wrong.withColumn("end", some.deal(first, slots, F.col("start"))).select("stretch", "start", "end.at", "end.dealt")
            run = written(run.join(wrong.select("stretch"), "stretch", "left_anti").unionByName(again), "stretches")
        names = F.array(*(F.lit(i) for _, _, i in kept))
        dealt = run.select("stretch", F.posexplode("dealt").alias("place", "of"))
        parts.append(dealt.select(F.get(names, F.col("of.lane")).alias("lane"), F.col("of.block").alias("block"), (first + F.col("place")).alias("slot")))
    for i, (w, n) in enumerate(zip(weights, blocks)):
        if w <= 0 and n:
            parts.append(spark.range(n).select(F.lit(i).alias("lane"), F.col("id").alias("block"), (F.col("id") + total).alias("slot")))
            total += n
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "lane int, block bigint, slot bigint")


def _offsets(counts: DataFrame) -> DataFrame:
    """(lane, bucket, size, offset): the rows of a lane in the buckets before, added up within groups of buckets and over the groups."""
    counts = counts.withColumn("part", F.floor(F.col("bucket") / BUCKETS_A_SUM))
    ahead = lambda *by: Window.partitionBy("lane", *by).orderBy("bucket" if by else "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("lane", "part").agg(F.sum("size").alias("size"))
    base = sums.select("lane", "part", F.coalesce(F.sum("size").over(ahead()), F.lit(0)).alias("base"))
    inside = counts.select("lane", "part", "bucket", "size", F.coalesce(F.sum("size").over(ahead("part")), F.lit(0)).alias("inside"))
    return inside.join(base, ["lane", "part"]).select("lane", "bucket", "size", (F.col("base") + F.col("inside")).alias("offset"))


def _placed(docs: DataFrame, weights: dict | None, power: float, block_rows: int, source_col: str, id_col: str) -> DataFrame:
    """(row, lane, slot, position); row is a struct of all columns of docs, so that their names never clash."""
    spark, table = docs.sparkSession, lanes(docs, source_col, weights, power)
    weight, n = [r["weight"] for r in table], [r["n"] for r in table]
    own = sum(w > 0 for w in weight)
    lane = [min(i, own) for i in range(len(table))]  # sources of weight 0 share the last one
    sizes = n[:own] + ([sum(n[own:])] if own < len(n) else [])
    kind = docs.schema[source_col].dataType.simpleString()
    named = spark.createDataFrame([(r["source"], i, sizes[i]) for r, i in zip(table, lane)], f"source {kind}, lane int, lane_n bigint")
    named = F.broadcast(named) if len(table) <= FEW_SOURCES else named
    odd = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())  # so that rows without an id spread
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("of"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.lit("mix"), odd).alias("h"))
    rows = rows.join(named, F.col("of").eqNullSafe(F.col("source")))
    rows = rows.select("row", "id", "h", "lane", F.pmod(F.col("h"), F.ceil(F.col("lane_n") / ROWS_A_BUCKET)).alias("bucket"))
    counts = rows.groupBy("lane", "bucket").agg(F.count("*").alias("size"))
    # The slots of each bucket's blocks, so that rows meet them where their bucket is numbered.
    offsets = written(_offsets(counts), "offsets")
    blocks = offsets.select("lane", "bucket", F.explode(F.sequence(F.floor(F.col("offset") / block_rows), F.floor((F.col("offset") + F.col("size") - 1) / block_rows))).alias("block"))
    in_lane = [-(-x // block_rows) for x in sizes]
    dealt = sized(blocks, sum(in_lane) * BYTES_A_BLOCK).join(schedule(spark, weight[:own] + [0.0] * (len(sizes) - own), in_lane), ["lane", "block"])
    slots = dealt.groupBy("lane", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("slots"))
    places = written(offsets.join(slots, ["lane", "bucket"]).select("lane", "bucket", "offset", "slots"), "places")
    inside = Window.partitionBy("lane", "bucket").orderBy("h", "id")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1).join(places, ["lane", "bucket"])
    seq = F.col("offset") + F.col("place")
    slot = F.get("slots", (F.floor(seq / block_rows) - F.floor(F.col("offset") / block_rows)).cast("int"))
    return rows.select("row", "lane", slot.alias("slot"), (slot * block_rows + seq % block_rows).alias("position"))


def mixed(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block_rows: int = 32, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with lane, slot (of the row's block) and position; sorting by position gives the mixture.

    All rows stay: a source that runs out leaves its slots to the others. Positions are unique; they skip
    values only at the last, smaller block of a lane. Null is a source of its own. Within a lane, rows
    follow a hash of their id, then the id; rows of one id follow each other in any order. Sources given
    weight 0, and those that are not named, share the last lane and come last. Columns of docs that are
    named lane, slot or position give way to the new ones. No rows give none.
    """
    names = [f"row.`{c}`" for c in docs.columns if c.lower() not in ("lane", "slot", "position")]
    return _placed(docs, weights, power, block_rows, source_col, id_col).select(*names, "lane", "slot", "position")


def in_order(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block_rows: int = 32, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, sorted into the mixture; parts hold ranges of positions."""
    return _placed(docs, weights, power, block_rows, source_col, id_col).orderBy("position").select("row.*")
