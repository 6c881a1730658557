"""Tables, the folder that all executors share, joins that spare hot groups, and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session gets one of its own, any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='orrery-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def ship(spark: SparkSession) -> None:
    """Lets the executors import this package, however the driver found it."""
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_orrery_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="orrery-")) / f"{top.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(out))
    context._orrery_shipped = True


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow(), where the executors can import what function refers to."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def _run_dir(spark: SparkSession) -> str:
    """A folder of this run's own below the shared one."""
    if not getattr(spark.sparkContext, "_orrery_run", None):
        spark.sparkContext._orrery_run = uuid.uuid4().hex
    return f"{shared_dir(spark)}/orrery/{spark.sparkContext._orrery_run}"


def scratch(spark: SparkSession, what: str) -> str:
    return f"{_run_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read again from Parquet in the shared folder; this cuts its lineage.

    The files outlive lost executors. They stay until the caller removes the folder or calls forget().
    """
    ship(df.sparkSession)
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Removes what written() has left in this run; results that still read it become unusable. Other runs keep theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Words of an id filter at most: 1024 of 4 KB, so 4 MB whatever the number of ids.
FILTER_WORDS = 1024
#: A group with more than this part of all rows is joined by broadcast; there are fewer such groups than its reciprocal.
HOT_SHARE = 1 / 1024
#: Bytes of a join's side up to which Spark may choose to broadcast it.
FEW_BYTES = 16 << 20
#: Bytes of a row that names a group, in a hashed table.
BYTES_A_GROUP = 128


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(FILTER_WORDS * 32768))


def split_by_ids(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose key is surely not among ids (their first column), and the others.

    ids become a bit each in a filter of 4 MB at most, which every task tests its rows against where they
    are read, so that only the second part need be shuffled. Both parts keep the columns of rows. Null keys
    fall into the second part.
    """
    at, bit = F.col("__at"), F.col("__at") % 32768
    places = ids.select(_place(F.col(ids.columns[0])).alias("__at")).where("__at IS NOT NULL")
    words = places.groupBy(F.floor(at / 32768).alias("__word")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    words = written(words, "id-filter")
    named = rows.select(F.struct("*").alias("__row"), F.coalesce(_place(key), F.lit(-1)).alias("__at")).withColumn("__word", F.floor(at / 32768))
    tested = named.join(F.broadcast(words), "__word", "left")  # FILTER_WORDS rows at most
    octet = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = octet.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0
    maybe = (at < 0) | F.coalesce(held, F.lit(False))
    return tested.where(~maybe).select("__row.*"), tested.where(maybe).select("__row.*")


def without_ids(rows: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """rows whose id is not among gone (its first column); only rows that may be among them are shuffled. Null ids stay."""
    rest, maybe = split_by_ids(rows, F.col(id_col), gone)
    named = gone.select(F.col(gone.columns[0]).alias("__gone")).distinct()
    return rest.unionByName(maybe.join(named, maybe[id_col] == F.col("__gone"), "left_anti"))


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of their group, an inner join by key; size is the number of rows of each group.

    Groups with more than HOT_SHARE of all rows, 1023 at most, meet their rows by broadcast, so that no task
    gets a large group; all others meet by shuffle. rows and groups are each read twice.
    """
    total, n = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    hot = groups.where(F.col(size) > total * HOT_SHARE)
    cold = sized(groups.where(F.col(size) <= total * HOT_SHARE), n * BYTES_A_GROUP)
    large = rows.join(F.broadcast(hot), key)
    small = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return large.unionByName(small.select(*large.columns))


def sized(side: DataFrame, size: int) -> DataFrame:
    """side of a join, of about so many bytes in memory, which is not broadcast where that is more than FEW_BYTES.

    Spark goes by the size of files, and by that of the rows below an explode(), so that it may send the
    driver a table many times as large as it thinks.
    """
    return side if size <= FEW_BYTES else side.hint("merge")


def spread(df: DataFrame, rows_a_part: int) -> int:
    """How many parts df needs at so many rows each."""
    return max(1, -(-df.count() // rows_a_part))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node of edges reaches; nodes of any orderable type.

    Alternating large-star and small-star rounds: each node hands its neighbours to the smallest one
    around, until every edge points at the root of its component. The rows never outnumber the edges
    twice, nothing goes to the driver, and each round is written before the next reads it. A round has
    few shuffles, since the driver keeps a record of each of their tasks, and none follows the last change.
    Null ends and loops are ignored; no edges give no rows.
    """
    big, small = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = written(edges.where(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = now.join(least, "v").select("u", F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        moved = large.join(lower, "u").select(F.explode(ends).alias("edge")).select("edge.*").where("u != v")
        now = written(moved.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node of edges (u, v) is the u of two of them, or of one and the v of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(edges.select("v", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return found.agg(F.max(F.when(F.col("ups") > 0, F.col("ups") + F.col("downs")))).first()[0] in (None, 1)
