"""Exact duplicates through a log-structured merge index of text digests.

Documents arrive in batches. Each task's digests of a batch are a memtable, which is flushed as a sorted
part of the batch's run, and every run gets a Bloom filter of its own. Before a flush, the batch is looked
up in the runs that are there: only digests that pass a run's filter are joined with it, and what is found
is folded into the new entry, which from then on stands for the older ones. When a level holds `fanout`
runs, compaction merges them into one run of the next level and keeps the smallest identifier of each
digest. Every hit (a row whose digest some other row keeps) is compared byte by byte with the kept text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import joined_to_groups, scratch, split_by_ids, written

#: Hits that one copy of a kept text is compared with; larger groups get more copies.
HITS_A_COPY = 512
#: Digests for each 64-bit word of a run's filter; each sets two of the word's bits.
DIGESTS_A_WORD = 6


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _bits(digest: Column) -> Column:
    """The two bits of a digest in its word of a filter."""
    h = F.xxhash64(digest, F.lit("bits"))
    one, two = F.pmod(h, F.lit(64)).cast("int"), F.pmod(F.shiftright(h, 6), F.lit(64)).cast("int")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    return bit(one).bitwiseOR(bit(two))


class DigestIndex:
    """Sorted runs of (digest, first, n) by level; first is the smallest (no id, id, row) of a digest, n its rows.

    A digest may stand in several runs: the one of the last batch counts, as it has taken in the older ones.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 3) -> None:
        self.spark, self.path, self.fanout, self.flushed = spark, path, fanout, 0
        self.levels: list[list[dict]] = []
        self.schema = None

    def _read(self, run: dict) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(run["path"])

    def _flush(self, rows: DataFrame, level: int, batch: int) -> None:
        """Writes rows as a run of a level, each task's digests in order, and the run's filter."""
        self.flushed += 1
        run = {"path": f"{self.path}/level{level}-{self.flushed}", "filter": f"{self.path}/filter-{self.flushed}", "batch": batch}
        self.schema = rows.schema
        rows.sortWithinPartitions("digest").write.parquet(run["path"])
        digests = self._read(run).select("digest")
        run["n"] = digests.count()
        run["words"] = max(1, -(-run["n"] // DIGESTS_A_WORD))
        word = F.pmod(F.xxhash64("digest"), F.lit(run["words"]))
        digests.groupBy(word.alias("word")).agg(F.bit_or(_bits(F.col("digest"))).alias("bits")).write.parquet(run["filter"])
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def find(self, digests: DataFrame, run: dict) -> DataFrame:
        """The entries of a run for those of digests that it holds; what fails its filter is not joined with it."""
        known = self.spark.read.schema("word bigint, bits bigint").parquet(run["filter"])
        asked = digests.select("digest", F.pmod(F.xxhash64("digest"), F.lit(run["words"])).alias("word"), _bits(F.col("digest")).alias("mask"))
        passed = asked.join(known, "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("digest")
        return self._read(run).join(passed, "digest", "left_semi")

    def append(self, entries: DataFrame) -> None:
        """Takes in a batch of (digest, id, row)."""
        first = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "row")).alias("first")
        new = entries.groupBy("digest").agg(first, F.count("*").alias("n"))
        runs = [run for level in self.levels for run in level]
        if runs:
            new = written(new, "memtables")
            # Of a digest's entries in several runs, the one of the last batch counts.
            found = [self.find(new, run).select("digest", F.struct(F.lit(run["batch"]).alias("batch"), "first", "n").alias("was")) for run in runs]
            older = found[0]
            for part in found[1:]:
                older = older.unionByName(part)
            older = older.groupBy("digest").agg(F.max_by("was", F.col("was.batch")).alias("was"))
            both = new.join(older, "digest", "left")
            new = both.select("digest", F.least("first", "was.first").alias("first"), (F.col("n") + F.coalesce("was.n", F.lit(0))).alias("n"))
        batch = self.flushed
        self._flush(new, 0, batch)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._merge(self.levels[level], level + 1)
            self.levels[level] = []
            level += 1

    def _merge(self, runs: list[dict], level: int) -> None:
        rows = None
        for run in runs:
            part = self._read(run).withColumn("batch", F.lit(run["batch"]))
            rows = part if rows is None else rows.unionByName(part)
        merged = rows.groupBy("digest").agg(F.min("first").alias("first"), F.max_by("n", "batch").alias("n"))
        self._flush(merged, level, max(run["batch"] for run in runs))

    def compact(self) -> DataFrame:
        """Merges all runs into one and returns its (digest, first, n)."""
        runs = [run for level in self.levels for run in level]
        if len(runs) > 1:
            self._merge(runs, len(self.levels))
            self.levels = [[], self.levels[-1]]
        return self._read(self.levels[-1][-1])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one space; null is empty.
    The smallest id stays; null ids come after all others; of repeated rows with one id a single one
    stays. An empty table gives no rows. Other columns of docs are not read. The table is taken in as so
    many batches, dealt by a hash of the rows.
    """
    spark, text = docs.sparkSession, normalised(F.col(text_col))
    entries = written(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    index = DigestIndex(spark, scratch(spark, "lsm"))
    for b in range(batches):
        index.append(entries.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == b))
    groups = index.compact()
    placed = joined_to_groups(entries, groups, "digest", "n").select("id", "digest", "row", "first", "n")

    # The hits' texts against the kept one of their group, which is copied for every so many of them.
    several = written(placed.where("n > 1").groupBy("id", "digest").agg(F.min("row").alias("row"), F.first("first").alias("first"), F.first("n").alias("n")), "hits")
    _, texts = split_by_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), F.col("id"), several.select("id"))
    texts = texts.select("id", normalised(F.col("text")).alias("body"))
    same = F.col("t.id").eqNullSafe(F.col("s.id")) & (F.unhex(F.sha2(F.col("t.body"), 256)) == F.col("s.digest"))
    members = texts.alias("t").join(several.alias("s"), same).select("s.*", "t.body").withColumn("copies", F.ceil(F.col("n") / HITS_A_COPY))
    kept = members.where("row = first.row").select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")).dropDuplicates(["digest", "copy"])
    hits = members.where("row <> first.row").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")))
    strays = written(hits.join(kept, ["digest", "copy"]).where(F.col("body").cast("binary") != F.col("kept_body").cast("binary")).select("digest", "id", "row", "body").distinct(), "strays")
    if not strays.isEmpty():  # texts that share a SHA-256 without being equal form groups of their own
        placed = _apart(placed, strays)
    return placed.select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _apart(placed: DataFrame, strays: DataFrame) -> DataFrame:
    """placed with groups by (digest, text) for the rows that strays lists by (digest, id)."""
    named = strays.select("digest", "id", F.sha2(F.concat(F.lit("stray"), "body"), 512).alias("part")).distinct()
    same = placed["digest"].eqNullSafe(named["digest"]) & placed["id"].eqNullSafe(named["id"])
    rows = placed.join(named, same, "left").select(placed["id"], placed["digest"], placed["row"], F.coalesce("part", F.lit("")).alias("part"))
    groups = rows.groupBy("digest", "part").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "row")).alias("first"), F.count("*").alias("n"))
    return rows.join(groups, ["digest", "part"]).select("id", "digest", "row", "first", "n")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Only rows whose id some dropped or repeated row has are shuffled."""
    found = written(exact_duplicates(docs, id_col, text_col), "exact")
    kept = found.where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    sure, maybe = split_by_ids(docs, F.col(id_col), found.where("NOT kept").select(id_col))
    rows = maybe.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))
    stay = rows.join(kept, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__sha")), "left_semi")
    if not found.groupBy(id_col, "text_sha256").count().where("count > 1").isEmpty():  # repeated rows
        stay = stay.dropDuplicates(["id", "digest"])
    return sure.unionByName(stay.select("row.*"))
