"""Near-duplicate detection with 64-bit SimHash fingerprints.

Fingerprints of text copies collapse before any join, so a group of copies costs one row. Two
fingerprints with at most `distance` differing bits have at most distance // 2 of them in one of their
halves. Each half is embedded as the bit counts of its segments, four of two bits and twenty-four of one;
the Manhattan distance of two such points never exceeds the Hamming distance of the halves, so links lie
in equal or neighbouring cells of the unit grid. One equi-join on the cell finds the candidates, an exact
bit count over both halves decides. Points one step apart differ in the parity of their sum, so only
points of even parity look into neighbouring cells. Narrow segments keep cells small: of random
fingerprints one pair in 10^9 shares a cell, where segments of two bits throughout would leave one in 10^7.

A few bits are no measure of similarity: texts that share 0.8 of their shingles differ in 10 of 64 bits on
average, with a deviation of 3, and pieces of 64 bits small enough for that radius let a good part of all
pairs through. without_near_copies() therefore adds, to the pairs within `distance`, every pair that shares
a shingle of its prefixes: of two sets of Jaccard similarity t or more, sorted by one order of all
shingles, the first m - ceil(t * m) + 1 of each (of its m) have one in common, so no such pair is lost.
The order puts frequent shingles last. Sets of m1 <= m2 shingles share t / (1 + t) * (m1 + m2) of them at
least, and all they share follows the first one that they share: so only pairs meet of which each has
that many left at the place of the shingle. Lists are dealt by classes of the smaller set's size, so that
each text can tell alone whether it has, and families of texts that are not similar make no pairs.
A pair is first held to its sketches: a bit is set for every value
of a hash that some shingle has, so that two sketches differ in no more bits than the sets do in shingles.
The texts of all pairs that pass are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BYTES_A_GROUP, components, joined_to_groups, mapped, sized, split_by_ids, without_ids, written

SEED = 42
#: Words of 64 bits in a sketch.
SKETCH = 32
#: Fingerprints whose cells one task lists.
FPS_A_TASK = 20_000
#: Bytes of the rows that a fingerprint's looks take: 32 cells on average, a row of three numbers each.
BYTES_LOOKED = 32 * 32
#: Two-bit segments of a 32-bit half; its other segments have one bit.
PAIRS = 4
#: Logarithm of the sizes' ratio within a class of sizes.
CLASS = 0.04


def grams(text: str | None, shingle: int) -> list[bytes]:
    """The shingles of a text in lower case; all its words where they are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and \x20 \x09-\x0D only
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def _digests(some: list[bytes]) -> np.ndarray:
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(g, seed) for g in some], dtype="<u8")


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit i is set where more than half of the shingles' XXH64 have it; 0 without words."""
    return _majority(_digests(grams(text, shingle)))


def _majority(hashes: np.ndarray) -> int:
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): a signed 64-bit fingerprint for every row, over its whole text; null counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return mapped(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp bigint")


def _counts(fp: Column, half: int) -> Column:
    """The bit counts of a half's segments, each in its segment's own bits; bit 32 tells the halves apart."""
    x = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return x - F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555 & (1 << 2 * PAIRS) - 1)) + F.lit(half << 32)


def _steps(cell: Column) -> Column:
    """The cells one Manhattan step away."""
    field = lambda i: F.shiftrightunsigned(cell, 2 * i).bitwiseAND(F.lit(3))
    up = [F.when(field(i) < 2, cell + F.lit(1 << 2 * i)) for i in range(PAIRS)]
    down = [F.when(field(i) > 0, cell - F.lit(1 << 2 * i)) for i in range(PAIRS)]
    single = [cell.bitwiseXOR(F.lit(1 << i)) for i in range(2 * PAIRS, 32)]
    return F.array_compact(F.array(*up, *down, *single))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): all pairs of different fingerprints in column fp with at most `distance` differing bits.

    distance is 0 to 3, so that one half differs in at most one bit. Nulls take no part.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves cover distances from 0 to 3")
    own = fps.select("fp").where("fp is not null").distinct()
    n = own.count()
    own = own.repartition(max(1, -(-n // FPS_A_TASK)), "fp")
    homes = own.select("fp", F.explode(F.array(*(_counts(F.col("fp"), h) for h in (0, 1)))).alias("cell"))
    bits = F.bit_count(F.col("fp").bitwiseAND(F.when(F.col("cell") < (1 << 32), F.lit(0xFFFFFFFF)).otherwise(F.lit(-1 << 32))))
    seen = F.when(bits % 2 == 0, F.concat(F.array("cell"), _steps(F.col("cell")))).otherwise(F.array("cell"))
    looks = homes.select(F.col("fp").alias("other"), F.col("cell").alias("from"), F.explode(seen).alias("cell"))
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    once = (F.col("from") != F.col("cell")) | (F.col("other") < F.col("fp"))
    near = homes.join(sized(looks, n * BYTES_LOOKED), "cell").where((F.col("fp") != F.col("other")) & (differ <= distance) & once)
    return near.select(F.least("other", "fp").alias("a"), F.greatest("other", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, fp, component_id (the smallest id reachable over links), n_links.

    n_links counts the other fingerprints that this document's own links to. Null texts are empty
    (fingerprint zero), null ids keep their row and never name a component unless all its ids are null.
    Repeated rows are returned as often as given. Other columns of docs are not read.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    groups = written(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "prints")
    pairs = written(links(groups, distance), "links")
    degree = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(pairs, "a", "b").select(F.col("node").alias("fp"), "root")
    known = groups.join(roots, "fp", "left").join(degree, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = written(known, "groups")
    named = sized(known, known.count() * BYTES_A_GROUP).join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "n", "component_id", "n_links")
    return joined_to_groups(fps, written(named, "named"), "fp", "n").select(id_col, "fp", "component_id", "n_links")


def _frequent(docs: DataFrame, shingle: int, text_col: str, max_rows: int = 100_000, max_grams: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """(digests in order, how often) of shingles found in several of about max_rows texts; only the order of prefixes rests on it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_digests(grams(t.as_py(), shingle))).view("<i8"))], names=["gram"])

    total = docs.count()
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    if total > max_rows:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))
    seen = mapped(texts, each, "gram bigint").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    rows = seen.orderBy(F.desc("n"), "gram").limit(max_grams).toArrow()
    known, n = rows.column("gram").to_numpy().view("<u8"), rows.column("n").to_numpy()
    order = known.argsort()
    return known[order], n[order]


def _sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(SKETCH * 64, np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(SKETCH * 64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): h is a hash of the text, so that id and h name a text without carrying it."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _prefixed(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, h, fp, m, prefix, sketch, node): each row with its fingerprint, its number of shingles, its prefix, its sketch and a number."""
    known, often = _frequent(docs, shingle, text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, prefixes, sketches = [], [], [], []
            for t in b.column(2):
                hashes = _digests(grams(t.as_py(), shingle))
                fps.append(_majority(hashes))
                own = np.unique(hashes) if len(hashes) else np.zeros(1, "<u8")  # texts without words are alike
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, often[at], 0)
                keep = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
                sizes.append(len(own))
                prefixes.append(own[np.lexsort((own, rank))[:keep]].view("<i8"))
                sketches.append(_sketch(own))
            columns = [b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "fp", "m", "prefix", "sketch"])

    rows = _keyed(docs, id_col, text_col)
    found = mapped(rows, each, f"id {rows.schema[0].dataType.simpleString()}, h bigint, fp bigint, m int, prefix array<bigint>, sketch array<bigint>")
    return written(found.withColumn("node", F.monotonically_increasing_id()), "prefixes")


def _likely(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose sketches do not rule the similarity out.

    Sets of similarity t differ in (1 - t) / (1 + t) of their sizes' sum at most.
    """
    one = rows.select(F.col("node").alias("a"), F.col("m").alias("m1"), F.col("sketch").alias("s1"))
    two = rows.select(F.col("node").alias("b"), F.col("m").alias("m2"), F.col("sketch").alias("s2"))
    differ = F.aggregate(F.zip_with("s1", "s2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    bound = (F.col("m1") + F.col("m2")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return written(pairs.join(one, "a").join(two, "b").where(differ <= bound).select("a", "b"), "likely-pairs")


def _similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the pairs whose sets of shingles have the Jaccard similarity, compared by the shingles themselves.

    docs are _keyed(); only the texts of rows that stand in a pair are fetched.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for b in batches:
            alike = []
            for node, one, two in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if node != last:
                    last, known = node, set(grams(one.as_py(), shingle))
                other = set(grams(two.as_py(), shingle))
                both = len(known & other)
                every = len(known) + len(other) - both
                alike.append(not every or both / every >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    likely = _likely(pairs, rows, similarity)
    nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    wanted = written(rows.select("node", "id", "h").join(nodes, "node", "left_semi"), "wanted")
    _, near = split_by_ids(docs, F.col("id"), wanted.select("id"))
    same = near["id"].eqNullSafe(wanted["id"]) & (near["h"] == wanted["h"])
    texts = written(near.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "texts")  # rows may repeat
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # files of like texts are small
    one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("one")), texts.select(F.col("node").alias("b"), F.col("text").alias("two"))
    return written(mapped(likely.join(sized(two, size), "b").join(sized(one, size), "a").select("a", "b", "one", "two"), each, "a bigint, b bigint"), "similar")


def _meeting(rooted: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of nodes of different roots that may be similar, by rows (gram, node, m, place, root).

    place is that of the gram in the node's ordered set. A similar pair passes at the first gram that it shares.
    Roots meet by the sizes of their sets and the most that a set of this size has left, so that each row of
    a join is part of a pair that passes, but for the order of nodes of one size.
    """
    least = lambda m1, m2: (m1 + m2) * (similarity / (1 + similarity)) - 1e-6  # noqa: E731  what they must share
    size_class = lambda m: F.floor(F.log(m.cast("double")) / CLASS)
    m, left, must = F.col("m"), F.col("left"), least(F.col("m"), F.col("m2"))
    rooted = rooted.select("gram", "node", "m", (m - F.col("place")).alias("left"), "root")
    small = rooted.where(left >= least(m, m)).withColumn("class", size_class(m))
    classes = F.sequence(size_class(F.greatest(F.ceil(m * similarity - 1e-6), F.lit(1))), size_class(m))
    large = rooted.withColumn("class", F.explode(classes)).where(left >= least(m, F.exp(F.col("class") * CLASS) * (1 - 1e-9)))
    large = large.select("gram", "class", *(F.col(c).alias(f"{c}2") for c in ("node", "m", "left", "root")))
    small, large = written(small, "smaller-sets"), written(large, "larger-sets")
    one = small.groupBy("gram", "class", "root", "m").agg(F.max("left").alias("left"))
    two = large.groupBy("gram", "class", "root2", "m2").agg(F.max("left2").alias("left2"))
    sized = (m <= F.col("m2")) & (m >= F.col("m2") * similarity - 1e-6)
    ways = one.join(two, ["gram", "class"]).where((F.col("root") != F.col("root2")) & sized & (F.least("left", "left2") >= must))
    ways = ways.select("gram", "class", "root", "m", "root2", "m2")
    met = small.join(ways, ["gram", "class", "root", "m"]).where(left >= must).join(large, ["gram", "class", "root2", "m2"])
    met = met.where((F.col("left2") >= must) & ((m < F.col("m2")) | (F.col("node") < F.col("node2"))))
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _without_twins(rooted: DataFrame) -> DataFrame:
    """rooted with one list for all those of the same nodes, under a hash of the nodes; lists of a single root are left out.

    Of such lists a similar pair first shares the one that comes first, which is the same for all nodes.
    Where hashes of different lists collide, more pairs pass, and none is lost.
    """
    lists = rooted.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node")).alias("nodes"))
    listed = rooted.join(lists.where("low < high").select("gram", "nodes"), "gram")
    return listed.groupBy(F.col("nodes").alias("gram"), "node", "m", "root").agg(F.min("place").alias("place"))


def similar_groups(rows: DataFrame, docs: DataFrame, shingle: int, similarity: float, distance: int) -> DataFrame:
    """(node, root): what each node of _prefixed() reaches over pairs of the similarity; nodes without such a pair are left out.

    First each node meets one node of every list that it stands in, and fingerprints within `distance` meet.
    For a fingerprint that is its least node; for a shingle, the node with the fewest rarer shingles of its
    own, which is the least altered of a family. Then all pairs of a list meet that are not joined yet
    and that _meeting() does not rule out, root by root, so that a large group of near copies costs no
    square of its size.
    """
    posts = rows.select("node", "m", F.posexplode("prefix").alias("place", "gram"))
    whole = Window.partitionBy("gram")
    listed = posts.select("*", F.min(F.struct("place", "node", "m")).over(whole).alias("hub"), F.count("*").over(whole).alias("n"))
    shared = written(listed.where("n > 1").drop("n"), "shared-shingles")
    close = lambda x, y: (x >= y * similarity - 1e-6) & (y >= x * similarity - 1e-6)
    stars = shared.where((F.col("node") != F.col("hub.node")) & close(F.col("m"), F.col("hub.m"))).select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))
    prints = written(rows.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    same = rows.select("fp", "node").join(prints, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = links(prints, distance).join(prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    tried = written(stars.union(same).union(ends.select(F.least("x", "y"), F.greatest("x", "y"))).distinct(), "pairs")
    known = components(_similar(tried, rows, docs, shingle, similarity), "a", "b")
    rooted = shared.drop("hub").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(_without_twins(rooted), "rooted")
    rest = _meeting(rooted, similarity).distinct()
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    return components(known.union(_similar(rest, rows, docs, shingle, similarity)), "node", "root")


def without_near_copies(docs: DataFrame, shingle: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, but those that reach a smaller id over pairs of texts that share
    `similarity` of their shingles (Jaccard) or more. Rows without an id stay; rows that share an id go together."""
    rows = _prefixed(docs, shingle, similarity, id_col, text_col)
    found = similar_groups(rows, _keyed(docs, id_col, text_col), shingle, similarity, distance)
    named = written(rows.select("id", "node").join(found, "node"), "groups")
    kept = named.groupBy("root").agg(F.min("id").alias("component_id"))
    gone = named.join(kept, "root").where(F.col("id") != F.col("component_id")).select("id").distinct()
    return without_ids(docs, id_col, written(gone, "gone"))
