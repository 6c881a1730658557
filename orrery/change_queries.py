"""Registered queries over changes: writes, conflicts, history, live results, set operations, migration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.model import Attribute as A
from orrery.model import Entity, Model, Store
from orrery.model import Relationship as R
from orrery.operators import changes, conflicts
from orrery.operators.expressions import expression
from orrery.plans import migration
from orrery.plans.compiler import fetch
from orrery.plans.request import Request
from orrery.semantic import store
from orrery.sources import tables
from orrery.sources.tables import fetch_all
from orrery.streaming import history, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def made(sql: str) -> Callable:
    """Registers a function of a store under its name."""

    def keep(function: Callable[[Store], DataFrame]) -> Callable:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(store(spark, sf_dir))
        SQL[function.__name__] = sql
        return function

    return keep


P = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


@made(f"SELECT {P} FROM part UNION ALL SELECT 1000001, 'new part', 'Brand#9', NULL, 5, 12.5 UNION ALL SELECT 1000002, NULL, NULL, NULL, NULL, NULL")
def batch_insert(s: Store) -> DataFrame:
    return changes.batch_insert(s, "Part", [{"p_partkey": 1000001, "p_name": "new part", "p_brand": "Brand#9", "p_size": 5, "p_retailprice": 12.5}, {"p_partkey": 1000002}]).table("part")


@made(f"SELECT {P} FROM part UNION ALL SELECT (SELECT max(p_partkey) + 1 FROM part), 'only one', NULL, NULL, NULL, NULL")
def batch_insert_allotted(s: Store) -> DataFrame:
    return changes.batch_insert(s, "Part", lambda: iter([{"p_name": "only one"}])).table("part")


@made("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' ELSE p_type END AS p_type FROM part")
def batch_update_const(s: Store) -> DataFrame:
    return changes.batch_update(s, "Part", {"type": "large"}, "size > 40").table("part").select("p_partkey", "p_type")


@made("SELECT c_custkey, CASE WHEN n_name = 'NATION_1' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN n_name = 'NATION_1' THEN c_mktsegment ELSE c_name END AS c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def batch_update_expr(s: Store) -> DataFrame:
    out = changes.batch_update(s, "Customer", {"balance": expression("add:to:(balance, 100)"), "name": expression("segment")}, 'nation.name == "NATION_1"')
    return out.table("customer").select("c_custkey", "c_acctbal", "c_name")


@made("SELECT event_id, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 0.0 ELSE value END AS value FROM events")
def batch_update_branch(s: Store) -> DataFrame:
    return changes.batch_update(s, "CommerceEvent", {"value": 0.0}).table("events").select("event_id", "event_type", "value")


@made("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def batch_delete(s: Store) -> DataFrame:
    return changes.batch_delete(s, "Order", "ANY lineitems.quantity > 45").table("orders").select("o_orderkey")


@made("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) <> 1")
def batch_delete_null_stays(s: Store) -> DataFrame:
    return changes.batch_delete(s, "Document", "label.quality == 1").table("documents").select("doc_id")


@made("SELECT event_id FROM events WHERE NOT (event_type = 'click' AND value < 10)")
def batch_delete_leaf(s: Store) -> DataFrame:
    return changes.batch_delete(s, "Click", "value < 10").table("events").select("event_id")


@made("SELECT count(*) AS count FROM part WHERE p_size > 40 AND p_type <> 'large'")
def batch_result_count(s: Store) -> DataFrame:
    return changes.matched(s, "Part", "size > 40", result="count")


@made("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name || '-b', s_acctbal FROM supplier WHERE s_suppkey % 3 = 1")
def upsert(s: Store) -> DataFrame:
    old = s.table("supplier")
    same = old.where("s_suppkey % 3 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 5_000_000).withColumn("s_acctbal", F.col("s_acctbal") + 1)
    first = same.withColumn("s_suppkey", F.col("s_suppkey") - 1).withColumn("s_acctbal", F.lit(-1.0))
    more = old.where("s_suppkey % 3 = 1").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000).withColumn("s_name", F.concat("s_name", F.lit("-b")))
    return changes.upsert(old, first.unionByName(same).unionByName(more), ("s_name",), "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


@made("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 100, 'added'")
def save_all(s: Store) -> DataFrame:
    rows = s.table("nation")
    add = rows.limit(1).select(F.lit(100).cast(rows.schema["n_nationkey"].dataType).alias("n_nationkey"), F.lit("added").alias("n_name"), "n_regionkey")
    out = changes.save(s, "Nation", add, rows.where("n_nationkey = 3").withColumn("n_name", F.lit("renamed")), rows.where("n_nationkey = 4").select("n_nationkey"))
    return out.table("nation").select("n_nationkey", "n_name")


@made("SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_totalprice >= 50000 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 50000)")
def delete_cascade(s: Store) -> DataFrame:
    out = changes.delete(s, "Order", "totalPrice < 50000")
    return _counts(out, "orders", "lineitem")


@made("SELECT 'region' AS t, count(*) AS n FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')")
def delete_cascade_deep(s: Store) -> DataFrame:
    return _counts(changes.delete(s, "Region", 'name == "ASIA"', check=False), "region", "nation", "customer")


def _counts(s: Store, *tables: str) -> DataFrame:
    parts = [s.table(t).agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@made("SELECT s_suppkey, CASE WHEN s_nationkey = 2 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier")
def delete_nullify(s: Store) -> DataFrame:
    return changes.delete(s, "Nation", "objectID == 2", check=False).table("supplier").select("s_suppkey", "s_nationkey")


@made("SELECT 'orders' AS relationship, c_custkey AS id FROM customer WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def deny_conflicts(s: Store) -> DataFrame:
    return changes.denials(s, "Customer", changes.matching(s, "Customer", "balance < 0"))


@made("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey <> 1 UNION SELECT 2, 999999999")
def m2m_link_change(s: Store) -> DataFrame:
    pairs = s.table("lineitem").select("l_suppkey", "l_partkey")
    add = s.table("supplier").where("s_suppkey = 2").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(999999999).cast("bigint").alias("l_partkey"))
    return changes.linked(pairs, add, pairs.where("l_suppkey = 1"))


@made("SELECT s.c_custkey AS source_id, t.c_custkey AS target_id FROM customer s JOIN customer t ON s.c_mktsegment = t.c_mktsegment AND t.c_acctbal > s.c_acctbal")
def fetched_property(s: Store) -> DataFrame:
    return changes.fetched(s, "Customer", "peers")


@made("SELECT c_custkey + 1000000 AS id, c_name FROM customer WHERE c_custkey < 20 UNION ALL SELECT 2000000 + i, 'twice' FROM range(2) t(i)")
def unique_conflicts(s: Store) -> DataFrame:
    rows = s.table("customer").select("c_custkey", "c_name")
    same = rows.where("c_custkey < 20").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    twice = s.spark.range(2).select((F.col("id") + 2_000_000).alias("c_custkey"), F.lit("twice").alias("c_name"))
    alone = s.spark.range(1).select((F.col("id") + 3_000_000).alias("c_custkey"), F.lit("alone").alias("c_name"))
    return conflicts.unique_conflicts(rows, same.unionByName(twice).unionByName(alone), ("c_name",), "c_custkey")


@made("SELECT o_orderkey AS id, 1 AS base_version, CASE WHEN o_orderkey % 11 <> 0 THEN 2 END AS stored_version FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def version_conflicts(s: Store) -> DataFrame:
    base = s.table("orders").select("o_orderkey", F.lit(1).alias("version"))
    stored = base.where("o_orderkey % 11 <> 0").withColumn("version", F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1))
    return conflicts.version_conflicts(base, stored, "o_orderkey", "version")


def _sides(s: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = s.table("part").select("p_partkey", "p_size", "p_brand")
    local = base.withColumn("p_size", F.when(F.col("p_partkey") % 2 == 0, -1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 0, "local").otherwise(F.col("p_brand")))
    stored = base.withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, -2).otherwise(F.col("p_size")))
    return base, local, stored


LOCAL, STORED = "WHEN p_partkey % 2 = 0 THEN -1", "WHEN p_partkey % 3 = 0 THEN -2"
BRAND = "CASE WHEN p_partkey % 5 = 0 THEN 'local' ELSE p_brand END AS p_brand"


@made(f"SELECT p_partkey, CASE {STORED} {LOCAL} ELSE p_size END AS p_size, {BRAND} FROM part")
def merge_store_trump(s: Store) -> DataFrame:
    return conflicts.merged(*_sides(s), "p_partkey", ["p_size", "p_brand"], "store")


@made(f"SELECT p_partkey, CASE {LOCAL} {STORED} ELSE p_size END AS p_size, {BRAND} FROM part")
def merge_object_trump(s: Store) -> DataFrame:
    return conflicts.merged(*_sides(s), "p_partkey", ["p_size", "p_brand"], "object")


@made(f"SELECT p_partkey, CASE {LOCAL} ELSE p_size END AS p_size, {BRAND} FROM part")
def merge_overwrite(s: Store) -> DataFrame:
    return conflicts.merged(*_sides(s), "p_partkey", ["p_size", "p_brand"], "overwrite")


@made(f"SELECT p_partkey, CASE {STORED} ELSE p_size END AS p_size, p_brand FROM part")
def merge_rollback(s: Store) -> DataFrame:
    return conflicts.merged(*_sides(s), "p_partkey", ["p_size", "p_brand"], "rollback")


STRICT = Model(Entity("Part", "part", "p_partkey", [A("name", column="p_name", optional=False, maximum=10), A("size", "integer32", "p_size", minimum=2, maximum=45), A("brand", column="p_brand", pattern="Brand#[1-4]")]))


@made("SELECT p_partkey AS id, 'name' AS attribute, 'maximum' AS rule FROM part WHERE length(p_name) > 10 UNION ALL SELECT p_partkey, 'size', 'minimum' FROM part WHERE p_size < 2 UNION ALL SELECT p_partkey, 'size', 'maximum' FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'brand', 'pattern' FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-4]')")
def validation_failures(s: Store) -> DataFrame:
    return changes.violations(Store(s.spark, STRICT, s.tables), "Part")


def _log(s: Store) -> DataFrame:
    """Three transactions over parts: an update, a deletion, an insertion."""
    a = s.table("part")
    b = a.withColumn("p_size", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    c = b.where("p_partkey % 50 <> 7")
    d = c.unionByName(a.where("p_partkey < 3").withColumn("p_partkey", F.col("p_partkey") + 9_000_000))
    out = None
    for i, (x, y) in enumerate(((a, b), (b, c), (c, d))):
        step = history.difference(x, y, "p_partkey", ("p_name",)).select(F.lit(i + 1).cast("bigint").alias("transaction"), F.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp_ntz").alias("at"), F.lit("Part").alias("entity"), "kind", F.col("id").cast("bigint").alias("id"), "updated", "tombstone")
        out = step if out is None else out.unionByName(step)
    return out


LOG = "WITH log AS (SELECT 1 AS transaction, 'update' AS kind, p_partkey AS id FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 2, 'delete', p_partkey FROM part WHERE p_partkey % 50 = 7 UNION ALL SELECT 3, 'insert', p_partkey + 9000000 FROM part WHERE p_partkey < 3) "


@made("SELECT 'update' AS kind, p_partkey AS id, 'p_size' AS updated, NULL AS name FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'delete', p_partkey, NULL, p_name FROM part WHERE p_partkey % 50 = 7 UNION ALL SELECT 'insert', p_partkey + 9000000, NULL, NULL FROM part WHERE p_partkey < 3")
def history_diff(s: Store) -> DataFrame:
    return _log(s).select("kind", "id", F.array_join("updated", ",").alias("updated"), F.element_at("tombstone", "p_name").alias("name"))


@made(LOG + "SELECT transaction, kind, id FROM log WHERE transaction > 1")
def history_after_token(s: Store) -> DataFrame:
    return history.after(_log(s), token=1).select("transaction", "kind", "id")


@made(LOG + "SELECT transaction, kind, id FROM log WHERE transaction > 2")
def history_after_date(s: Store) -> DataFrame:
    return history.after(_log(s), date="2024-01-02 00:00:00").select("transaction", "kind", "id")


@made(LOG + "SELECT transaction, kind, id FROM log WHERE transaction IN (1, 3) AND id % 20 = 0")
def history_matching(s: Store) -> DataFrame:
    return history.after(_log(s), transactions=[1, 3], matching=F.col("id") % 20 == 0).select("transaction", "kind", "id")


@made(LOG + "SELECT transaction, kind, id FROM log WHERE transaction >= 2")
def history_purge(s: Store) -> DataFrame:
    return history.purged(_log(s), token=2).select("transaction", "kind", "id")


@made(LOG + "SELECT transaction, count(*) AS changes, min(id) AS first FROM log GROUP BY 1")
def history_tx_changes(s: Store) -> DataFrame:
    return history.shaped(_log(s), "nested").select("transaction", F.size("changes").cast("bigint").alias("changes"), F.get("changes", F.lit(0))["id"].alias("first"))


@made(LOG + "SELECT count(DISTINCT transaction) AS count FROM log")
def history_count(s: Store) -> DataFrame:
    return history.shaped(_log(s), "count")


@made("SELECT c_mktsegment AS section, upper(left(c_mktsegment, 1)) AS title, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_name, c_custkey) AS ids FROM customer WHERE c_acctbal > 9000 GROUP BY 1")
def sections(s: Store) -> DataFrame:
    rows = fetch(s, Request("Customer", "balance > 9000", properties=("objectID", "name", "segment")))
    return live.sections(rows, "segment", ["name"]).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@made("""WITH b AS (SELECT c_custkey AS id, c_mktsegment AS s, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) - 1 AS r FROM customer WHERE c_acctbal > 8000),
c2 AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 40 = 0 THEN 'MOVED' ELSE c_mktsegment END AS m, CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE c_acctbal END AS bal FROM customer),
a AS (SELECT c_custkey AS id, m AS s, row_number() OVER (PARTITION BY m ORDER BY c_name, c_custkey) - 1 AS r FROM c2 WHERE bal > 8000)
SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'delete' ELSE 'move' END AS change, b.s AS from_section, b.r AS from_rank, a.s AS to_section, a.r AS to_rank
FROM b FULL JOIN a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.s <> b.s OR a.r <> b.r""")
def live_diff(s: Store) -> DataFrame:
    q = live.LiveQuery(Request("Customer", "balance > 8000", properties=("objectID", "name", "segment")), "segment", ["name"])
    q.refresh(s)
    rows = s.table("customer")
    changed = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 40 == 0, "MOVED").otherwise(F.col("c_mktsegment"))).withColumn("c_acctbal", F.when(F.col("c_custkey") % 17 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return q.refresh(s.with_tables(customer=changed))


@made("SELECT n_nationkey AS objectID, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def union_stores(s: Store) -> DataFrame:
    other = s.with_tables(nation=s.table("nation").where("n_regionkey = 1"))
    return fetch_all([s, other], Request("Nation", properties=("objectID", "name")))


def _parts(s: Store, n: int) -> DataFrame:
    return s.table("lineitem").where(F.col("l_suppkey") == n).select("l_partkey")


@made("SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def rel_union(s: Store) -> DataFrame:
    return tables.union(_parts(s, 1), _parts(s, 2))


@made("SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def rel_intersect(s: Store) -> DataFrame:
    return tables.intersection(_parts(s, 1), _parts(s, 2))


@made("SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def rel_minus(s: Store) -> DataFrame:
    return tables.minus(_parts(s, 1), _parts(s, 2))


@made("(SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2) UNION (SELECT l_partkey FROM lineitem WHERE l_suppkey = 2 EXCEPT SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)")
def rel_symmetric(s: Store) -> DataFrame:
    return tables.symmetric(_parts(s, 1), _parts(s, 2))


OLD = Model(
    Entity("Customer", "customer", "c_custkey", [A("name", column="c_name"), A("balance", "integer32", "balance"), A("segment", column="c_mktsegment")], [R("nation", "Nation", key="c_nationkey")]),
    Entity("Nation", "nation", "n_nationkey", [A("name", column="n_name")]),
)


def _old(s: Store) -> Store:
    rows = s.table("customer").withColumn("balance", F.floor("c_acctbal").cast("int"))
    return Store(s.spark, OLD, {"customer": rows, "nation": s.table("nation")})


def _new(*attributes: A, **more) -> Model:
    return Model(Entity("Client", "client", "id", list(attributes), [R("nation", "Nation", key="nation_id")], renamed_from="Customer", **more), Entity("Nation", "nation", "n_nationkey", [A("name", column="n_name")]))


@made("SELECT c_custkey AS id, c_name AS full_name, c_nationkey AS nation_id FROM customer")
def migrate_rename(s: Store) -> DataFrame:
    return migration.migrate(_old(s), _new(A("fullName", column="full_name", renamed_from="name"))).table("client")


@made("SELECT c_custkey AS id, CAST(CAST(floor(c_acctbal) AS INT) AS VARCHAR) AS balance, c_nationkey AS nation_id FROM customer")
def migrate_type_widen(s: Store) -> DataFrame:
    return migration.migrate(_old(s), _new(A("balance", "string", "balance"))).table("client")


@made("SELECT c_custkey AS id, 7 AS level, NULL AS note, c_nationkey AS nation_id FROM customer")
def migrate_add_default(s: Store) -> DataFrame:
    out = migration.migrate(_old(s), _new(A("level", "integer32", "level", optional=False, default=7), A("note", column="note"))).table("client")
    return out


@made("SELECT c_custkey AS customer, c_nationkey AS nation FROM customer WHERE c_nationkey IS NOT NULL")
def migrate_fk_to_bridge(s: Store) -> DataFrame:
    return migration.key_to_bridge(s.table("customer"), "c_custkey", "c_nationkey", ("customer", "nation"))


@made("SELECT p_partkey, (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS supplier FROM part")
def migrate_bridge_to_fk(s: Store) -> DataFrame:
    return migration.bridge_to_key(s.table("part").select("p_partkey"), "p_partkey", s.table("lineitem").select("l_partkey", "l_suppkey"), ("l_partkey", "l_suppkey"), "supplier")


@made("SELECT c_custkey AS id, upper(c_name) AS name FROM customer WHERE c_acctbal >= 0")
def migrate_split(s: Store) -> DataFrame:
    """A custom mapping with a policy, in two stages."""
    middle = Model(*OLD.entities.values())
    target = Model(Entity("Solvent", "solvent", "id", [A("name")]))
    mapping = migration.Mapping("Customer", "Solvent", {"id": F.col("c_custkey"), "name": F.upper("c_name"), "balance": F.col("balance")}, lambda rows: rows.where("balance >= 0").drop("balance"))
    return migration.staged(_old(s), [migration.Stage(middle), migration.Stage(target, [mapping])]).table("solvent")


@made("SELECT count(*) AS n, count(s_name) AS named, max(s_acctbal) FILTER (s_suppkey = 9000001) AS a, max(s_acctbal) FILTER (s_suppkey = 9000002) AS b FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 9000001, NULL, 70 UNION ALL SELECT 9000002, NULL, 80)")
def upsert_nulls(s: Store) -> DataFrame:
    """A null unique value equals nothing: both rows are added, whole."""
    old = s.table("supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.spark.createDataFrame([(9_000_001, None, 70.0), (9_000_002, None, 80.0)], old.schema)
    out = changes.upsert(old, new, ("s_name",), "s_suppkey")
    return out.agg(F.count("*").alias("n"), F.count("s_name").alias("named"), F.max(F.when(F.col("s_suppkey") == 9_000_001, F.col("s_acctbal"))).alias("a"), F.max(F.when(F.col("s_suppkey") == 9_000_002, F.col("s_acctbal"))).alias("b"))


@made("SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 2000000, c_name, 'OTHER', 0.5 FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT c_custkey + 3000000, c_name, NULL, 0.5 FROM customer WHERE c_custkey % 4 = 2")
def upsert_composite(s: Store) -> DataFrame:
    """Unique by name and segment together: equal pairs are replaced, pairs that differ or hold a null are added."""
    old = s.table("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = old.where("c_custkey % 4 < 3").withColumn("c_acctbal", F.lit(0.5))
    kind = F.col("c_custkey") % 4
    new = new.withColumn("c_mktsegment", F.when(kind == 1, "OTHER").when(kind == 0, F.col("c_mktsegment")))
    new = new.withColumn("c_custkey", F.col("c_custkey") + (kind + 1) * 1_000_000)
    return changes.upsert(old, new, ("c_name", "c_mktsegment"), "c_custkey")


@made("SELECT count(*) AS n, count(DISTINCT n_nationkey) AS different FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 1000 + i FROM range(3) t(i))")
def save_null_keys(s: Store) -> DataFrame:
    """Inserts without a key get one each."""
    rows = s.table("nation")
    add = rows.limit(3).withColumn("n_nationkey", F.lit(None).cast(rows.schema["n_nationkey"].dataType))
    return changes.save(s, "Nation", add).table("nation").agg(F.count("*").alias("n"), F.count_distinct("n_nationkey").alias("different"))


@made("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 45)")
def batch_delete_lines(s: Store) -> DataFrame:
    """Rows whose id is not unique are told apart by the predicate itself."""
    return changes.batch_delete(s, "Lineitem", "quantity > 45").table("lineitem").select("l_orderkey", "l_linenumber")


@made("SELECT p_partkey AS objectID FROM part WHERE p_size > 40")
def batch_result_ids(s: Store) -> DataFrame:
    return changes.matched(s, "Part", "size > 40", result="ids")


@made("SELECT true AS status")
def batch_result_status(s: Store) -> DataFrame:
    return changes.matched(s, "Part", "size > 40")


@made("SELECT count(*) AS count FROM part WHERE p_partkey % 2 = 0")
def outcome_of_versions(s: Store) -> DataFrame:
    rows = s.table("part")
    return changes.outcome(rows, rows.withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, "other").otherwise(F.col("p_name"))), "p_partkey", "count")


@made("SELECT s.c_custkey AS source_id, t.c_custkey AS target_id FROM customer s JOIN customer t ON s.c_mktsegment = t.c_mktsegment AND t.c_acctbal > s.c_acctbal WHERE s.c_custkey < 5")
def fetched_property_of(s: Store) -> DataFrame:
    return changes.fetched(s, "Customer", "peers", limit_keys=s.table("customer").where("c_custkey < 5").select("c_custkey"))


VALID = Model(Entity("Part", "part", "p_partkey", [A("name", column="p_name", validator=lambda c: ~c.startswith("s")), A("shelf", transient=True)]))


@made("SELECT p_partkey AS id, 'name' AS attribute, 'validator' AS rule FROM part WHERE starts_with(p_name, 's')")
def validator_failures(s: Store) -> DataFrame:
    return changes.violations(Store(s.spark, VALID, s.tables), "Part")


@made("SELECT p_partkey AS objectID, 'Part' AS entityName, p_name AS name FROM part")
def transient_attribute(s: Store) -> DataFrame:
    return fetch(Store(s.spark, VALID, s.tables), Request("Part", result="objects", sort=("shelf", "name")))


@made(LOG + "SELECT DISTINCT 'Part' AS entity, id FROM log")
def history_ids(s: Store) -> DataFrame:
    return history.shaped(_log(s), "ids")


@made(LOG + "SELECT transaction, make_timestamp(2024, 1, transaction, 0, 0, 0) AS at FROM log GROUP BY 1")
def history_transactions(s: Store) -> DataFrame:
    return history.shaped(_log(s), "transactions")


@made(LOG + "SELECT transaction, kind, id FROM log")
def history_changes(s: Store) -> DataFrame:
    return history.shaped(_log(s), "changes").select("transaction", "kind", "id")


@made("SELECT true AS status")
def history_status(s: Store) -> DataFrame:
    return history.shaped(_log(s), "status")


@made("SELECT max(p_partkey) AS top, count(*) AS n FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey + 9000000 FROM part WHERE p_partkey < 3)")
def merge_remote_inserts(s: Store) -> DataFrame:
    rows = s.table("part")
    remote = rows.where("p_partkey % 50 <> 7").unionByName(rows.where("p_partkey < 3").withColumn("p_partkey", F.col("p_partkey") + 9_000_000))
    return history.merged_inserts(rows, _log(s), remote, "p_partkey", "Part").agg(F.max("p_partkey").alias("top"), F.count("*").alias("n"))


EVENTS = Model(
    Entity("Event", "events", "event_id", [A("value", "double")], abstract=True, discriminator="event_type"),
    Entity("Click", "events", "event_id", parent="Event", tag="click"), Entity("Purchase", "events", "event_id", parent="Event", tag="purchase"),
)


@made("SELECT event_id AS id, value AS strength FROM events WHERE event_type = 'click'")
def migrate_subentity(s: Store) -> DataFrame:
    """A sub-entity as the source gives its own rows, not those of its whole table."""
    target = Model(Entity("Tap", "tap", "id", [A("strength", "double")]))
    mapping = migration.Mapping("Click", "Tap", {"id": F.col("event_id"), "strength": F.col("value")})
    return migration.migrate(Store(s.spark, EVENTS, {"events": s.table("events")}), target, [mapping]).table("tap")


@made("SELECT c.c_name AS name, n_name AS nation, true AS small FROM customer c JOIN nation ON c_nationkey = n_nationkey")
def migrate_new_keys(s: Store) -> DataFrame:
    """Both tables get new keys, and the to-one between them follows."""
    target = Model(
        Entity("Client", "client", "id", [A("name")], [R("nation", "Land", key="land_id")]),
        Entity("Land", "land", "id", [A("name")]),
    )
    maps = [
        migration.Mapping("Customer", "Client", {"id": F.col("c_custkey"), "name": F.col("c_name"), "land_id": F.col("c_nationkey")}, new_keys=True),
        migration.Mapping("Nation", "Land", {"id": F.col("n_nationkey") + 500, "name": F.col("n_name")}, new_keys=True),
    ]
    maps[0].values["land_id"] = F.col("c_nationkey") + 500
    out = migration.migrate(_old(s), target, maps, validate=True)
    rows = out.table("client").alias("c").join(out.table("land").alias("l"), F.col("c.land_id") == F.col("l.id"))
    small = (F.col("c.id") <= out.table("client").count()) & (F.col("l.id") <= out.table("land").count())
    return rows.select(F.col("c.name").alias("name"), F.col("l.name").alias("nation"), small.alias("small"))


@made("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 100")
def migrate_staged_resume(s: Store) -> DataFrame:
    """A store that is at the first stage's model already goes on from there: that stage's policy does not run again."""
    first = Model(Entity("Client", "client", "id", [A("name"), A("balance", "integer32")]))
    second = Model(Entity("Client", "client", "id", [A("name")]))
    values = {"id": F.col("c_custkey"), "name": F.col("c_name"), "balance": F.col("balance")}
    stages = [migration.Stage(first, [migration.Mapping("Customer", "Client", values, lambda rows: rows.where("balance >= 100").withColumn("balance", F.col("balance") - 100))]), migration.Stage(second)]
    half = migration.staged(_old(s), stages[:1], start=OLD)
    return migration.staged(half, stages, start=OLD).table("client")


@made("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey = 3")
def migrate_discovered(s: Store) -> DataFrame:
    """A mapping found by the version hashes of an entity in the two models."""
    target = Model(Entity("Nation", "land", "id", [A("name")]))
    known = {(OLD.version_hash("Nation"), target.version_hash("Nation")): [migration.Mapping("Nation", "Nation", {"id": F.col("n_nationkey"), "name": F.col("n_name")}, lambda rows: rows.where("id = 3"))]}
    return migration.migrate(_old(s), target, migration.discovered(known, OLD, target, "Nation")).table("land")


CODED = Model(Entity("Nation", "nation", "n_nationkey", [A("name", "transformable", "n_name", codec="hex")]))


@made("SELECT n_nationkey AS objectID, n_name AS name FROM nation")
def codec_round_trip(s: Store) -> DataFrame:
    """A transformable attribute is written by its encoder and read by its decoder."""
    codecs = {"hex": (F.hex, lambda c: F.unhex(c).cast("string"))}
    rows = changes.encoded(s.table("nation"), CODED["Nation"].attributes[0], codecs)
    return fetch(Store(s.spark, CODED, {"nation": rows}, codecs=codecs), Request("Nation", properties=("objectID", "name")))
