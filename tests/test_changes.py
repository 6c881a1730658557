"""Writes, rules, conflicts, history, live results, stores and migrations outside SQL's reach (W1-W19, R1-R9, G4-G14, S5-S9, K1-K3)."""

import pytest
from pyspark.sql import functions as F

from orrery.change_queries import fetched_property
from orrery.model import Attribute, Entity, FetchedProperty, Model, ModelError, Relationship, Store, coerced
from orrery.operators import changes, conflicts
from orrery.plans import migration
from orrery.plans.compiler import fetch
from orrery.plans.request import Named, Request
from orrery.semantic import MODEL as SEMANTIC
from orrery.sources import tables, xml_store
from orrery.streaming import history, live

MODEL = Model(
    Entity("Department", "department", "id", [Attribute("name")], [Relationship("workers", "Worker", inverse_key="dep", many=True, delete_rule="cascade", inverse="department"), Relationship("rooms", "Room", inverse_key="dep", many=True, delete_rule="deny")]),
    Entity("Worker", "worker", "id", [Attribute("name"), Attribute("pay", "integer32")], [Relationship("department", "Department", key="dep", inverse="workers"), Relationship("boss", "Worker", key="boss_id"), Relationship("team", "Worker", inverse_key="boss_id", many=True, delete_rule="cascade")]),
    Entity("Room", "room", "id", [], [Relationship("department", "Department", key="dep")]),
)


@pytest.fixture
def store(spark):
    return Store(spark, MODEL, {
        "department": spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string"),
        "worker": spark.createDataFrame([(1, "x", 10, 1, None), (2, "y", None, 1, 1), (3, "z", 30, 2, 2), (4, "w", 5, 2, None)], "id bigint, name string, pay int, dep bigint, boss_id bigint"),
        "room": spark.createDataFrame([(7, 2)], "id bigint, dep bigint"),
    })


def keys(df, name="id"):
    return sorted(r[name] for r in df.collect())


def test_allotted_keys_have_no_gaps(store):
    out = changes.batch_insert(store, "Worker", [{"name": f"n{i}"} for i in range(20)] + [{"id": 50, "name": "given"}])
    assert keys(out.table("worker")) == [1, 2, 3, 4, 50, *range(51, 71)]


def test_null_predicate_keeps_rows_and_updates_skip_them(store):
    assert keys(changes.batch_delete(store, "Worker", "pay > 7").table("worker")) == [2, 4]
    out = changes.batch_update(store, "Worker", {"name": None}, "pay > 7").table("worker")
    assert sorted(r["id"] for r in out.where("name IS NULL").collect()) == [1, 3]


def test_cascade_follows_itself_and_deny_raises(store):
    assert keys(changes.delete(store, "Worker", "objectID == 1").table("worker")) == [4]
    with pytest.raises(ModelError):
        changes.delete(store, "Department", "objectID == 2")
    out = changes.delete(store, "Department", "objectID == 1")
    assert keys(out.table("department")) == [2]


def test_read_only_store_refuses_all_writes(store):
    closed = Store(store.spark, MODEL, store.tables, read_only=True)
    for write in (lambda: changes.batch_update(closed, "Worker", {"pay": 1}), lambda: changes.batch_delete(closed, "Worker"), lambda: changes.batch_insert(closed, "Worker", [{"name": "q"}])):
        with pytest.raises(ModelError):
            write()


def test_save_counts_versions(spark, store):
    s = store.with_tables(worker=store.table("worker").withColumn("version", F.lit(1)))
    out = changes.save(s, "Worker", updates=spark.createDataFrame([(1, "new")], "id bigint, name string"), deletes=spark.createDataFrame([(4,)], "id bigint"), version="version")
    assert sorted((r["id"], r["version"], r["name"]) for r in out.table("worker").collect()) == [(1, 2, "new"), (2, 1, "y"), (3, 1, "z")]


def test_merge_error_policy_raises_only_for_both_sides(spark):
    base = spark.createDataFrame([(1, 1), (2, 2)], "id int, v int")
    local, stored = spark.createDataFrame([(1, 5), (2, 2)], "id int, v int"), spark.createDataFrame([(1, 1), (2, 9)], "id int, v int")
    assert sorted(map(tuple, conflicts.merged(base, local, stored, "id", ["v"], "error").collect())) == [(1, 5), (2, 9)]
    with pytest.raises(Exception, match="conflict at 1"):
        conflicts.merged(base, local, spark.createDataFrame([(1, 7), (2, 9)], "id int, v int"), "id", ["v"], "error").collect()


def test_history_is_logged_streamed_and_purged(spark, store, tmp_path):
    after = changes.batch_update(store, "Worker", {"pay": 1}, "pay > 7").table("worker")
    diff = history.difference(store.table("worker"), after, "id", ("name",))
    first = history.logged(diff, None, "Worker", F.lit("2024-01-01 00:00:00"))
    history.append(first, str(tmp_path / "log"))
    log = spark.read.schema(history.CHANGE).parquet(str(tmp_path / "log"))
    second = history.logged(history.difference(after, after.where("id <> 4"), "id", ("name",)), log, "Worker", F.lit("2024-01-02 00:00:00"))
    history.append(tables.cut(second), str(tmp_path / "log"))
    log = spark.read.schema(history.CHANGE).parquet(str(tmp_path / "log"))
    assert sorted((r["transaction"], r["kind"], r["id"]) for r in log.collect()) == [(1, "update", 1), (1, "update", 3), (2, "delete", 4)]
    assert history.latest_token(log).first()[0] == 2
    assert history.after(log, token=1).first()["tombstone"] == {"name": "w"}
    assert history.purged(log, token=2).count() == 1 and history.purged(log, date="2024-01-02 00:00:00").count() == 1
    seen = []
    query = history.notify(spark, str(tmp_path / "log"), str(tmp_path / "state"), lambda token, batch: seen.append((token, batch.count())))
    query.awaitTermination()
    assert seen == [(2, 3)]
    assert {r["result"] for r in spark.createDataFrame([("status",), ("ids",), ("transactions",), ("changes",)], "result string").collect() if history.shaped(log, r["result"]).count()} == {"status", "ids", "transactions", "changes"}


def test_live_query_tests_its_predicate_again(store):
    q = live.LiveQuery(Request("Worker", "pay > 7", properties=("objectID", "name", "department")), "department", ["name"])
    assert sorted(r["change"] for r in q.refresh(store).collect()) == ["insert", "insert"]
    new = changes.batch_insert(store, "Worker", [{"id": 9, "name": "zz", "pay": 1, "dep": 1}])
    assert q.refresh(new).count() == 0


def test_xml_round_trip(spark, store, tmp_path):
    xml_store.write(store, str(tmp_path / "xml"))
    back = xml_store.read(spark, MODEL, str(tmp_path / "xml"))
    for t in ("department", "worker", "room"):
        columns = sorted(store.table(t).columns)
        assert sorted(map(str, back.table(t).select(columns).collect())) == sorted(map(str, store.table(t).select(columns).collect()))


def test_parquet_round_trip_and_pages(spark, store, tmp_path):
    tables.save_store(store, str(tmp_path / "s"))
    back = tables.store_from(spark, MODEL, str(tmp_path / "s"))
    found = [keys(p, "objectID") for p in tables.pages(back, Request("Worker", properties=("objectID",)), "objectID", 3)]
    assert found == [[1, 2, 3], [4]]


def test_cache_starts_anew_after_a_write(store):
    cache = tables.ResultCache(store)
    request = Request("Worker", "pay > 7", properties=("objectID",))
    assert cache.fetch(request) is cache.fetch(request)
    assert not Request("Worker", "team.@count > 0").cacheable()
    cache.changed(changes.batch_delete(store, "Worker", "objectID == 1"))
    assert keys(cache.fetch(request), "objectID") == [3]


def test_udf_projection_and_codec(spark, store):
    shout = F.udf(lambda s: None if s is None else s + "!", "string")
    assert keys(fetch(store, Request("Worker", properties=("name",))).select(shout("name").alias("name")), "name") == ["w!", "x!", "y!", "z!"]
    a = Attribute("name", "transformable", codec="hex")
    codecs = {"hex": (lambda c: F.hex(c), lambda c: F.unhex(c).cast("string"))}
    assert keys(changes.decoded(changes.encoded(store.table("worker"), a, codecs), a, codecs), "name") == ["w", "x", "y", "z"]


def test_coercion(spark):
    e = Entity("E", "e", "id", [Attribute("a", "integer32"), Attribute("b", "integer32", optional=False, default=4), Attribute("c"), Attribute("d", "string", optional=False)])
    df = spark.createDataFrame([(1, "", "x", "", None)], "id int, a string, b string, c string, d string")
    assert tuple(coerced(df, Model(e), e).first()) == (1, None, 4, None, "")


def test_inferred_migrations_that_are_refused(store):
    changed = [Attribute("name", "integer32"), Attribute("pay", "integer32")]
    with pytest.raises(ModelError):
        migration.inferred(MODEL, Model(Entity("Worker", "worker", "id", changed)))
    with pytest.raises(ModelError):
        migration.inferred(MODEL, Model(Entity("Worker", "worker", "id", [Attribute("born", "date", optional=False)])))
    with pytest.raises(ModelError):
        migration.inferred(MODEL, Model(Entity("Room", "room", "id"), Entity("Worker", "worker", "id", [], [Relationship("department", "Room", key="dep")])))
    assert migration.needed(MODEL, MODEL) == []
    new = Model(Entity("Room", "room", "id", [Attribute("kind", default="office")]))
    assert migration.needed(MODEL, new) == ["Room"]
    seen = []
    out = migration.staged(store, [migration.Stage(new)], seen.append)
    assert seen == [1.0] and out.table("room").first()["kind"] == "office"
    with pytest.raises(ModelError):
        migration.staged(store, [migration.Stage(new)], cancelled=lambda: True)


def test_volatile_functions(store):
    row = fetch(store, Request("Worker", properties=(Named("r", "random()"), Named("u", "uuid()"), Named("t", "now()"), Named("d", "currentDate()")), limit=1)).first()
    assert 0 <= row["r"] < 1 and len(row["u"]) == 36 and row["t"].date() >= row["d"]


def test_rows_without_a_single_key_are_refused_where_one_is_needed(spark):
    from orrery.semantic import store as demo

    s = demo(spark, "/root/testdata/sf0.001")
    for call in (lambda: changes.matching(s, "Lineitem", "quantity > 1"), lambda: changes.save(s, "Lineitem", deletes=s.table("lineitem"))):
        with pytest.raises(ModelError):
            call()


def test_two_changes_of_one_row_are_an_error(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "id bigint, name string")
    with pytest.raises(Exception, match="several changes of 1"):
        changes.updated(old, twice, "id", ["name"]).collect()


def test_migration_validates_and_names_its_start(spark, store):
    strict = Model(Entity("Worker", "worker", "id", [Attribute("name"), Attribute("pay", "integer32", minimum=8)]))
    assert migration.migrate(store, strict).table("worker").count() == 4
    with pytest.raises(ModelError, match="pay breaks minimum"):
        migration.migrate(store, strict, validate=True)
    with pytest.raises(ModelError):
        migration.staged(store, [migration.Stage(strict)], start=strict)
    moved = {}
    target = Model(Entity("Worker", "worker", "id", [Attribute("name")], [Relationship("boss", "Worker", key="boss_id")]))
    mapping = migration.Mapping("Worker", "Worker", {"id": F.col("id") * 100, "name": F.col("name"), "boss_id": F.col("boss_id") * 100}, new_keys=True)
    rows = {r["name"]: r for r in migration.migrate(store, target, [mapping], associations=moved).table("worker").collect()}
    assert sorted(r["id"] for r in rows.values()) == [1, 2, 3, 4] and rows["z"]["boss_id"] == rows["y"]["id"] and rows["x"]["boss_id"] is None
    assert keys(moved["Worker"], "old_id") == [100, 200, 300, 400]


def test_a_kind_of_store_must_be_registered(spark, store, tmp_path):
    xml_store.write(store, str(tmp_path / "x"))
    assert tables.opened(spark, MODEL, "xml", str(tmp_path / "x")).table("worker").count() == 4
    with pytest.raises(ModelError):
        tables.opened(spark, MODEL, "nothing", "")


def test_a_fetched_property_of_one_group_is_dealt_to_many_tasks(spark, monkeypatch):
    """One large group, small ones, nulls: the pairs are those of a nested loop, and no task makes a large part of them."""
    monkeypatch.setattr(changes, "ROWS_A_CUT", 16, raising=False)
    peers = FetchedProperty("peers", "Worker", "dep == $FETCH_SOURCE.dep AND pay > $FETCH_SOURCE.pay")
    model = Model(Entity("Worker", "worker", "id", [Attribute("dep", "integer64"), Attribute("pay", "integer32")], [], [peers]))
    rows = [(i, 1 if i < 300 else None if i % 7 == 0 else i % 20, None if i % 50 == 3 else i * 37 % 101) for i in range(400)]
    store = Store(spark, model, {"worker": spark.createDataFrame(rows, "id bigint, dep bigint, pay int")})
    found = changes.fetched(store, "Worker", "peers")
    want = sorted((s, t) for s, d, p in rows for t, e, q in rows if None not in (d, p, q) and d == e and q > p)
    assert sorted(tuple(r) for r in found.collect()) == want
    parts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) < len(want) / 20, parts


def test_the_query_of_a_fetched_property_has_the_pairs_of_all_rows(spark):
    """No target is left out for its balance; where targets are to be left out, `where` says so."""
    names = ["c_custkey", "c_mktsegment", "c_acctbal"]
    rows = [(1, "A", 10.0), (2, "A", 20.0), (3, "A", 9950.0), (4, "B", 5.0), (5, "B", None), (6, None, 9990.0), (7, "A", 20.0)]
    table = spark.createDataFrame(rows, "c_custkey bigint, c_mktsegment string, c_acctbal double")
    store = Store(spark, SEMANTIC, {"customer": table.select(*names)})
    pairs = lambda least: sorted((s, t) for s, a, x in rows for t, b, y in rows if None not in (a, b, x, y) and a == b and y > x and y > least)
    assert sorted(map(tuple, fetched_property(store).collect())) == pairs(0)
    assert sorted(map(tuple, changes.fetched(store, "Customer", "peers", where="balance > 9900").collect())) == pairs(9900)
