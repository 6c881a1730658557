"""The demo model over the star schema, events, documents and conversations."""

from __future__ import annotations

from pyspark.sql import SparkSession

from orrery.model import Attribute as A
from orrery.model import Entity, FetchedProperty, Model, Store
from orrery.model import Relationship as R
from orrery.plans.request import Request

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

MODEL = Model(
    Entity("Region", "region", "r_regionkey", [A("name", column="r_name"), A("nationCount", "integer64", derived="nations.@count")], [R("nations", "Nation", inverse_key="n_regionkey", many=True, inverse="region", delete_rule="cascade")]),
    Entity("Nation", "nation", "n_nationkey", [A("name", column="n_name")], [
        R("region", "Region", key="n_regionkey", inverse="nations"),
        R("customers", "Customer", inverse_key="c_nationkey", many=True, inverse="nation", delete_rule="cascade"),
        R("suppliers", "Supplier", inverse_key="s_nationkey", many=True, inverse="nation", delete_rule="nullify"),
    ]),
    Entity("Customer", "customer", "c_custkey", [A("name", column="c_name"), A("balance", "double", "c_acctbal", sensitive=True), A("segment", column="c_mktsegment"), A("regionName", derived="nation.region.name"), A("orderCount", "integer64", derived="orders.@count")], [
        R("nation", "Nation", key="c_nationkey", inverse="customers"),
        R("orders", "Order", inverse_key="o_custkey", many=True, inverse="customer", delete_rule="deny"),
    ], [FetchedProperty("peers", "Customer", "segment == $FETCH_SOURCE.segment AND balance > $FETCH_SOURCE.balance")]),
    Entity("Supplier", "supplier", "s_suppkey", [A("name", column="s_name"), A("balance", "double", "s_acctbal")], [
        R("nation", "Nation", key="s_nationkey", inverse="suppliers"),
        R("lineitems", "Lineitem", inverse_key="l_suppkey", many=True, inverse="supplier"),
        R("parts", "Part", bridge=("lineitem", "l_suppkey", "l_partkey"), many=True, inverse="suppliers"),
    ]),
    Entity("Part", "part", "p_partkey", [A("name", column="p_name"), A("brand", column="p_brand"), A("type", column="p_type"), A("size", "integer32", "p_size"), A("price", "double", "p_retailprice")], [
        R("lineitems", "Lineitem", inverse_key="l_partkey", many=True, inverse="part"),
        R("suppliers", "Supplier", bridge=("lineitem", "l_partkey", "l_suppkey"), many=True, inverse="parts"),
    ]),
    Entity("Order", "orders", "o_orderkey", [A("status", column="o_orderstatus"), A("totalPrice", "double", "o_totalprice"), A("orderDate", "date", "o_orderdate"), A("priority", column="o_orderpriority"), A("lineCount", "integer64", derived="lineitems.@count"), A("doubled", "double", derived="multiply:by:(totalPrice, 2)"), A("big", derived='IF(totalPrice > 200000, "big", "small")'), A("customerName", derived="customer.name")], [
        R("customer", "Customer", key="o_custkey", inverse="orders"),
        R("lineitems", "Lineitem", inverse_key="l_orderkey", many=True, inverse="order", order_by="number", delete_rule="cascade"),
    ]),
    Entity("Lineitem", "lineitem", "l_linenumber", [A("number", "integer32", "l_linenumber"), A("quantity", "double", "l_quantity"), A("extendedPrice", "double", "l_extendedprice"), A("discount", "double", "l_discount"), A("tax", "double", "l_tax"), A("returnFlag", column="l_returnflag"), A("lineStatus", column="l_linestatus"), A("shipDate", "date", "l_shipdate"), A("pricing", parts=(A("quantity", "double", "l_quantity"), A("extendedPrice", "double", "l_extendedprice"), A("discount", "double", "l_discount")))], [
        R("order", "Order", key="l_orderkey", inverse="lineitems"),
        R("part", "Part", key="l_partkey", inverse="lineitems"),
        R("supplier", "Supplier", key="l_suppkey", inverse="lineitems"),
    ], identity=("l_orderkey", "l_linenumber")),
    Entity("Event", "events", "event_id", [A("at", "date", "ts"), A("user", "integer64", "user_id"), A("kind", column="event_type"), A("value", "double"), A("props")], abstract=True, discriminator="event_type"),
    Entity("CommerceEvent", "events", "event_id", parent="Event", abstract=True),
    Entity("Purchase", "events", "event_id", parent="CommerceEvent", tag="purchase"),
    Entity("Signup", "events", "event_id", parent="CommerceEvent", tag="signup"),
    Entity("Click", "events", "event_id", parent="Event", tag="click"),
    Entity("View", "events", "event_id", parent="Event", tag="view"),
    Entity("Error", "events", "event_id", parent="Event", tag="error"),
    Entity("Document", "documents", "doc_id", [A("lang"), A("source"), A("chars", "integer64", "n_chars")], [R("label", "Label", inverse_key="doc_id", inverse="document")]),
    Entity("Label", "labels", "doc_id", [A("quality", "integer32"), A("toxic", "integer32")], [R("document", "Document", key="doc_id", inverse="label")]),
    Entity("Turn", "conversations", "turn", [A("conversation", "integer64", "conv_id"), A("turn", "integer64"), A("role"), A("text")], identity=("conv_id", "turn")),
    templates={"ordersOver": Request("Order", "totalPrice > $LIMIT AND priority == $PRIORITY", properties=("objectID", "totalPrice"))},
)


def store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(spark, MODEL, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})
