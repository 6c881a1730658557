"""Registered queries over the demo model, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.model import Attribute as A
from orrery.model import Entity, Model, Store
from orrery.model import Relationship as R
from orrery.operators.expressions import Block, expression
from orrery.plans.compiler import fetch
from orrery.plans.graph import as_json
from orrery.plans.request import Named as N
from orrery.plans.request import Request, from_template
from orrery.semantic import MODEL, store
from orrery.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, request: Request, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    QUERIES[name] = lambda spark, sf_dir: after(fetch(store(spark, sf_dir), request))
    SQL[name] = sql


def made(sql: str) -> Callable:
    """Registers a function of a store under its name."""

    def keep(function: Callable) -> Callable:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(store(spark, sf_dir))
        SQL[function.__name__] = sql
        return function

    return keep


def orders(predicate=None, *args, **more) -> Request:
    return Request("Order", predicate, args, properties=more.pop("properties", ("objectID", "totalPrice")), **more)


O = "SELECT o_orderkey AS objectID, o_totalprice AS totalPrice FROM orders o"  # noqa: E741

# Core fetches
query("fetch_all", "SELECT n_nationkey AS objectID, 'Nation' AS entityName, n_name AS name FROM nation", Request("Nation", result="objects"))
query("fetch_projection", "SELECT c_name AS name, c_mktsegment AS segment FROM customer", Request("Customer", properties=("name", "segment")))
query("fetch_ids", "SELECT o_orderkey AS objectID, 'Order' AS entityName FROM orders WHERE o_totalprice > 300000", Request("Order", "totalPrice > 300000", result="ids"))
query("fetch_count", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'", Request("Order", 'status == "F"', result="count"))
query("fetch_without_values", "SELECT r_regionkey AS objectID, 'Region' AS entityName FROM region", Request("Region", values=False))
query("fetch_eq", f"{O} WHERE o_orderstatus = 'O'", orders("status == %@", "O"))
query("fetch_ne", f"{O} WHERE o_orderstatus <> 'O'", orders("status != %@", "O"))
query("fetch_range", f"{O} WHERE o_totalprice > 100000 AND o_totalprice <= 150000.5", orders("totalPrice > %d AND 150000.5 >= totalPrice", 100000))
query("fetch_in", f"{O} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", orders("priority IN {'1-URGENT', '2-HIGH'}"))
query("fetch_between", f"{O} WHERE o_totalprice BETWEEN 1000 AND 50000", orders("totalPrice BETWEEN {1000, 50000}"))
query("fetch_and_or_not", f"{O} WHERE (o_orderstatus = 'F' OR o_totalprice < 20000) AND NOT (o_orderpriority = '5-LOW')", orders('(status == "F" OR totalPrice < 20000) AND NOT (priority == "5-LOW")'))
query("fetch_true", "SELECT r_name AS name FROM region", Request("Region", "TRUEPREDICATE", properties=("name",)))
query("fetch_false", "SELECT r_name AS name FROM region WHERE 1 = 0", Request("Region", "FALSEPREDICATE", properties=("name",)))
query("fetch_nil", "SELECT d.doc_id AS objectID FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL", Request("Document", "label.quality == nil", properties=("objectID",)))
query("fetch_not_nil", "SELECT d.doc_id AS objectID, l.quality AS label_quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL", Request("Document", "nil != label.quality", properties=("objectID", "label.quality")))
query("sort_multi", "SELECT c_custkey AS objectID, c_mktsegment AS segment FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_custkey NULLS FIRST LIMIT 50", Request("Customer", sort=("-segment", "objectID"), limit=50, properties=("objectID", "segment")))
query("limit_offset", f"{O} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10", orders(sort=("-totalPrice", "objectID"), limit=20, offset=10))
query("distinct_values", "SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders", Request("Order", properties=("priority", "status"), distinct=True))
query("keypath_projection", "SELECT o_orderkey AS objectID, n_name AS customer_nation_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey", Request("Order", properties=("objectID", "customer.nation.name")))
query("flagship", "SELECT o_orderkey AS objectID, o_totalprice AS totalPrice, c_name AS customer_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND o_totalprice > 50000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10", Request("Order", "customer.nation.name == %@ AND totalPrice > %d", ("NATION_3", 50000), sort=("-totalPrice", "objectID"), limit=10, properties=("objectID", "totalPrice", "customer.name")))
query("expression_projection", "SELECT p_partkey AS objectID, CAST(floor(p_retailprice * 2) AS BIGINT) AS twice FROM part", Request("Part", properties=("objectID", N("twice", "floor:(multiply:by:(price, 2))", "bigint"))))
query("block_projection", "SELECT p_partkey AS objectID, length(p_name) AS chars FROM part", Request("Part", properties=("objectID", "name")), lambda df: df.select("objectID", F.length("name").alias("chars")))

# Strings
PART = "SELECT p_partkey AS objectID, p_name AS name FROM part"
parts = lambda p, *a: Request("Part", p, a, properties=("objectID", "name"))
query("like_literal", f"{PART} WHERE p_name = 'small ring'", parts('name LIKE "small ring"'))
query("like_no_wildcard", f"{PART} WHERE p_name = 'small%'", parts('name LIKE "small%"'))
query("matches_cs", f"{PART} WHERE regexp_matches(p_name, '^s.*g$')", parts('name MATCHES "^s.*g$"'))
query("matches_ci", f"{PART} WHERE regexp_matches(p_name, '(?i)^S.*G$')", parts('name MATCHES[c] "^S.*G$"'))
query("beginswith_cs", f"{PART} WHERE starts_with(p_name, 'small')", parts('name BEGINSWITH "small"'))
query("beginswith_ci", f"{PART} WHERE starts_with(lower(p_name), 'small')", parts('name BEGINSWITH[c] "SMALL"'))
query("endswith_cs", f"{PART} WHERE ends_with(p_name, 'ring')", parts('name ENDSWITH "ring"'))
query("contains_ci", f"{PART} WHERE contains(lower(p_name), 'll r')", parts('name CONTAINS[c] "LL R"'))
query("wildcard_escape_in", f"{PART} WHERE contains(p_name, '_') OR contains(p_name, '%')", parts('name CONTAINS "_" OR name CONTAINS "%"'))
query("eq_ci", f"{PART} WHERE lower(p_name) = 'small ring'", parts('name ==[c] "SMALL RING"'))
query("in_ci", f"{PART} WHERE lower(p_name) IN ('small ring', 'large ring')", parts('name IN[c] {"SMALL RING", "Large Ring"}'))

# Relationships
query("toone_filter", "SELECT c_custkey AS objectID, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'", Request("Customer", 'nation.name == "NATION_7"', properties=("objectID", "name")))
query("toone_chain", "SELECT o_orderkey AS objectID FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", Request("Order", 'customer.nation.region.name == "ASIA"', properties=("objectID",)))
query("toone_sort", "SELECT o_orderkey AS objectID, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY c_name NULLS FIRST, o_orderkey DESC LIMIT 30", Request("Order", sort=("customer.name", "-objectID"), limit=30, properties=("objectID", "customer.name")))
query("toone_keypath_to_key", "SELECT o_orderkey AS objectID FROM orders WHERE o_custkey = 7", Request("Order", "customer == 7", properties=("objectID",)))
query("tomany_filter_distinct_roots", "SELECT o_orderkey AS objectID FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)", Request("Order", "ANY lineitems.quantity > 49", properties=("objectID",)))
query("m2m_filter", "SELECT s_suppkey AS objectID FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_size = 11)", Request("Supplier", "ANY parts.size == 11", properties=("objectID",)))
query("m2m_count", "SELECT s_suppkey AS objectID, count(DISTINCT l_partkey) AS parts FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1", Request("Supplier", properties=("objectID", N("parts", "parts.@count"))))
query("one_to_one_left", "SELECT d.doc_id AS objectID, l.toxic AS label_toxic FROM documents d LEFT JOIN labels l USING (doc_id)", Request("Document", properties=("objectID", "label.toxic")))
query("objectid_filter", f"{O} WHERE o_orderkey = 42", orders("objectID == 42"))
query("objectid_batch", f"{O} WHERE o_orderkey IN (1, 2, 3, 500, 999999999)", orders("objectID IN {1, 2, 3, 500, 999999999}"))
query("in_subquery", f"{O} WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)", orders("customer IN %@", Request("Customer", "balance > 9000", result="ids")))

# Quantifiers and collection operators
CUSTOMERS = "SELECT c_custkey AS objectID FROM customer c WHERE "
customers = lambda p, *a: Request("Customer", p, a, properties=("objectID",))
keys = lambda p, *a: Request("Order", p, a, properties=("objectID",))
KEYS = "SELECT o_orderkey AS objectID FROM orders o WHERE "
LINES = "FROM lineitem WHERE l_orderkey = o_orderkey"
query("any_tomany", CUSTOMERS + "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", customers("ANY orders.totalPrice > 400000"))
query("any_nested", CUSTOMERS + "EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity = 50)", customers("ANY orders.lineitems.quantity == 50"))
query("any_ci", CUSTOMERS + "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND lower(o_orderpriority) = '1-urgent')", customers('ANY orders.priority ==[c] "1-Urgent"'))
query("all_eq", KEYS + f"EXISTS (SELECT 1 {LINES}) AND NOT EXISTS (SELECT 1 {LINES} AND l_returnflag <> 'R')", keys('ALL lineitems.returnFlag == "R"'))
query("all_gt", KEYS + f"EXISTS (SELECT 1 {LINES}) AND NOT EXISTS (SELECT 1 {LINES} AND NOT (l_quantity > 20))", keys("ALL lineitems.quantity > 20"))
query("any_via_toone", KEYS + "EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_custkey = o_custkey AND s_acctbal < 0)", keys("ANY customer.nation.suppliers.balance < 0"))
query("subquery_exists", KEYS + f"EXISTS (SELECT 1 {LINES} AND l_quantity > 45 AND l_discount < 0.02)", keys("SUBQUERY(lineitems, $l, $l.quantity > 45 AND $l.discount < 0.02).@count > 0"))
query("subquery_count_eq", KEYS + f"(SELECT count(*) {LINES} AND l_returnflag = 'R') = 2", keys('SUBQUERY(lineitems, $l, $l.returnFlag == "R").@count == 2'))
query("subquery_count_zero", KEYS + f"(SELECT count(*) {LINES} AND l_returnflag = 'R') = 0", keys('SUBQUERY(lineitems, $l, $l.returnFlag == "R").@count == 0'))
query("coll_count", KEYS + f"(SELECT count(*) {LINES}) > 5", keys("lineitems.@count > 5"))
query("coll_count_zero", KEYS + f"NOT EXISTS (SELECT 1 {LINES})", keys("lineitems.@count == 0"))
query("coll_sum", KEYS + f"(SELECT sum(l_quantity) {LINES}) > 150", keys("lineitems.quantity.@sum > 150"))
query("coll_avg", KEYS + f"(SELECT avg(l_quantity) {LINES}) > 40", keys("lineitems.quantity.@avg > 40"))
query("coll_min", KEYS + f"(SELECT min(l_quantity) {LINES}) >= 30", keys("lineitems.quantity.@min >= 30"))
query("coll_max", KEYS + f"(SELECT max(l_discount) {LINES}) <= 0.03", keys("lineitems.discount.@max <= 0.03"))
query("any_or_scalar", KEYS + f"EXISTS (SELECT 1 {LINES} AND l_quantity = 1) OR o_totalprice < 5000", keys("ANY lineitems.quantity == 1 OR totalPrice < 5000"))
query("not_any", KEYS + f"NOT EXISTS (SELECT 1 {LINES} AND l_quantity < 40)", keys("NOT (ANY lineitems.quantity < 40)"))
query("count_with_tomany", f"SELECT count(*) AS count FROM orders o WHERE EXISTS (SELECT 1 {LINES} AND l_quantity > 40)", Request("Order", "ANY lineitems.quantity > 40", result="count", limit=3, offset=2))

# Aggregates
query("groupby_count", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1", Request("Order", group_by=("status",), properties=("status", N("n", "count:(objectID)"))))
query("groupby_multi_agg", "SELECT l_returnflag AS returnFlag, l_linestatus AS lineStatus, sum(l_quantity) AS total, min(l_discount) AS low, max(l_extendedprice) AS high, round(avg(l_tax), 6) AS mean FROM lineitem GROUP BY 1, 2", Request("Lineitem", group_by=("returnFlag", "lineStatus"), properties=("returnFlag", "lineStatus", N("total", "sum:(quantity)"), N("low", "min:(discount)"), N("high", "max:(extendedPrice)"), N("mean", "round:(average:(tax), 6)"))))
query("groupby_keypath", "SELECT n_name AS customer_nation_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", Request("Order", group_by=("customer.nation.name",), properties=("customer.nation.name", N("n", "count:(objectID)"))))
query("groupby_expression", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1", Request("Order", group_by=(N("y", "year:(orderDate)"),), properties=(N("n", "count:(objectID)"),)))
query("having_agg", "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 2000000 AND count(*) >= 5", Request("Order", group_by=("customer",), having="sum:(totalPrice) > 2000000 AND count:(objectID) >= 5", properties=("customer", N("n", "count:(objectID)"))))
query("having_key", "SELECT o_orderpriority AS priority, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING o_orderpriority <> '5-LOW'", Request("Order", group_by=("priority",), having='priority != "5-LOW"', properties=("priority", N("top", "max:(totalPrice)"))))
query("global_agg", "SELECT round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, count(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'", Request("Order", 'status == "F"', properties=(N("total", "round:(sum:(totalPrice), 2)"), N("low", "min:(totalPrice)"), N("n", "count:(objectID)"))))
query("stddev_pop_group", "SELECT o_orderpriority AS priority, round(stddev_pop(o_totalprice), 4) AS spread FROM orders GROUP BY 1", Request("Order", group_by=("priority",), properties=("priority", N("spread", "round:(stddev:(totalPrice), 4)"))))
query("groupby_sort_alias", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, segment LIMIT 3", Request("Customer", group_by=("segment",), sort=("-n", "segment"), limit=3, properties=("segment", N("n", "count:(objectID)"))))
query("group_filter", "SELECT c_custkey AS objectID FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING max(c_acctbal) > 9990)", Request("Customer", "nation IN %@", (Request("Nation", "ANY customers.balance > 9990", result="ids"),), properties=("objectID",)))


# Functions
def functions(name: str, entity: str, table: str, key: str, items: list[tuple[str, str, str]], where: str = "", predicate=None) -> None:
    """items: (column, expression, SQL)."""
    sql = f"SELECT {key} AS objectID, " + ", ".join(f"{s} AS {n}" for n, _, s in items) + f" FROM {table}" + (f" WHERE {where}" if where else "")
    query(name, sql, Request(entity, predicate, properties=tuple(N(n, e) for n, e, _ in items), result="objects"), lambda df: df.drop("entityName"))


functions("fn_arith", "Part", "part", "p_partkey", [
    ("a", "add:to:(size, 3)", "p_size + 3"), ("b", "from:subtract:(size, 3)", "p_size - 3"), ("c", "multiply:by:(size, 3)", "p_size * 3"), ("d", "divide:by:(price, from:subtract:(size, 11))", "p_retailprice / nullif(p_size - 11, 0)"),
    ("e", "modulus:by:(size, 7)", "p_size % 7"), ("f", "modulus:by:(size, from:subtract:(size, size))", "CAST(NULL AS INT)"),
])
functions("fn_bitwise", "Part", "part", "p_partkey", [
    ("a", "bitwiseAnd:with:(size, 6)", "p_size & 6"), ("b", "bitwiseOr:with:(size, 6)", "p_size | 6"), ("c", "bitwiseXor:with:(size, 6)", "xor(p_size, 6)"), ("d", "leftshift:by:(size, 2)", "CAST(p_size AS BIGINT) << 2"), ("e", "rightshift:by:(size, 1)", "CAST(p_size AS BIGINT) >> 1"),
])
functions("fn_math", "Customer", "customer", "c_custkey", [
    ("a", "round:(sqrt:(balance), 6)", "CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END"), ("b", "ceiling:(balance)", "CAST(ceil(c_acctbal) AS BIGINT)"), ("c", "floor:(balance)", "CAST(floor(c_acctbal) AS BIGINT)"), ("d", "abs:(balance)", "abs(c_acctbal)"),
    ("e", "round:(exp:(divide:by:(balance, 10000)), 8)", "round(exp(c_acctbal / 10000), 8)"), ("f", "round:(ln:(add:to:(abs:(balance), 1)), 8)", "round(ln(abs(c_acctbal) + 1), 8)"), ("g", "round:(log:(10, add:to:(abs:(balance), 1)), 8)", "round(ln(abs(c_acctbal) + 1) / ln(10), 8)"), ("h", "round:(raise:toPower:(balance, 2), 2)", "round(pow(c_acctbal, 2), 2)"),
])
functions("fn_round_trunc", "Customer", "customer", "c_custkey", [("a", "round:(balance)", "round(c_acctbal)"), ("b", "trunc:(balance, 0)", "trunc(c_acctbal)"), ("c", "trunc:(balance)", "trunc(c_acctbal)")])
functions("fn_greatest_least_null", "Document", "documents LEFT JOIN labels USING (doc_id)", "doc_id", [
    ("a", "greatest:(label.quality, label.toxic, 0)", "CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE greatest(quality, toxic, 0) END"), ("b", "least:(label.quality, 1)", "CASE WHEN quality IS NULL THEN NULL ELSE least(quality, 1) END"),
])
functions("fn_string", "Part", "part", "p_partkey", [
    ("a", "uppercase:(name)", "upper(p_name)"), ("b", "lowercase:(brand)", "lower(p_brand)"), ("c", 'replace:(name, "ring", "band")', "replace(p_name, 'ring', 'band')"), ("d", "length:(name)", "strlen(p_name)"), ("e", 'trim:("  x ")', "'x'"), ("f", "reverse:(name)", "reverse(p_name)"), ("g", "repeat:(brand, 2)", "repeat(p_brand, 2)"), ("h", 'instr:(name, "r")', "instr(p_name, 'r')"), ("i", 'index:(size, "one", "two", "three")', "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END"),
])
functions("fn_pad_slice", "Part", "part", "p_partkey", [
    ("a", 'lpad:(brand, 10, "*")', "lpad(p_brand, 10, '*')"), ("b", 'rpad:(brand, 4, "*")', "rpad(p_brand, 4, '*')"), ("c", "left:(name, 3)", "left(p_name, 3)"), ("d", "right:(name, 3)", "right(p_name, 3)"), ("e", "substring:(name, 2, 4)", "substring(p_name, 2, 4)"), ("f", "substring:(name, 3)", "substring(p_name, 3)"), ("g", "substring:(name, 0, 2)", "''"),
])
functions("fn_regexp", "Part", "part", "p_partkey", [("a", 'regexpReplace:(name, "[aeiou]", "_")', "regexp_replace(p_name, '[aeiou]', '_', 'g')")])
functions("fn_concat_ws", "Part", "part", "p_partkey", [("a", 'concat:("-", name, nullIf:(brand, "Brand#2"), type)', "concat_ws('-', p_name, nullif(p_brand, 'Brand#2'), p_type)")])
functions("fn_null", "Document", "documents LEFT JOIN labels USING (doc_id)", "doc_id", [
    ("a", "isNull:(label.quality)", "quality IS NULL"), ("b", "ifNull:(label.quality, 9)", "coalesce(quality, 9)"), ("c", "nullIf:(label.toxic, 0)", "nullif(toxic, 0)"), ("d", "coalesce:(label.quality, label.toxic, 5)", "coalesce(quality, toxic, 5)"),
])
functions("fn_cast", "Customer", "customer", "c_custkey", [
    ("a", 'cast:(name, "SIGNED")', "TRY_CAST(c_name AS BIGINT)"), ("b", 'cast:(floor:(balance), "CHAR")', "CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)"), ("c", 'cast:("2024-02-29", "DATE")', "DATE '2024-02-29'"),
])
functions("fn_conditional", "Order", "orders", "o_orderkey", [("a", 'IF(totalPrice > 100000 AND status == "F", "x", "y")', "CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'F' THEN 'x' ELSE 'y' END")])
functions("fn_date_parts", "Order", "orders", "o_orderkey", [
    ("a", "year:(orderDate)", "year(o_orderdate)"), ("b", "month:(orderDate)", "month(o_orderdate)"), ("c", "day:(orderDate)", "day(o_orderdate)"), ("d", "hour:(orderDate)", "hour(o_orderdate)"), ("e", "minute:(orderDate)", "minute(o_orderdate)"), ("f", "second:(orderDate)", "second(o_orderdate)"), ("g", "quarter:(orderDate)", "quarter(o_orderdate)"), ("h", "dayOfWeek:(orderDate)", "dayofweek(o_orderdate) + 1"), ("i", "dayOfYear:(orderDate)", "dayofyear(o_orderdate)"), ("j", "lastDay:(orderDate)", "last_day(o_orderdate)"), ("k", "date:(orderDate)", "CAST(o_orderdate AS DATE)"),
])
functions("fn_week_mode0", "Order", "orders", "o_orderkey", [("a", "week:(orderDate)", "CAST(strftime(o_orderdate, '%U') AS INT)")])
functions("fn_date_arith", "Order", "orders", "o_orderkey", [
    ("a", "dateAdd:(orderDate, 5, DAY)", "o_orderdate + INTERVAL 5 DAY"), ("b", "dateSub:(orderDate, 2, MONTH)", "o_orderdate - INTERVAL 2 MONTH"), ("c", 'addTime:(orderDate, "01:02:03")', "o_orderdate + INTERVAL 3723 SECOND"), ("d", 'subTime:(orderDate, "00:30:00")', "o_orderdate - INTERVAL 30 MINUTE"),
])
functions("fn_date_diff", "Lineitem", "lineitem JOIN orders ON l_orderkey = o_orderkey", "l_linenumber", [("a", "dateDiff:(DAY, order.orderDate, shipDate)", "date_sub('day', o_orderdate, l_shipdate)"), ("b", "dateDiff:(HOUR, order.orderDate, shipDate)", "date_sub('hour', o_orderdate, l_shipdate)")], "l_shipdate >= o_orderdate", "shipDate >= order.orderDate")
functions("fn_date_format", "Order", "orders", "o_orderkey", [("a", 'dateFormat:(orderDate, "%Y/%m-%d %H:%i")', "strftime(o_orderdate, '%Y/%m-%d %H:%M')")])
functions("fn_unixtime", "Order", "orders", "o_orderkey", [("a", "unixTimestamp:(orderDate)", "CAST(epoch(o_orderdate) AS BIGINT)"), ("b", "year:(fromUnixTime:(unixTimestamp:(orderDate)))", "year(o_orderdate)")])
query("fn_in_predicate", f"{PART} WHERE upper(p_name) = 'SMALL RING'", parts('uppercase:(name) == "SMALL RING"'))

# Inheritance, derived and composite attributes
EVENTS = "SELECT event_id AS objectID, event_type AS entityName, value FROM events"
events = lambda e, p=None, **m: Request(e, p, properties=("objectID", "entityName", "value"), **m)
query("inherit_root", EVENTS, events("Event"))
query("inherit_branch", f"{EVENTS} WHERE event_type IN ('purchase', 'signup') AND value > 50", events("CommerceEvent", "value > 50"))
query("inherit_leaf_only", f"{EVENTS} WHERE event_type = 'click'", events("Click"))
query("inherit_without_heirs", f"{EVENTS} WHERE 1 = 0", events("CommerceEvent", heirs=False))
query("derived_rowlocal", "SELECT o_orderkey AS objectID, o_totalprice * 2 AS doubled, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS big FROM orders", Request("Order", properties=("objectID", "doubled", "big")))
query("derived_keypath", "SELECT c_custkey AS objectID, r_name AS regionName FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", Request("Customer", 'regionName != "ASIA"', properties=("objectID", "regionName")))
query("derived_count", "SELECT o_orderkey AS objectID, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lineCount FROM orders", Request("Order", properties=("objectID", "lineCount")))
query("derived_nested", "SELECT o_orderkey AS objectID, (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey) AS customer_orderCount FROM orders o", Request("Order", properties=("objectID", "customer.orderCount")))
query("composite_filter", "SELECT l_orderkey AS \"order\", l_linenumber AS objectID, l_quantity AS pricing_quantity FROM lineitem WHERE l_discount = 0.05 AND l_quantity > 30", Request("Lineitem", "pricing.discount == 0.05 AND pricing.quantity > 30", properties=("order", "objectID", "pricing.quantity")))
query("template_query", f"{O} WHERE o_totalprice > 250000 AND o_orderpriority = '3-MEDIUM'", from_template(MODEL, "ordersOver", {"LIMIT": 250000, "PRIORITY": "3-MEDIUM"}))

# Nested results and pages, flattened for comparison
NAMES = lambda c, f: F.array_join(F.array_sort(F.transform(c, f)), ",")
query("nest_tomany", "SELECT r_regionkey AS objectID, r_name AS name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region", Request("Region", shape={"name": None, "nations": {"name": None}}), lambda df: df.select("objectID", "name", NAMES("nations", lambda x: x["name"]).alias("nations")))
query("nest_two_tomany", "SELECT n_nationkey AS objectID, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation", Request("Nation", shape={"customers": {"name": None}, "suppliers": {"name": None, "balance": None}}), lambda df: df.select("objectID", F.size("customers").cast("bigint").alias("customers"), F.size("suppliers").cast("bigint").alias("suppliers")))
query("nest_three_level", "SELECT r_regionkey AS objectID, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", Request("Region", shape={"nations": {"customers": {"orders": {"totalPrice": None}}}}), lambda df: df.select("objectID", F.aggregate("nations", F.lit(0).cast("bigint"), lambda a, n: a + F.aggregate(n["customers"], F.lit(0).cast("bigint"), lambda b, c: b + F.size(c["orders"]))).alias("orders"), F.aggregate("nations", F.lit(0).cast("bigint"), lambda a, n: a + F.size(n["customers"])).alias("customers")))
query("nest_pruned_by_predicate", f"SELECT o_orderkey AS objectID, (SELECT count(*) {LINES} AND l_quantity > 48) AS lineitems FROM orders o WHERE EXISTS (SELECT 1 {LINES} AND l_quantity > 48)", Request("Order", "ANY lineitems.quantity > 48", shape={"lineitems": {"quantity": None}}), lambda df: df.select("objectID", F.size("lineitems").cast("bigint").alias("lineitems")))
query("nest_toone", "SELECT c_custkey AS objectID, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", Request("Customer", shape={"nation": {"name": None, "region": {"name": None}}}), lambda df: df.select("objectID", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region")))
query("paged_roots", "WITH p AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15 OFFSET 5) SELECT o_orderkey AS objectID, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lineitems FROM p", Request("Order", sort=("-totalPrice", "objectID"), limit=15, offset=5, shape={"lineitems": {"quantity": None}}), lambda df: df.select("objectID", F.size("lineitems").cast("bigint").alias("lineitems")))
query("paged_sort_tomany_min", "SELECT c_custkey AS objectID FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS low FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY low NULLS FIRST, c_custkey LIMIT 12", Request("Customer", sort=("orders.totalPrice", "objectID"), limit=12, properties=("objectID",)))
query("paged_sort_tomany_max", "SELECT c_custkey AS objectID FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY top DESC NULLS LAST, c_custkey LIMIT 12", Request("Customer", sort=("-orders.totalPrice", "objectID"), limit=12, properties=("objectID",)))
query("ordered_tomany", "SELECT o_orderkey AS objectID, coalesce((SELECT string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS numbers FROM orders", Request("Order", shape={"lineitems": {"number": None}}), lambda df: df.select("objectID", F.array_join(F.transform("lineitems", lambda x: x["number"].cast("string")), ",").alias("numbers")))
query("sensitive_mask", "SELECT c_custkey AS objectID, c_name AS name, '***' AS balance FROM customer", Request("Customer", properties=("objectID", "name", "balance")))
query("sensitive_clear", "SELECT c_custkey AS objectID, 'Customer' AS entityName, c_acctbal AS balance FROM customer", Request("Customer", properties=("balance",), result="objects"))
query("json_result", "SELECT '{\"objectID\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS json FROM region", Request("Region", properties=("objectID", "name")), lambda df: df.select(F.to_json(F.struct("objectID", "name")).alias("json")))

# Sensitive values: shown as ***, sorted, grouped and told apart by what the store holds
query("sensitive_sort", "SELECT c_custkey AS objectID, '***' AS balance FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 4", Request("Customer", sort=("-balance", "objectID"), limit=4, properties=("objectID", "balance")))
query("sensitive_expression", "SELECT c_custkey AS objectID, '***' AS twice, '***' AS owed, c_name AS name FROM customer", Request("Customer", properties=("objectID", N("twice", "multiply:by:(balance, 2)"), N("owed", 'IF(balance < 0, "yes", "no")'), "name")))
query("sensitive_group", "SELECT c_mktsegment AS segment, '***' AS top, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING max(c_acctbal) > 0", Request("Customer", group_by=("segment",), properties=(N("top", "max:(balance)"), N("n", "count:(balance)")), having="max:(balance) > 0"))
query("sensitive_group_key", "SELECT '***' AS owes, count(*) AS n FROM customer GROUP BY c_acctbal < 0", Request("Customer", group_by=(N("owes", 'IF(balance < 0, "yes", "no")'),), properties=(N("n", "count:(objectID)"),)))
query("sensitive_distinct", "SELECT '***' AS balance, segment FROM (SELECT DISTINCT c_acctbal, c_mktsegment AS segment FROM customer)", Request("Customer", properties=("balance", "segment"), distinct=True))
query("sensitive_nested", "SELECT n_nationkey AS objectID, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS hidden FROM nation", Request("Nation", shape={"customers": {"name": None, "balance": None}}), lambda df: df.select("objectID", F.size(F.filter("customers", lambda c: c["balance"] == "***")).cast("bigint").alias("hidden")))
query("sensitive_keypath", "SELECT o_orderkey AS objectID, '***' AS customer_balance FROM orders", Request("Order", properties=("objectID", "customer.balance")))

# Requests, tables, long lists, sets and blocks inside predicates
query("scalar_request", f"{O} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F')", orders("totalPrice > %@", Request("Order", 'status == "F"', properties=(N("mean", "average:(totalPrice)"),))))
query("scalar_count", "SELECT p_partkey AS objectID FROM part WHERE p_size = (SELECT count(*) FROM region)", Request("Part", "size == %@", (Request("Region", result="count"),), properties=("objectID",)))
query("long_list", f"{O} WHERE o_orderkey < 1000 AND o_orderkey % 2 = 0", orders("objectID IN %@", list(range(0, 1000, 2))))
query("not_in_subquery", f"{O} WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", orders("NOT (customer IN %@)", Request("Customer", 'segment == "BUILDING"', result="ids")))
query("in_subquery_or", f"{O} WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) OR o_totalprice > 300000", orders("customer IN %@ OR totalPrice > 300000", Request("Customer", "balance > 9000", result="ids")))
query("block_predicate", f"{O} WHERE o_totalprice % 7 < 1 AND o_orderstatus = 'O'", orders('%@ AND status == "O"', Block(lambda get: get("totalPrice") % 7 < 1)))
query("block_value", "SELECT o_orderkey AS objectID, length(c_name) + o_orderkey AS mixed FROM orders JOIN customer ON o_custkey = c_custkey", Request("Order", properties=("objectID", N("mixed", Block(lambda get: F.length(get("customer.name")) + get("objectID")), "bigint"))))
query("set_union", "SELECT n_nationkey AS objectID FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 10) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 10)", Request("Nation", "10 IN customers UNION suppliers", properties=("objectID",)))
query("set_intersect", "SELECT r_regionkey AS objectID FROM region WHERE r_name IN ('ASIA', 'EUROPE')", Request("Region", 'name IN {"ASIA", "EUROPE", "AFRICA"} INTERSECT {"EUROPE", "ASIA", "none"}', properties=("objectID",)))
query("set_minus", "SELECT n_nationkey AS objectID FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 12) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 12)", Request("Nation", "12 IN customers MINUS suppliers", properties=("objectID",)))
query("diacritic", "SELECT p_partkey AS objectID FROM part WHERE p_name = 'small ring'", Request("Part", 'name ==[d] "smäll rīng"', properties=("objectID",)))
functions("fn_regexp_groups", "Part", "part", "p_partkey", [("a", expression('regexpReplace:(name, "([aeiou])([a-z])", %@)', r"\2$\1"), r"regexp_replace(p_name, '([aeiou])([a-z])', '\2$\1', 'g')")])
query("all_nested", "SELECT n_nationkey AS objectID FROM nation n WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND NOT (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 100))))", Request("Nation", "ALL customers.orders.totalPrice > 100", properties=("objectID",)))
query("any_or", "SELECT c_custkey AS objectID FROM customer WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", Request("Customer", 'segment == "BUILDING" OR ANY orders.totalPrice > 250000', properties=("objectID",)))

# A many-to-many of an entity with itself: nations and those whose key is three times theirs, modulo 25
FRIENDS = Model(Entity("Nation", "nation", "n_nationkey", [A("name", column="n_name")], [R("follows", "Nation", bridge=("friends", "a", "b"), many=True, inverse="followers"), R("followers", "Nation", bridge=("friends", "b", "a"), many=True, inverse="follows")]))


def _friends(s: Store) -> Store:
    pairs = s.table("nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * 3 % 25).alias("b"))
    return Store(s.spark, FRIENDS, {"nation": s.table("nation"), "friends": pairs})


PAIRS = "WITH friends AS (SELECT n_nationkey AS a, n_nationkey * 3 % 25 AS b FROM nation)"


@made(f"{PAIRS} SELECT n_nationkey AS objectID, (SELECT count(*) FROM friends WHERE b = n_nationkey) AS followers FROM nation WHERE EXISTS (SELECT 1 FROM friends JOIN nation f ON f.n_nationkey = b WHERE a = nation.n_nationkey AND f.n_name LIKE 'NATION_1%')")
def m2m_self(s: Store) -> DataFrame:
    return fetch(_friends(s), Request("Nation", 'ANY follows.name BEGINSWITH "NATION_1"', properties=("objectID", N("followers", "followers.@count"))))


@made(f"{PAIRS} SELECT n_nationkey AS objectID, coalesce((SELECT string_agg(f.n_name, ',' ORDER BY f.n_name) FROM friends JOIN nation f ON f.n_nationkey = a WHERE b = nation.n_nationkey), '') AS followers FROM nation")
def m2m_self_nested(s: Store) -> DataFrame:
    df = fetch(_friends(s), Request("Nation", shape={"followers": {"name": None}}))
    return df.select("objectID", NAMES("followers", lambda x: x["name"]).alias("followers"))


SUBTYPES = Model(
    Entity("Event", "events", "event_id", [A("kind", column="event_type"), A("value", "double")], [R("next", "Purchase", key="next_id")], abstract=True, discriminator="event_type"),
    Entity("Purchase", "events", "event_id", parent="Event", tag="purchase"), Entity("Click", "events", "event_id", parent="Event", tag="click"),
)


@made("SELECT e.event_id AS objectID, p.value AS next_value FROM events e LEFT JOIN events p ON p.event_id = e.event_id + 1 AND p.event_type = 'purchase' WHERE e.event_type = 'click'")
def toone_subentity(s: Store) -> DataFrame:
    """A to-one whose target is a sub-entity: rows of other kinds are no match, and their owners stay."""
    rows = s.table("events").withColumn("next_id", F.col("event_id") + 1)
    return fetch(Store(s.spark, SUBTYPES, {"events": rows}), Request("Click", properties=("objectID", "next.value")))


@made("WITH p AS (SELECT n_nationkey FROM nation ORDER BY n_name DESC NULLS LAST, n_nationkey LIMIT 3) SELECT n_nationkey AS objectID, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS orders FROM p")
def paged_nested(s: Store) -> DataFrame:
    df = fetch(s, Request("Nation", sort=("-name", "objectID"), limit=3, shape={"customers": {"orders": {"totalPrice": None}}}))
    sizes = F.aggregate("customers", F.lit(0).cast("bigint"), lambda n, c: n + F.size(c["orders"]))
    return df.select("objectID", F.size("customers").cast("bigint").alias("customers"), sizes.alias("orders"))


@made("SELECT '{\"objectID\":' || r_regionkey || ',\"entityName\":\"Region\",\"name\":\"' || r_name || '\"}' AS json FROM region")
def json_objects(s: Store) -> DataFrame:
    return as_json(fetch(s, Request("Region", properties=("name",), result="objects")))


@made("SELECT r_regionkey AS objectID, r_name AS name FROM region")
def store_registered(s: Store) -> DataFrame:
    """A kind of store of our own, beside Parquet and XML."""
    tables.register("demo", lambda spark, model, path: Store(spark, model, {**s.tables}))
    return fetch(tables.opened(s.spark, MODEL, "demo", "nowhere"), Request("Region", properties=("objectID", "name")))


@made("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(r_regionkey, r_name)")
def memory_rows(s: Store) -> DataFrame:
    return tables.memory_table(s.spark, [{"r_regionkey": 1, "r_name": "a"}, {"r_regionkey": 2}], "r_regionkey int, r_name string")
