"""Writes as functions from tables to tables: batch changes, upserts, saves, delete rules, links.

Nothing is changed in place; a result is a plan over the old tables, which a caller may write elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.model import Attribute, Entity, ModelError, Store
from orrery.operators.expressions import predicate
from orrery.plans.compiler import Plan


def _key(store: Store, entity: Entity) -> str:
    top = store.model.root(entity)
    if top.identity:
        raise ModelError(f"rows of {top.name} are told apart by {', '.join(top.identity)}, not by {top.key} alone")
    return top.key


def _table(store: Store, entity: Entity) -> str:
    return store.model.root(entity).table


def matching(store: Store, entity_name: str, tree, *args) -> DataFrame:
    """The keys of an entity's rows for which a predicate is true, one each."""
    entity = store.model[entity_name]
    _key(store, entity)
    plan = Plan(store, entity)
    plan.restrict(predicate(tree, *args))
    return plan.df.select(plan.key_column().alias("__key")).distinct()


def matched(store: Store, entity_name: str, tree=True, *args, result: str = "status") -> DataFrame:
    """What a batch change of the rows that meet a predicate reports: status, their ids (objectID), or their count.

    Rows count whether the change alters their values or not.
    """
    plan = Plan(store, store.model[entity_name])
    if tree is not True:
        plan.restrict(predicate(tree, *args))
    if result == "ids":
        return plan.df.select(plan.key_column().alias("objectID"))
    count = plan.df.agg(F.count("*").alias("count"))
    return count if result == "count" else count.select(F.lit(True).alias("status"))


def numbered(rows: DataFrame, key: str, after: DataFrame) -> DataFrame:
    """rows with null keys replaced by numbers above the largest key of `after`, without gaps.

    The rows are written once; each part is numbered from where the one before it ends, so that no task
    sees more than its own part, however many rows are equal.
    """
    from orrery.sources.tables import cut

    given, others = rows.where(F.col(key).isNotNull()), [c for c in rows.columns if c != key]
    placed = cut(rows.where(F.col(key).isNull()).select(*others, F.monotonically_increasing_id().alias("__at")))
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a number for each part
    if not sizes:
        return given
    top = after.select(key).unionByName(given.select(key)).agg(F.max(key)).first()[0] or 0
    starts, kind = [], rows.schema[key].dataType
    for p in sorted(sizes):
        starts.append((p, top + 1))
        top += sizes[p]
    base = placed.sparkSession.createDataFrame(starts, "__p bigint, __start bigint")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    made = placed.withColumn("__p", part).join(F.broadcast(base), "__p")  # a row for each part
    return given.unionByName(made.withColumn(key, (F.col("__start") + inside).cast(kind)).select(*rows.columns))


def batch_insert(store: Store, entity_name: str, rows: DataFrame | Iterable[dict] | Callable[[], Iterator[dict]]) -> Store:
    """Adds rows by physical column names; missing columns are null, missing keys are allotted."""
    entity = store.model[entity_name]
    if entity.abstract:
        raise ModelError(f"{entity_name} is abstract")
    table = _table(store, entity)
    old = store.table(table)
    if not isinstance(rows, DataFrame):
        found = list(rows() if callable(rows) else rows)
        rows = store.spark.createDataFrame([tuple(r.get(c) for c in old.columns) for r in found], old.schema)
    top = store.model.root(entity)
    if top.discriminator:
        rows = rows.withColumn(top.discriminator, F.lit(entity.tag or entity.name))
    new = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in old.columns))
    if top.identity:  # such rows bring their own values
        return store.with_tables(**{table: old.unionByName(new)})
    return store.with_tables(**{table: old.unionByName(numbered(new, top.key, old))})


def _hit(plan: Plan, tree, args: tuple) -> Column:
    """Whether a row of plan, which reads a whole table, is one of its entity's that meet a predicate; never null."""
    condition = F.lit(True) if tree is True else plan.test(predicate(tree, *args))
    tags = plan.model.tags(plan.entity)
    if tags is not None:
        condition = condition & F.col(f"{plan.alias}__{plan.model.root(plan.entity).discriminator}").isin(tags)
    return F.coalesce(condition, F.lit(False))


def batch_update(store: Store, entity_name: str, changes: dict[str, object], tree=True, *args) -> Store:
    """Sets attributes of the rows that meet a predicate: to constants, or to expressions given as `expression()` trees."""
    entity = store.model[entity_name]
    table = _table(store, entity)
    old = store.table(table)
    plan = Plan(store, entity, rows=old)
    hit = _hit(plan, tree, args)
    new = {}
    for name, given in changes.items():
        a = store.model.attribute(entity, name)
        relation = store.model.relationship(entity, name)
        column = a.physical if a else relation.key if relation else None
        if column is None or (a and (a.derived or a.transient)):
            raise ModelError(f"{name} cannot be set")
        literal = given is None or isinstance(given, (str, int, float, bool))
        new[column] = (F.lit(given) if literal else plan.value(given)).cast(old.schema[column].dataType)
    rows = plan.df.select(*((F.when(hit, new[c]).otherwise(F.col(f"r__{c}")) if c in new else F.col(f"r__{c}")).alias(c) for c in old.columns))
    return store.with_tables(**{table: rows})


def batch_delete(store: Store, entity_name: str, tree=True, *args) -> Store:
    """Removes rows that meet a predicate; rows for which it is null stay. No delete rules run, and no key is needed."""
    entity = store.model[entity_name]
    table = _table(store, entity)
    old = store.table(table)
    plan = Plan(store, entity, rows=old)
    hit = _hit(plan, tree, args)
    return store.with_tables(**{table: plan.df.where(~hit).select(*(F.col(f"r__{c}").alias(c) for c in old.columns))})


def outcome(before: DataFrame, after: DataFrame, key: str, result: str = "status") -> DataFrame:
    """How two versions of a table differ: status, the ids of rows that do, or their count. matched() is cheaper where the predicate is known."""
    from orrery.streaming.history import difference

    changed = difference(before, after, key).select(F.col("id").alias("objectID"))
    if result == "ids":
        return changed
    count = changed.agg(F.count("*").alias("count"))
    return count if result == "count" else count.select(F.lit(True).alias("status"))


def upsert(old: DataFrame, new: DataFrame, unique: tuple[str, ...], key: str, order: str | None = None) -> DataFrame:
    """New rows replace old ones of equal unique columns, which keep their key; the others are added.

    The columns count as a tuple. A null in it equals nothing, so rows with one are all added. Of new rows
    with equal unique columns the last by `order` (else by key) counts.
    """
    whole = F.lit(True)
    for u in unique:
        whole = whole & F.col(u).isNotNull()
    last = Window.partitionBy(*unique).orderBy(F.col(order or key).desc_nulls_last(), F.col(key).desc_nulls_last())
    fresh = new.where(whole).withColumn("__r", F.row_number().over(last)).where("__r = 1").select(*old.columns, F.lit(True).alias("__there"))
    a, b = old.alias("a"), fresh.alias("b")
    same = [F.col(f"a.{u}") == F.col(f"b.{u}") for u in unique]
    rows, there = a.join(b, same, "full_outer"), F.coalesce(F.col("b.__there"), F.lit(False))
    met = rows.select(*((F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c == key else F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c) for c in old.columns))
    return met.unionByName(new.where(~whole).select(*old.columns))


def updated(old: DataFrame, deltas: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of old taken from the delta row of equal key, where there is one. A key with several delta rows is an error."""
    if not columns:
        return old
    value = F.struct(*(F.col(c).alias(f"__{c}") for c in columns))
    d = deltas.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"), F.any_value(value).alias("__new"))
    twice = F.raise_error(F.concat(F.lit("several changes of "), F.col("__k").cast("string")))
    d = d.select("__k", F.when(F.col("__n") > 1, twice).otherwise(F.col("__new")).alias("__new"))
    rows = old.join(d, old[key] == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    return rows.select(*((F.when(hit, F.col(f"__new.__{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in old.columns))


def save(store: Store, entity_name: str, inserts: DataFrame | None = None, updates: DataFrame | None = None, deletes: DataFrame | None = None, version: str | None = None) -> Store:
    """Inserts, then updates (whole rows by key), then deletes (rows with the key); versions start at 1 and count updates."""
    entity = store.model[entity_name]
    table, key = _table(store, entity), _key(store, entity)
    rows = store.table(table)
    if inserts is not None:
        fresh = inserts.withColumn(version, F.lit(1).cast(rows.schema[version].dataType)) if version else inserts
        rows = upsert(rows, numbered(fresh.select(*rows.columns), key, rows), (key,), key)
    if updates is not None:
        columns = [c for c in updates.columns if c not in (key, version)]
        rows = updated(rows, updates, key, columns)
        if version:
            touched = updates.select(F.col(key).alias("__k")).distinct()
            rows = rows.join(touched, rows[key] == F.col("__k"), "left").withColumn(version, F.col(version) + F.when(F.col("__k").isNotNull(), 1).otherwise(0)).drop("__k")
    if deletes is not None:
        rows = rows.join(deletes.select(F.col(key).alias("__k")), rows[key] == F.col("__k"), "left_anti")
    return store.with_tables(**{table: rows})


def denials(store: Store, entity_name: str, keys: DataFrame) -> DataFrame:
    """(relationship, id): rows that deny rules protect because members still refer to them."""
    entity, found = store.model[entity_name], None
    for e in store.model.line(entity):
        for r in e.relationships:
            if r.delete_rule == "deny" and r.many:
                child, owner = Plan(store, store.model[entity_name]).members(r)
                held = child.df.select(owner.alias("__owner")).distinct()
                rows = keys.join(held, F.col("__key") == F.col("__owner"), "left_semi").select(F.lit(r.name).alias("relationship"), F.col("__key").alias("id"))
                found = rows if found is None else found.unionByName(rows)
    return found if found is not None else keys.select(F.lit("").alias("relationship"), F.col("__key").alias("id")).where(F.lit(False))


def delete(store: Store, entity_name: str, tree, *args, check: bool = True) -> Store:
    """Removes matching rows under their delete rules.

    Deny rules raise if a member is left. Cascades follow the model from owner to member, so their depth is
    that of the model; a relationship of an entity with itself is followed until no row is added.
    """
    from orrery.sources.tables import cut

    pending = [(entity_name, matching(store, entity_name, tree, *args))]
    while pending:
        name, keys = pending.pop(0)
        entity = store.model[name]
        if check and (denied := denials(store, name, keys).limit(1).collect()):
            raise ModelError(f"denied by {denied[0]['relationship']}")
        for e in store.model.line(entity):
            for r in e.relationships:
                if r.bridge:
                    continue
                target = store.model[r.target]
                if not r.inverse_key:
                    continue
                rows, target_key = store.table(_table(store, target)), store.model.root(target).key
                if r.delete_rule == "cascade" and r.many:
                    members = rows.join(keys, rows[r.inverse_key] == F.col("__key"), "left_semi").select(F.col(target_key).alias("__key"))
                    if target is entity:
                        known = 0
                        while True:
                            wider = cut(keys.unionByName(members).distinct())
                            if (n := wider.count()) == known:
                                break
                            keys, known = wider, n
                            members = rows.join(keys, rows[r.inverse_key] == F.col("__key"), "left_semi").select(F.col(target_key).alias("__key"))
                    else:
                        deeper = [x for x in store.model.line(target) for x in x.relationships if x.inverse_key]
                        if deeper:
                            pending.append((r.target, members.distinct()))
                        else:
                            store = store.with_tables(**{_table(store, target): rows.join(keys, rows[r.inverse_key] == F.col("__key"), "left_anti")})
                elif r.delete_rule == "nullify" and r.many:
                    hit = rows.join(keys.withColumnRenamed("__key", "__gone"), rows[r.inverse_key] == F.col("__gone"), "left")
                    store = store.with_tables(**{_table(store, target): hit.withColumn(r.inverse_key, F.when(F.col("__gone").isNull(), F.col(r.inverse_key))).select(*rows.columns)})
        old = store.table(_table(store, entity))
        store = store.with_tables(**{_table(store, entity): old.join(keys, old[_key(store, entity)] == F.col("__key"), "left_anti")})
    return store


def linked(pairs: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """A pair table with links added once each and others removed."""
    rows = pairs if add is None else pairs.unionByName(add)
    rows = rows.distinct()
    return rows if remove is None else rows.join(remove, pairs.columns, "left_anti")


def violations(store: Store, entity_name: str) -> DataFrame:
    """(id, attribute, rule): rows that break a required value, a bound (of text: its length), a pattern or a validator."""
    entity = store.model[entity_name]
    plan, found = Plan(store, entity), []
    for a in store.model.attributes(entity):
        if a.derived or a.parts or a.transient:
            continue
        c = plan.path((a.name,))
        size = F.length(c) if a.kind == "string" else c
        rules: list[tuple[str, Column]] = []
        if not a.optional:
            rules.append(("required", c.isNull()))
        if a.minimum is not None:
            rules.append(("minimum", size < a.minimum))
        if a.maximum is not None:
            rules.append(("maximum", size > a.maximum))
        if a.validator is not None:
            rules.append(("validator", ~a.validator(c)))
        if a.pattern is not None:
            rules.append(("pattern", ~c.rlike(f"^(?:{a.pattern})$")))
        found += [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(a.name).alias("attribute"), F.lit(rule).alias("rule"))) for rule, broken in rules]
    if not found:
        return plan.df.select(plan.key_column().alias("id"), F.lit("").alias("attribute"), F.lit("").alias("rule")).where(F.lit(False))
    rows = plan.df.select(plan.key_column().alias("id"), F.explode(F.array_compact(F.array(*found))).alias("x"))
    return rows.select("id", "x.attribute", "x.rule")


def encoded(df: DataFrame, attribute: Attribute, codecs: dict) -> DataFrame:
    """Applies a transformable attribute's encoder, a function of a column (built-in or a UDF)."""
    return df.withColumn(attribute.physical, codecs[attribute.codec][0](F.col(attribute.physical)))


def decoded(df: DataFrame, attribute: Attribute, codecs: dict) -> DataFrame:
    return df.withColumn(attribute.physical, codecs[attribute.codec][1](F.col(attribute.physical)))


def fetched(store: Store, entity_name: str, property_name: str, limit_keys: DataFrame | None = None, where=None) -> DataFrame:
    """(source_id, target_id): a fetched property for every row of its entity, as one join on its equal terms.

    limit_keys (its first column) names the rows to ask for, where the targets to look at; both hold before the join.
    """
    from orrery.operators.expressions import And, Compare, Path

    entity = store.model[entity_name]
    saved = next((p for e in store.model.line(entity) for p in e.fetched if p.name == property_name), None)
    if saved is None:
        raise ModelError(f"no fetched property {property_name!r}")
    tree = predicate(saved.predicate)
    source, target = Plan(store, entity), Plan(store, store.model[saved.target])
    source.alias, wanted = "r", {}
    tests = tree.parts if isinstance(tree, And) else (tree,)

    def is_source(node) -> bool:
        return isinstance(node, Path) and node.parts[0] == "$FETCH_SOURCE"

    conditions = []
    for t in tests:
        if not isinstance(t, Compare):
            raise ModelError("a fetched property joins comparisons by AND")
        sides = []
        for node in (t.left, t.right):
            if is_source(node):
                name = f"s__{'_'.join(node.parts[1:])}"
                wanted[name] = source.path(node.parts[1:])
                sides.append(("s", name))
            else:
                sides.append(("t", node))
        conditions.append((t.op, sides))
    if limit_keys is not None:
        asked = limit_keys.select(F.col(limit_keys.columns[0]).alias("__asked"))
        source.df = source.df.join(asked, source.key_column() == F.col("__asked"), "left_semi")
    if where is not None:
        target.restrict(predicate(where))
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if not any(op == "==" for op, _ in conditions):
        raise ModelError("a fetched property needs an equal term to join on")
    left = source.df.select(source.key_column().alias("source_id"), *(c.alias(n) for n, c in wanted.items()))
    values = {f"t__{i}_{j}": target.value(x) for i, (_, sides) in enumerate(conditions) for j, (kind, x) in enumerate(sides) if kind == "t"}
    right = target.df.select(target.key_column().alias("target_id"), *(c.alias(n) for n, c in values.items()))
    named = [(op, [x if kind == "s" else f"t__{i}_{j}" for j, (kind, x) in enumerate(sides)]) for i, (op, sides) in enumerate(conditions)]
    joins = lambda op, names: op == "==" and (names[0] in wanted) != (names[1] in wanted)
    equal = [names if names[0] in wanted else names[::-1] for op, names in named if joins(op, names)]
    return _joined_in_cuts(left, right, equal, [ops[op](*map(F.col, names)) for op, names in named if not joins(op, names)]).select("source_id", "target_id")


#: Rows of a group's side that meet as many of its other side at once; a side with more is cut.
ROWS_A_CUT = 4096
#: Rows of both sides that one task joins, where they make few pairs.
ROWS_A_TASK = 1_000_000


def _joined_in_cuts(left: DataFrame, right: DataFrame, equal: list[list[str]], conditions: list) -> DataFrame:
    """The inner join by the equality of the column pairs in equal and by conditions.

    The pairs of a group (rows of equal values) are dealt in blocks: each side of it is cut by a hash of
    its rows, and every cut of one side meets every cut of the other. The number of tasks follows the number
    of pairs, so that none makes many more than ROWS_A_CUT squared, however large a group is.
    """
    by = [f"__k{i}" for i in range(len(equal))] or ["__k"]
    sides = [side.withColumns({k: F.col(pair[at]) for k, pair in zip(by, equal)} or {"__k": F.lit(1)}) for at, side in enumerate((left, right))]
    sizes = [side.groupBy(*by).agg(F.count("*").alias(n)) for side, n in zip(sides, ("__rows1", "__rows2"))]
    groups = sizes[0].join(sizes[1], by)
    rows, pairs = groups.agg(F.sum(F.col("__rows1") + F.col("__rows2")), F.sum(F.col("__rows1").cast("double") * F.col("__rows2"))).first()
    tasks = 1 + int((rows or 0) // ROWS_A_TASK + (pairs or 0) // ROWS_A_CUT**2)
    # At most one group in ROWS_A_CUT rows has a side to cut.
    large = groups.where(F.greatest("__rows1", "__rows2") > ROWS_A_CUT).select(*by, *(F.ceil(F.col(n) / ROWS_A_CUT).alias(c) for n, c in (("__rows1", "__cuts1"), ("__rows2", "__cuts2"))))
    cut = []
    for side, own, other in ((sides[0], 1, 2), (sides[1], 2, 1)):
        columns = [c for c in side.columns if c not in by]
        mine = F.pmod(F.xxhash64(*columns), F.coalesce(f"__cuts{own}", F.lit(1)))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"__cuts{other}", F.lit(1)) - 1))
        dealt = side.join(F.broadcast(large), by, "left").select(*by, *columns, mine.alias(f"__cut{own}"), every.alias(f"__cut{other}"))
        cut.append(dealt.repartition(tasks, *by, "__cut1", "__cut2"))
    return cut[0].join(cut[1], [*by, "__cut1", "__cut2"]).where(reduce(lambda a, b: a & b, conditions, F.lit(True)))
