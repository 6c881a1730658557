"""From fetch requests to DataFrame plans.

A Plan grows one DataFrame: columns are named alias__column, a to-one hop of a key path adds one left
join (once for each path), and whatever concerns a to-many is aggregated by its key before it is joined
(once for each path and test). Existence tests that every row must pass are semi and anti joins; under OR
they join distinct keys and test for a match. No join multiplies rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.library import AGGREGATES, CONSTANT_FUNCTIONS, FUNCTIONS
from orrery.model import KINDS, Attribute, Entity, ModelError, Relationship, Store
from orrery.operators.expressions import FLIPPED, And, Block, Call, Combined, Compare, If, Not, Or, Path, Subquery, Truth, Value, Variable, expression, kids, nodes, predicate
from orrery.plans.request import Named, Request

_COLLECTION = {"@count": F.count, "@sum": F.sum, "@avg": F.avg, "@min": F.min, "@max": F.max}
_SETS = {"UNION": F.array_union, "INTERSECT": F.array_intersect, "MINUS": F.array_except}
#: Lists of values longer than this are joined instead of being written into the condition.
LONG_LIST = 200
MASK = "***"


class Plan:
    def __init__(self, store: Store, entity: Entity, heirs: bool = True, rows: DataFrame | None = None) -> None:
        self.store, self.model, self.entity = store, store.model, entity
        self.alias, self.joined, self.made, self.known = "r", {(): entity}, 0, {}
        self.df = self._named(store.scan(entity, heirs) if rows is None else rows, self.alias)

    @staticmethod
    def _named(df: DataFrame, alias: str) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(f"{alias}__{c}") for c in df.columns))

    def _alias(self, hops: tuple[str, ...]) -> str:
        return "_".join((self.alias, *hops))

    def _fresh(self, what: str) -> str:
        self.made += 1
        return f"x{self.made}_{what}"

    def key_name(self, hops: tuple[str, ...] = ()) -> str:
        return f"{self._alias(hops)}__{self.model.root(self.joined[hops]).key}"

    def key_column(self, hops: tuple[str, ...] = ()) -> Column:
        return F.col(self.key_name(hops))

    # Key paths

    def hop(self, hops: tuple[str, ...], name: str) -> tuple[str, ...]:
        """Joins a to-one relationship, unless it is joined already."""
        relation, to = self.model.relationship(self.joined[hops], name), (*hops, name)
        if to in self.joined:
            return to
        target = self.model[relation.target]
        alias, own = self._alias(to), self._alias(hops)
        rows = self._named(self.store.scan(target), alias)
        if relation.key:
            on = F.col(f"{own}__{relation.key}") == F.col(f"{alias}__{self.model.root(target).key}")
        else:
            on = self.key_column(hops) == F.col(f"{alias}__{relation.inverse_key}")
        self.df = self.df.join(rows, on, "left")
        self.joined[to] = target
        return to

    def split(self, parts: tuple[str, ...], hops: tuple[str, ...] = ()) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Follows to-one relationships as far as they go: the hops joined, and what is left of the path."""
        rest = list(parts)
        while rest:
            relation = self.model.relationship(self.joined[hops], rest[0])
            if relation is None or relation.many or len(rest) == 1:
                break
            hops = self.hop(hops, rest.pop(0))
        return hops, tuple(rest)

    def path(self, parts: tuple[str, ...], start: tuple[str, ...] = ()) -> Column:
        if parts[0].startswith("$") or parts[0] in ("SELF", "self"):
            parts = parts[1:]
        hops, rest = self.split(parts, start)
        entity, alias = self.joined[hops], self._alias(hops)
        if not rest or rest == ("objectID",):
            return self.key_column(hops)
        relation = self.model.relationship(entity, rest[0])
        if relation is not None and not relation.many:
            return F.col(f"{alias}__{relation.key}") if relation.key else self.key_column(self.hop(hops, rest[0]))
        if relation is not None:
            return self.collection(hops, relation, rest[1:])
        attribute = self.model.attribute(entity, rest[0])
        if rest == ("entityName",) and attribute is None:
            top = self.model.root(entity)
            return F.col(f"{alias}__{top.discriminator}") if top.discriminator else F.lit(entity.name)
        if attribute is None:
            raise ModelError(f"{entity.name} has no property {rest[0]!r}")
        if attribute.derived:
            return self.value(expression(attribute.derived), hops)
        if attribute.transient:
            return F.lit(None).cast(KINDS[attribute.kind])
        if attribute.parts:
            if len(rest) == 2:
                part = next((a for a in attribute.parts if a.name == rest[1]), None)
                if part is None:
                    raise ModelError(f"{rest[0]} has no part {rest[1]!r}")
                return F.col(f"{alias}__{part.physical}")
            return F.struct(*(F.col(f"{alias}__{a.physical}").alias(a.name) for a in attribute.parts))
        if len(rest) > 1:
            raise ModelError(f"{rest[0]} is not a relationship")
        stored = F.col(f"{alias}__{attribute.physical}")
        return self.store.codecs[attribute.codec][1](stored) if attribute.codec in self.store.codecs else stored

    # To-many relationships

    def members(self, relation: Relationship) -> tuple[Plan, Column]:
        """A plan over the other side's rows and the column that names their owner here."""
        target = self.model[relation.target]
        if relation.bridge:
            table, own, other = relation.bridge
            pairs = self.store.table(table).select(F.col(own).alias("owner__"), F.col(other).alias("other__")).distinct()
            rows = self.store.scan(target)
            child = Plan(self.store, target, rows=rows.join(pairs, rows[self.model.root(target).key] == F.col("other__")).drop("other__"))
            return child, F.col("r__owner__")
        child = Plan(self.store, target)
        return child, F.col(f"r__{relation.inverse_key}")

    def attach(self, hops: tuple[str, ...], grouped: DataFrame, owner: str) -> None:
        self.df = self.df.join(grouped, self.key_column(hops) == F.col(owner), "left")

    def collection(self, hops: tuple[str, ...], relation: Relationship, rest: tuple[str, ...], test=None) -> Column:
        """rel.@count, rel.attribute.@sum and so on; @count is 0 and the others are null without members."""
        operator = rest[-1] if rest else None
        if operator not in _COLLECTION:
            raise ModelError(f"a to-many key path needs a quantifier or a collection operator: {relation.name}")
        if (operator == "@count") != (len(rest) == 1):
            raise ModelError(f"{operator} {'takes no' if operator == '@count' else 'needs a'} property")
        asked = (hops, relation.name, rest, repr(test))
        if asked not in self.known:
            child, owner = self.members(relation)
            if test is not None:
                child.restrict(test)
            value = F.lit(1) if operator == "@count" else child.path(rest[:-1])
            key, name = self._fresh("key"), self._fresh("value")
            self.attach(hops, child.df.groupBy(owner.alias(key)).agg(_COLLECTION[operator](value).alias(name)), key)
            self.known[asked] = F.coalesce(F.col(name), F.lit(0)) if operator == "@count" else F.col(name)
        return self.known[asked]

    def collected(self, hops: tuple[str, ...], relation: Relationship, rest: tuple[str, ...]) -> Column:
        """The different values of a property of the members (their keys without one), as an array; empty without members."""
        child, owner = self.members(relation)
        key, name = self._fresh("key"), self._fresh("values")
        self.attach(hops, child.df.groupBy(owner.alias(key)).agg(F.collect_set(child.path(rest or ("objectID",))).alias(name)), key)
        return F.coalesce(F.col(name), F.array())

    # Expressions

    def value(self, node, hops: tuple[str, ...] = ()) -> Column:
        if isinstance(node, Value):
            if isinstance(node.value, list):
                return F.array(*(F.lit(v) for v in node.value))
            if isinstance(node.value, Request):
                return self.scalar(node.value)
            return F.lit(node.value)
        if isinstance(node, Block):
            return node.function(lambda path: self.path(tuple(path.split(".")), hops))
        if isinstance(node, Combined):
            return _SETS[node.op](self.members_of(node.left, hops), self.members_of(node.right, hops))
        if isinstance(node, Path):
            return self.path(node.parts, hops)
        if isinstance(node, If):
            return F.when(self.test(node.test, hops), self.value(node.then, hops)).otherwise(self.value(node.other, hops))
        if isinstance(node, Subquery):
            at, rest = self.split((*node.path.parts, "@count"), hops)
            relation = self.model.relationship(self.joined[at], rest[0])
            if relation is None or not relation.many:
                raise ModelError("SUBQUERY needs a to-many relationship")
            return self.collection(at, relation, ("@count",), node.test)
        if isinstance(node, Call):
            return self.call(node, hops)
        if isinstance(node, Variable):
            if node.name in ("SELF",):
                return self.key_column(hops)
            raise ModelError(f"${node.name} has no value")
        raise ModelError(f"not a value: {node!r}")

    def members_of(self, node, hops: tuple[str, ...]) -> Column:
        """A side of a set expression: a path over a to-many as an array, any other value as it is."""
        if isinstance(node, Path):
            at, rest = self.split(node.parts, hops)
            relation = self.model.relationship(self.joined[at], rest[0]) if rest else None
            if relation is not None and relation.many and not rest[-1].startswith("@"):
                return self.collected(at, relation, rest[1:])
        return self.value(node, hops)

    def scalar(self, request: Request) -> Column:
        """The single value of another request: its count, an aggregate without groups, or its only row."""
        aggregates = [isinstance(p, Named) and _is_aggregate(expression(p.expression)) for p in request.properties]
        if request.result != "count" and (request.group_by or len(aggregates) != 1 or not (aggregates[0] or request.limit == 1)):
            raise ModelError("a request within an expression must give one value")
        return fetch(self.store, replace(request, result=request.result if request.result == "count" else "objects"), bare=True).scalar()

    def call(self, node: Call, hops: tuple[str, ...]) -> Column:
        name = node.name
        if name.rstrip(":") in AGGREGATES:
            return AGGREGATES[name.rstrip(":")](self.value(node.args[0], hops))
        if name in CONSTANT_FUNCTIONS:
            function, at = CONSTANT_FUNCTIONS[name]
            return function(*((a.value if isinstance(a, Value) else a.parts[0]) if i == at else self.value(a, hops) for i, a in enumerate(node.args)))
        if name not in FUNCTIONS:
            raise ModelError(f"unknown function {name!r}")
        return FUNCTIONS[name](*(self.value(a, hops) for a in node.args))

    # Predicates

    def restrict(self, tree) -> None:
        """Keeps the rows for which tree is true."""
        plain, joined = [], []

        def take(node) -> None:
            inner = node.part if isinstance(node, Not) else node
            if isinstance(node, And):
                for p in node.parts:
                    take(p)
            elif isinstance(inner, Compare) and (inner.quantifier or self.is_joined(inner)):
                joined.append((inner, "left_anti" if inner is not node else "left_semi"))
            else:
                plain.append(node)

        take(tree)
        if plain:
            condition = reduce(lambda a, b: a & b, [self.test(p) for p in plain])
            self.df = self.df.where(condition)
        for node, how in joined:
            if node.quantifier:
                at, keys, name = self.passing(node, ())
                left = self.key_column(at)
            else:
                left, keys, name = self.listed(node, ())
            if how == "left_anti" and not node.quantifier:  # NOT (null IN ...) is null, so that such rows go
                self.df = self.df.where(left.isNotNull())
            self.df = self.df.join(keys, left == F.col(name), how)

    def test(self, node, hops: tuple[str, ...] = ()) -> Column:
        if isinstance(node, Truth):
            return F.lit(node.value)
        if isinstance(node, And):
            return reduce(lambda a, b: a & b, [self.test(p, hops) for p in node.parts])
        if isinstance(node, Or):
            return reduce(lambda a, b: a | b, [self.test(p, hops) for p in node.parts])
        if isinstance(node, Not):
            return ~self.test(node.part, hops)
        if isinstance(node, Block):
            return self.value(node, hops)
        if not isinstance(node, Compare):
            raise ModelError(f"not a predicate: {node!r}")
        if node.quantifier:
            return self.quantified(node, hops)
        left, right, op = node.left, node.right, node.op
        if isinstance(left, Value) and not isinstance(right, Value) and op in FLIPPED:
            left, right, op = right, left, FLIPPED[op]
        self.check_codec(left, right, hops)
        if self.is_joined(node):
            return self.among(node, hops)
        if op == "IN" and isinstance(right, (Combined, Path)):
            return F.array_contains(self.members_of(right, hops), self.value(left, hops))
        return compared(self.value(left, hops), op, right, node.options, lambda x: self.value(x, hops))

    def check_codec(self, left, right, hops: tuple[str, ...]) -> None:
        for side, other in ((left, right), (right, left)):
            if isinstance(side, Path) and len(side.parts) == 1 and (a := self.model.attribute(self.joined[hops], side.parts[0])) and a.kind == "transformable":
                if not (isinstance(other, Value) and other.value is None):
                    raise ModelError("a transformable attribute can only be compared with nil")

    @staticmethod
    def is_joined(node: Compare) -> bool:
        """Whether a comparison is IN another request's rows, a table's first column, or a long list."""
        if node.op != "IN" or not isinstance(node.right, Value):
            return False
        given = node.right.value
        return isinstance(given, (Request, DataFrame)) or isinstance(given, (list, tuple, set)) and len(given) > LONG_LIST and not node.options

    def listed(self, node: Compare, hops: tuple[str, ...]) -> tuple[Column, DataFrame, str]:
        """(left side, different values on the right, the name of their column)."""
        left, given, name = self.value(node.left, hops), node.right.value, self._fresh("in")
        if isinstance(given, Request):
            rows = fetch(self.store, given if given.result == "ids" else replace(given, result="objects"), bare=bool(given.properties))
        elif isinstance(given, DataFrame):
            rows = given
        else:
            rows = self.store.spark.createDataFrame([(v,) for v in given], [name])
        return left, rows.select(F.col(f"`{rows.columns[0]}`").alias(name)).where(F.col(name).isNotNull()).distinct(), name

    def among(self, node: Compare, hops: tuple[str, ...]) -> Column:
        left, keys, name = self.listed(node, hops)
        self.df = self.df.join(keys, left == F.col(name), "left")
        return F.when(left.isNotNull(), F.col(name).isNotNull())

    def passing(self, node: Compare, hops: tuple[str, ...]) -> tuple[tuple[str, ...], DataFrame, str]:
        """(hops, keys, column): the different keys at hops that a quantifier holds for.

        ANY: some member passes. ALL: there are members, and none for which the comparison is false.
        """
        if not isinstance(node.left, Path):
            raise ModelError("a quantifier needs a key path")
        at, rest = self.split(node.left.parts, hops)
        relation = self.model.relationship(self.joined[at], rest[0])
        if relation is None or not relation.many:
            raise ModelError("a quantifier needs a to-many relationship")
        child, owner = self.members(relation)
        deeper, left = child.split(rest[1:] or ("objectID",))
        further = child.model.relationship(child.joined[deeper], left[0]) if left else None
        inner = Compare(Path(rest[1:] or ("objectID",)), node.op, node.right, node.options, node.quantifier if further is not None and further.many else "")
        name = self._fresh("some")
        if node.quantifier == "ANY":
            child.restrict(inner)
            return at, child.df.where(owner.isNotNull()).select(owner.alias(name)).distinct(), name
        failed = F.coalesce(~child.test(inner), F.lit(False))
        members = child.df.where(owner.isNotNull()).groupBy(owner.alias(name)).agg(F.max(failed).alias("failed__"))
        return at, members.where("NOT failed__").select(name), name

    def quantified(self, node: Compare, hops: tuple[str, ...]) -> Column:
        asked = (hops, repr(node))
        if asked not in self.known:
            at, keys, name = self.passing(node, hops)
            self.attach(at, keys, name)
            self.known[asked] = F.col(name).isNotNull()
        return self.known[asked]

    # Sensitive attributes

    def sensitive(self, node) -> bool:
        """Whether a value rests on a sensitive attribute, over derived attributes too; counts do not."""
        if isinstance(node, Subquery) or isinstance(node, Call) and node.name.rstrip(":") == "count":
            return False
        if isinstance(node, Path):
            return self._sensitive_path(self.entity, node.parts)
        if isinstance(node, Block):
            read: list[str] = []
            node.function(lambda path: (read.append(path), self.path(tuple(path.split("."))))[1])
            return any(self._sensitive_path(self.entity, tuple(p.split("."))) for p in read)
        return any(self.sensitive(n) for n in kids(node))

    def _sensitive_path(self, entity: Entity, parts: tuple[str, ...]) -> bool:
        for i, name in enumerate(parts):
            relation = self.model.relationship(entity, name)
            if relation is not None:
                entity = self.model[relation.target]
                continue
            a = self.model.attribute(entity, name)
            if a is None:
                return False
            if a.derived:
                return any(self._sensitive_path(entity, n.parts) for n in nodes(expression(a.derived)) if isinstance(n, Path))
            own = [p for p in a.parts if i + 1 == len(parts) or p.name == parts[i + 1]]
            return a.sensitive or any(p.sensitive for p in own)
        return False


def compared(left: Column, op: str, right, options: str, value) -> Column:
    """A comparison; [c] ignores case and [d] accents of every operator on strings."""

    def plain(c: Column) -> Column:
        if "d" in options:
            c = _unaccented(c)
        return F.lower(c) if "c" in options else c

    if op == "IN":
        if isinstance(right, Value) and isinstance(right.value, (list, tuple, set)) and right.value:
            items = [plain(F.lit(v)) for v in right.value]
            return plain(left).isin(*items)
        raise ModelError("IN needs a collection that is not empty")
    if op == "BETWEEN":
        if not (isinstance(right, Value) and isinstance(right.value, (list, tuple)) and len(right.value) == 2):
            raise ModelError("BETWEEN needs two values")
        return left.between(*(F.lit(v) for v in right.value))
    if isinstance(right, Value) and right.value is None:
        if op in ("==", "!="):
            return left.isNull() if op == "==" else left.isNotNull()
        raise ModelError(f"{op} with nil has no meaning")
    if op == "MATCHES":
        return left.rlike(("(?i)" if "c" in options else "") + right.value) if isinstance(right, Value) else F.regexp_like(plain(left), plain(value(right)))
    a, b = (plain(left), plain(value(right))) if options else (left, value(right))
    return {
        "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        "LIKE": lambda: a == b, "BEGINSWITH": lambda: a.startswith(b), "ENDSWITH": lambda: a.endswith(b), "CONTAINS": lambda: a.contains(b),
    }[op]()


def _accents() -> tuple[str, str]:
    """Letters that are another letter with accents, and those letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_ACCENTED, _PLAIN = _accents()


def _unaccented(c: Column) -> Column:
    """Without accents, written with the letter or after it."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


# Requests


def shown(entity: Entity, store: Store, heirs: bool) -> list[Attribute]:
    """Attributes of a default projection: the entity's own and inherited ones, but transient ones and those that count members."""
    return [a for a in store.model.attributes(entity) if not a.transient and (not a.derived or "@" not in a.derived)]


def masked(column: Column, hide: bool) -> Column:
    return F.when(column.isNotNull(), F.lit(MASK)) if hide else column


def _sorts(plan: Plan, request: Request, named: dict[str, Column]) -> list[Column]:
    """Sort columns, nulls first ascending and last descending. A to-many path sorts by its least or greatest value.

    named are the computed columns of the result; everything else is sorted by what the store holds. Transient
    attributes sort nothing.
    """
    out = []
    for item in request.sort:
        down = item.startswith("-")
        name = item.lstrip("-")
        parts = tuple(name.split("."))
        if name in named:
            column = named[name]
        else:
            at, rest = plan.split(parts)
            relation = plan.model.relationship(plan.joined[at], rest[0]) if rest else None
            a = plan.model.attribute(plan.joined[at], rest[0]) if rest else None
            if a is not None and a.transient:
                continue
            if relation is not None and relation.many and not rest[-1].startswith("@"):
                column = plan.collection(at, relation, (*rest[1:], "@max" if down else "@min"))
            else:
                column = plan.path(parts)
        out.append(column.desc_nulls_last() if down else column.asc_nulls_first())
    return out


def _output(plan: Plan, item) -> tuple[str, Column, bool]:
    """(name, value, whether the value is sensitive) of a property."""
    if isinstance(item, Named):
        tree = expression(item.expression)
        c = plan.value(tree)
        return item.name, c.cast(item.kind) if item.kind else c, plan.sensitive(tree)
    parts = tuple(item.split("."))
    return item.replace(".", "_"), plan.path(parts), plan.sensitive(Path(parts))


def fetch(store: Store, request: Request, bare: bool = False) -> DataFrame:
    """The plan of a request. Columns are named by the model, dots of paths become underscores.

    Dictionaries show values that rest on a sensitive attribute as MASK, after sorting, grouping and
    distinct. With bare, properties alone are returned for objects too.
    """
    request = request.checked()
    entity = store.model[request.entity]
    if request.shape is not None and request.result != "count":
        from orrery.plans.graph import nested

        return nested(store, request)
    plan = Plan(store, entity, request.heirs)
    tree = request.tree()
    if tree is not None:
        plan.restrict(tree)
    if request.result == "count":  # each root once, whatever limit and offset say
        return plan.df.agg(F.count(plan.key_column()).alias("count"))
    hide = request.result == "dictionaries"
    if request.group_by:
        return _grouped(plan, request, hide)
    if request.properties:
        found = [_output(plan, p) for p in request.properties]
    elif request.result == "ids" or not request.values:
        found = []
    else:
        found = [_output(plan, a.name) for a in shown(entity, store, request.heirs)]
    columns, secret = {n: c for n, c, _ in found}, {n for n, _, s in found if s and hide}
    if any(isinstance(p, Named) and _is_aggregate(expression(p.expression)) for p in request.properties):
        return plan.df.agg(*(masked(c, n in secret).alias(n) for n, c in columns.items()))
    if (request.result in ("objects", "ids") or not request.properties) and not (bare and request.properties):
        columns = {"objectID": plan.key_column(), "entityName": plan.path(("entityName",)), **columns}
    if request.distinct:
        df = plan.df.select(*(c.alias(n) for n, c in columns.items())).distinct()
        if request.sort:
            df = df.orderBy(*((F.col(s.lstrip("-").replace(".", "_")).desc_nulls_last() if s.startswith("-") else F.col(s.replace(".", "_")).asc_nulls_first()) for s in request.sort))
        return _window(df, request).select(*(masked(F.col(n), n in secret).alias(n) for n in columns))
    sorts = _sorts(plan, request, {p.name: columns[p.name] for p in request.properties if isinstance(p, Named)})
    df = plan.df
    if sorts:
        df = df.orderBy(*sorts)
    return _window(df, request).select(*(masked(c, n in secret).alias(n) for n, c in columns.items()))


def explain(store: Store, request: Request, mode: str = "formatted") -> None:
    """Prints the plan that Spark makes of a request."""
    fetch(store, request).explain(mode)


def _window(df: DataFrame, request: Request) -> DataFrame:
    df = df.offset(request.offset) if request.offset else df
    return df.limit(request.limit) if request.limit else df


def _is_aggregate(node) -> bool:
    return isinstance(node, Call) and (node.name.rstrip(":") in AGGREGATES or any(_is_aggregate(a) for a in node.args))


def _grouped(plan: Plan, request: Request, hide: bool) -> DataFrame:
    """WHERE, GROUP BY, HAVING, ORDER BY; plain columns must be grouped."""
    found = [_output(plan, g) for g in request.group_by]
    keys, secret = {n: c for n, c, _ in found}, {n for n, _, s in found if s and hide}
    aggregates = {}
    for p in request.properties:
        name = p.name if isinstance(p, Named) else p.replace(".", "_")
        if isinstance(p, Named) and _is_aggregate(expression(p.expression)):
            _, aggregates[name], inner = _output(plan, p)
            secret |= {name} if inner and hide else set()
        elif name not in keys:
            raise ModelError(f"{name} is neither grouped nor aggregated")
    having = None
    if request.having is not None:
        tree = predicate(request.having)
        hidden: dict[str, Column] = {}

        def side(node) -> Column:
            if _is_aggregate(node):
                hidden[name := f"h{len(hidden)}__"] = plan.value(node)
                return F.col(name)
            if isinstance(node, Path) and "_".join(node.parts) in keys:
                return F.col("_".join(node.parts))
            return plan.value(node)

        def tested(node) -> Column:
            if isinstance(node, (And, Or)):
                parts = [tested(p) for p in node.parts]
                return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts)
            if isinstance(node, Not):
                return ~tested(node.part)
            return compared(side(node.left), node.op, node.right, node.options, side)

        having = tested(tree)
        aggregates = {**aggregates, **hidden}
    df = plan.df.groupBy(*(c.alias(n) for n, c in keys.items()))
    df = df.agg(*(c.alias(n) for n, c in aggregates.items())) if aggregates else df.agg(F.count("*").alias("n__"))
    if having is not None:
        df = df.where(having)
    if request.sort:
        df = df.orderBy(*((F.col(s[1:].replace(".", "_")).desc_nulls_last() if s.startswith("-") else F.col(s.replace(".", "_")).asc_nulls_first()) for s in request.sort))
    names = [*keys, *(n for n in aggregates if not n.endswith("__"))]
    return _window(df, request).select(*(masked(F.col(n), n in secret).alias(n) for n in names))
