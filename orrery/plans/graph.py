"""Nested results: related rows as structs and arrays.

Each to-many is one aggregate by its owner's key, joined to its owner; no row is multiplied. A page of
roots is cut before anything is nested, and only members of its roots are read on. Where the predicate asks for ANY member along a nested path, the
nested members are those that pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.model import Entity, ModelError, Store
from orrery.operators.expressions import And, Compare, Path
from orrery.plans.compiler import Plan, _sorts, _window, masked
from orrery.plans.request import Request


#: A page of so many roots at most is sent whole to the members it is joined with.
SMALL_PAGE = 10_000


def _member_tests(tree, name: str) -> list:
    """What the top-level conjuncts ask of the members of relationship `name`, as predicates over a member."""
    parts = tree.parts if isinstance(tree, And) else (tree,) if tree is not None else ()
    out = []
    for p in parts:
        if isinstance(p, Compare) and p.quantifier == "ANY" and isinstance(p.left, Path) and p.left.parts[0] == name and len(p.left.parts) > 1:
            out.append(Compare(Path(p.left.parts[1:]), p.op, p.right, p.options, ""))
    return out


def _requantified(plan: Plan, test: Compare) -> Compare:
    at, rest = plan.split(test.left.parts)
    relation = plan.model.relationship(plan.joined[at], rest[0]) if rest else None
    return Compare(test.left, test.op, test.right, test.options, "ANY" if relation is not None and relation.many else "")


def _fields(plan: Plan, hops: tuple[str, ...], shape: dict, tests, hide: bool, came: str | None, page: tuple[DataFrame, bool] | None) -> list[Column]:
    """The columns of one level; came is the relationship that leads back, page the rows to nest (and whether they are few)."""
    entity, out = plan.joined[hops], []
    for name, inner in shape.items():
        relation = plan.model.relationship(entity, name)
        if relation is None:
            out.append(masked(plan.path((name,), hops), hide and plan.sensitive(Path((*hops, name)))).alias(name))
        elif name == came:
            continue
        elif not isinstance(inner, dict):
            raise ModelError(f"{name} needs a shape of its own")
        elif relation.many:
            out.append(_collected(plan, hops, relation, inner, tests if not hops else None, hide, page).alias(name))
        else:
            to = plan.hop(hops, name)
            one = F.struct(*_fields(plan, to, inner, None, hide, relation.inverse, page))
            out.append(F.when(plan.key_column(to).isNotNull(), one).alias(name))
    return out


def _collected(plan: Plan, hops: tuple[str, ...], relation, inner: dict, tests, hide: bool, page: tuple[DataFrame, bool] | None) -> Column:
    child, owner = plan.members(relation)
    if page is not None and plan.key_name(hops) in page[0].columns:
        named = plan._fresh("page")
        keys = page[0].select(plan.key_column(hops).alias(named)).distinct()
        child.df = child.df.join(F.broadcast(keys) if page[1] else keys, owner == F.col(named), "left_semi")
    passed = _member_tests(tests, relation.name)
    for t in passed:
        child.restrict(_requantified(child, t))
    deeper = And(tuple(passed)) if passed else None
    below = None if page is None else (child.df, False)
    order = child.path((relation.order_by,)) if relation.order_by else child.key_column()
    fields = _fields(child, (), inner, deeper, hide, relation.inverse, below)
    item = F.struct(order.alias("__order"), child.key_column().alias("__key"), F.struct(*fields).alias("__item"))
    key, name = plan._fresh("key"), plan._fresh("items")
    grouped = child.df.select(owner.alias(key), item.alias("__one")).groupBy(key).agg(F.sort_array(F.collect_list("__one")).alias(name))
    plan.attach(hops, grouped, key)
    return F.coalesce(F.transform(F.col(name), lambda x: x["__item"]), F.array())


def nested(store: Store, request: Request) -> DataFrame:
    """A page of roots with their shape; objectID and entityName come first, roots keep the request's order."""
    entity: Entity = store.model[request.entity]
    plan = Plan(store, entity, request.heirs)
    tree = request.tree()
    if tree is not None:
        plan.restrict(tree)
    sorts = _sorts(plan, request, {})
    page = None
    if request.limit or request.offset:
        plan.df = _window(plan.df.orderBy(*sorts) if sorts else plan.df, request)
        ones = [n for n in request.shape if (r := plan.model.relationship(entity, n)) is not None and not r.many]
        for n in ones:
            plan.hop((), n)
        if sorts:  # without an order, the page may be another one each time it is computed
            page = (plan.df, 0 < request.limit <= SMALL_PAGE)
    fields = _fields(plan, (), request.shape, tree, request.result == "dictionaries", None, page)
    out = plan.df.orderBy(*sorts) if sorts else plan.df
    return out.select(plan.key_column().alias("objectID"), plan.path(("entityName",)).alias("entityName"), *fields)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
