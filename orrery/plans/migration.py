"""Moving a store's tables from one model version to the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.model import KINDS, NUMBERS, TYPE_DEFAULTS, Entity, Model, ModelError, Store
from orrery.operators.changes import numbered, violations
from orrery.sources.tables import cut


def castable(old: str, new: str) -> bool:
    """Numbers and booleans become any number or text; every other kind only itself."""
    return old == new or (old in (*NUMBERS, "boolean") and new in (*NUMBERS, "string"))


@dataclass
class Mapping:
    """How one new entity gets its rows; values are functions of the old table's columns.

    With new_keys, rows get keys from 1 on in place of their old ones, and every to-one key and pair table
    that points at them is moved along. policy sees the rows with their old keys.
    """

    source: str | None
    target: str
    values: dict[str, Column] = field(default_factory=dict)
    policy: Callable[[DataFrame], DataFrame] | None = None
    new_keys: bool = False


def _former(model: Model, entity: Entity) -> Entity | None:
    return model.entities.get(entity.renamed_from or entity.name)


def inferred(old: Model, new: Model) -> list[Mapping]:
    """Pairs entities, attributes and relationships by their former names.

    New optional columns are null, new required ones get their default; a new required column without any,
    a kind that cannot be cast, and a relationship that points elsewhere cannot be inferred.
    """
    out = []
    for e in new.entities.values():
        if e.parent:
            continue
        was = _former(old, e)
        mapping = Mapping(was.name if was else None, e.name)
        if was:
            mapping.values[e.key] = F.col(was.key)
            for h in new.heirs(e):
                before = {a.name: a for x in old.heirs(was) for a in x.attributes}
                for a in h.attributes:
                    if a.derived or a.parts or a.transient:
                        continue
                    source = before.get(a.renamed_from or a.name)
                    fill = a.default if a.default is not None else TYPE_DEFAULTS.get(a.kind)
                    if source is None:
                        if not a.optional and fill is None:
                            raise ModelError(f"{e.name}.{a.name}: a new required attribute needs a default")
                        mapping.values[a.physical] = F.lit(None if a.optional and a.default is None else fill).cast(KINDS[a.kind])
                        continue
                    if not castable(source.kind, a.kind):
                        raise ModelError(f"{e.name}.{a.name}: {source.kind} cannot become {a.kind}")
                    value = F.col(source.physical).try_cast(KINDS[a.kind])
                    mapping.values[a.physical] = value if a.optional or fill is None else F.coalesce(value, F.lit(fill).cast(KINDS[a.kind]))
                for r in h.relationships:
                    if not r.key:
                        continue
                    source = next((x for o in old.heirs(was) for x in o.relationships if x.name == r.name and x.key), None)
                    target = new[r.target]
                    if source and source.target not in (r.target, target.renamed_from):
                        raise ModelError(f"{e.name}.{r.name}: pointing elsewhere cannot be inferred")
                    mapping.values[r.key] = F.col(source.key) if source else F.lit(None).cast("bigint")
            top = new.root(e)
            if top.discriminator:
                names = {o.tag or o.name: n.tag or n.name for n in new.heirs(e) if (o := _former(old, n))}
                kept = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
                mapping.values[top.discriminator] = F.element_at(kept, F.col(old.root(was).discriminator))
        out.append(mapping)
    return out


def _rekeyed(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows with keys from 1 on, and (old_id, new_id) of each."""
    old = rows.withColumnRenamed(key, "__old").withColumn(key, F.lit(None).cast("bigint"))
    made = cut(numbered(old, key, old))
    return made.drop("__old").select(*rows.columns), made.select(F.col("__old").alias("old_id"), F.col(key).alias("new_id"))


def _followed(rows: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """rows with column taken from old to new keys; keys without a row become null."""
    names = moved.select(F.col("old_id").alias("__from"), F.col("new_id").alias("__to"))
    joined = rows.join(names, F.col(column) == F.col("__from"), "left")
    return joined.select(*(F.col("__to").cast(rows.schema[c].dataType).alias(c) if c == column else F.col(c) for c in rows.columns))


def migrate(store: Store, new: Model, mappings: list[Mapping] | None = None, validate: bool = False, associations: dict[str, DataFrame] | None = None) -> Store:
    """The store under a new model, in three passes: rows, the keys between them, and with `validate` their rules.

    Tables that no entity uses any more are left out, pair tables are kept. A source that shares its table
    with other entities gives its own rows only. associations, where given, gets (old_id, new_id) of each
    entity whose rows got new keys. A broken rule of the new model is an error.
    """
    old, tables, moved = store.model, {}, {} if associations is None else associations
    for m in mappings or inferred(old, new):
        e = new[m.target]
        if m.source is None:
            schema = ", ".join([f"`{e.key}` bigint", *(f"`{a.physical}` {KINDS[a.kind]}" for a in e.attributes if not a.derived and not a.parts and not a.transient and a.physical != e.key)])
            rows = store.spark.createDataFrame([], schema)
        else:
            rows = store.scan(old[m.source]).select(*(c.alias(n) for n, c in m.values.items()))
        rows = m.policy(rows) if m.policy else rows
        if m.new_keys:
            rows, moved[m.target] = _rekeyed(rows, e.key)
        tables[e.table] = tables[e.table].unionByName(rows, allowMissingColumns=True) if e.table in tables else rows
    for e in new.entities.values():
        for r in e.relationships:
            if r.bridge and r.bridge[0] not in tables:
                tables[r.bridge[0]] = store.table(r.bridge[0]) if r.bridge[0] in store.tables else store.spark.createDataFrame([], f"`{r.bridge[1]}` bigint, `{r.bridge[2]}` bigint")
    done = set()
    for e in new.entities.values():
        for r in e.relationships:
            table = new.root(e).table
            ends = [(table, r.key, r.target)] if r.key else [(r.bridge[0], r.bridge[1], e.name), (r.bridge[0], r.bridge[2], r.target)] if r.bridge else []
            for name, column, target in ends:
                if target in moved and name in tables and column in tables[name].columns and (name, column) not in done:
                    done.add((name, column))
                    tables[name] = _followed(tables[name], column, moved[target])
    out = Store(store.spark, new, tables)
    if validate:
        for name, e in new.entities.items():
            if not e.abstract and new.root(e).table in tables and (broken := violations(out, name).limit(1).collect()):
                raise ModelError(f"{name} {broken[0]['id']}: {broken[0]['attribute']} breaks {broken[0]['rule']}")
    return out


def key_to_bridge(rows: DataFrame, key: str, foreign: str, columns: tuple[str, str]) -> DataFrame:
    """A to-one as a pair table; rows without one give no pair."""
    return rows.where(F.col(foreign).isNotNull()).select(F.col(key).alias(columns[0]), F.col(foreign).alias(columns[1])).distinct()


def bridge_to_key(rows: DataFrame, key: str, pairs: DataFrame, columns: tuple[str, str], foreign: str) -> DataFrame:
    """A pair table as a to-one; of several pairs the smallest other side stays."""
    one = pairs.groupBy(F.col(columns[0]).alias("__k")).agg(F.min(columns[1]).alias(foreign))
    base = rows.drop(foreign) if foreign in rows.columns else rows
    return base.join(one, base[key] == F.col("__k"), "left").drop("__k")


@dataclass
class Stage:
    """One step: the model to reach, mappings where they cannot be inferred, and handlers around it."""

    model: Model
    mappings: list[Mapping] | None = None
    will: Callable[[Store], None] | None = None
    did: Callable[[Store], None] | None = None


def staged(store: Store, stages: list[Stage], on_progress: Callable[[float], None] | None = None, cancelled: Callable[[], bool] | None = None, start: Model | None = None) -> Store:
    """The stages in turn, from the one after the store's own model on; all where no stage leads to that model.

    start is the model before the first stage. Where it is given, a store of neither that model nor a
    stage's is refused, as no stage leads on from it. A failure or a cancellation leaves the old store as it was.
    """
    own = store.model.checksum()
    reached = [i + 1 for i, s in enumerate(stages) if s.model.checksum() == own]
    if start is not None and not reached and start.checksum() != own:
        raise ModelError("no stage starts at this store's model")
    first = reached[-1] if reached else 0
    for i, s in enumerate(stages[first:], first):
        if cancelled and cancelled():
            raise ModelError("cancelled")
        if s.will:
            s.will(store)
        store = migrate(store, s.model, s.mappings)
        if s.did:
            s.did(store)
        if on_progress:
            on_progress((i + 1) / len(stages))
    return store


def needed(old: Model, new: Model) -> list[str]:
    """Entities whose version hash differs or that are new."""
    return sorted(n for n in new.entities if n not in old.entities or old.version_hash(n) != new.version_hash(n))


def discovered(mappings: dict[tuple[str, str], list[Mapping]], old: Model, new: Model, name: str) -> list[Mapping] | None:
    """A mapping registered for the two version hashes of an entity."""
    return mappings.get((old.version_hash(name), new.version_hash(name)))
