"""The semantic model: entities over tables, attributes, relationships, and the store that binds them to DataFrames."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attribute kinds and their Spark types.
KINDS = {
    "integer16": "smallint", "integer32": "int", "integer64": "bigint", "decimal": "decimal(10,2)", "double": "double",
    "float": "float", "string": "string", "boolean": "boolean", "date": "timestamp_ntz", "binary": "binary", "uuid": "string",
    "uri": "string", "transformable": "binary",
}
NUMBERS = ("integer16", "integer32", "integer64", "decimal", "double", "float")
#: What a required attribute without a default gets.
TYPE_DEFAULTS = {**dict.fromkeys(NUMBERS, 0), "string": "", "boolean": False}


class ModelError(ValueError):
    """A request or a model that has no defined meaning."""


@dataclass(frozen=True)
class Attribute:
    """A column. `derived` is an expression text computed on read; `parts` makes a composite of attributes.

    A `transient` attribute has no column and reads as null. `validator` gives a condition that valid values meet.
    """

    name: str
    kind: str = "string"
    column: str | None = None
    optional: bool = True
    default: object = None
    minimum: float | None = None
    maximum: float | None = None
    pattern: str | None = None
    sensitive: bool = False
    derived: str | None = None
    parts: tuple[Attribute, ...] = ()
    codec: str | None = None
    renamed_from: str | None = None
    transient: bool = False
    validator: Callable[[Column], Column] | None = field(default=None, compare=False, repr=False)

    @property
    def physical(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Relationship:
    """A join edge: `key` names a foreign-key column here, `inverse_key` one there, `bridge` a pair table.

    `bridge` is (table, column of this side, column of the other side).
    """

    name: str
    target: str
    key: str | None = None
    inverse_key: str | None = None
    bridge: tuple[str, str, str] | None = None
    many: bool = False
    order_by: str | None = None
    delete_rule: str = "nullify"
    inverse: str | None = None


@dataclass(frozen=True)
class FetchedProperty:
    """A saved query; `$FETCH_SOURCE.x` in its predicate means attribute x of the row it is asked for."""

    name: str
    target: str
    predicate: str


@dataclass
class Entity:
    """`key` is the column of the object's id. Where it is not unique by itself, `identity` lists the columns that are."""

    name: str
    table: str
    key: str
    attributes: list[Attribute] = field(default_factory=list)
    relationships: list[Relationship] = field(default_factory=list)
    fetched: list[FetchedProperty] = field(default_factory=list)
    parent: str | None = None
    abstract: bool = False
    discriminator: str | None = None
    tag: str | None = None
    unique: list[tuple[str, ...]] = field(default_factory=list)
    renamed_from: str | None = None
    identity: tuple[str, ...] = ()


class Model:
    """Entities by name; checks what can be checked before any data is read."""

    def __init__(self, *entities: Entity, templates: dict | None = None) -> None:
        self.entities = {e.name: e for e in entities}
        self.templates = dict(templates or {})
        for e in entities:
            if e.parent and e.parent not in self.entities:
                raise ModelError(f"{e.name}: unknown parent {e.parent}")
            for a in e.attributes:
                if not a.parts and a.kind not in KINDS:
                    raise ModelError(f"{e.name}.{a.name}: kind {a.kind!r} is not supported")
            for r in e.relationships:
                if r.target not in self.entities:
                    raise ModelError(f"{e.name}.{r.name}: unknown target {r.target}")

    def __getitem__(self, name: str) -> Entity:
        if name not in self.entities:
            raise ModelError(f"unknown entity {name!r}")
        return self.entities[name]

    def line(self, entity: Entity) -> list[Entity]:
        """The entity and its ancestors, nearest first."""
        out = [entity]
        while out[-1].parent:
            out.append(self[out[-1].parent])
        return out

    def root(self, entity: Entity) -> Entity:
        return self.line(entity)[-1]

    def heirs(self, entity: Entity) -> list[Entity]:
        """The entity and all that descend from it."""
        return [e for e in self.entities.values() if entity in self.line(e)]

    def attribute(self, entity: Entity, name: str) -> Attribute | None:
        return next((a for e in self.line(entity) for a in e.attributes if a.name == name), None)

    def relationship(self, entity: Entity, name: str) -> Relationship | None:
        return next((r for e in self.line(entity) for r in e.relationships if r.name == name), None)

    def attributes(self, entity: Entity) -> list[Attribute]:
        return [a for e in reversed(self.line(entity)) for a in e.attributes]

    def tags(self, entity: Entity, heirs: bool = True) -> list[str] | None:
        """Discriminator values to read; None when they cover the whole hierarchy."""
        top = self.root(entity)
        if not top.discriminator:
            return None
        own = self.heirs(entity) if heirs else [entity]
        tags = sorted(e.tag or e.name for e in own if not e.abstract)
        every = sorted(e.tag or e.name for e in self.heirs(top) if not e.abstract)
        return None if tags == every and entity is top else tags

    def checksum(self) -> str:
        """Equal for models under which the same tables can be read."""
        return hashlib.sha256(json.dumps(sorted(self.version_hash(n) for n in self.entities)).encode()).hexdigest()

    def version_hash(self, name: str) -> str:
        """Changes with anything that a migration must notice about an entity."""
        e = self[name]
        shape = [e.name, e.table, e.key, e.parent, e.abstract, [repr(a) for a in e.attributes], [repr(r) for r in e.relationships]]
        return hashlib.sha256(json.dumps(shape).encode()).hexdigest()


class Store:
    """A model over DataFrames by table name. Stores are values: changes give new stores."""

    def __init__(self, spark: SparkSession, model: Model, tables: dict[str, DataFrame], read_only: bool = False, codecs: dict | None = None) -> None:
        self.spark, self.model, self.tables, self.read_only, self.codecs = spark, model, dict(tables), read_only, dict(codecs or {})

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ModelError(f"no table {name!r} in this store")
        return self.tables[name]

    def scan(self, entity: Entity, heirs: bool = True) -> DataFrame:
        """The rows of an entity, found by the discriminator where it shares its table."""
        top = self.model.root(entity)
        rows, tags = self.table(top.table), self.model.tags(entity, heirs)
        if tags is None:
            return rows
        return rows.where(F.col(top.discriminator).isin(tags)) if tags else rows.where(F.lit(False))

    def with_tables(self, **tables: DataFrame) -> Store:
        if self.read_only:
            raise ModelError("the store is read-only")
        return Store(self.spark, self.model, {**self.tables, **tables}, codecs=self.codecs)


def coerced(df: DataFrame, model: Model, entity: Entity) -> DataFrame:
    """Casts columns to their kinds: optional empty scalars become null, missing required ones their default."""

    def value(a: Attribute) -> Column:
        c = F.col(a.physical)
        if a.kind != "string" and df.schema[a.physical].dataType.simpleString() == "string":
            c = F.nullif(c, F.lit(""))
        elif a.kind == "string" and a.optional:
            c = F.nullif(c.cast("string"), F.lit(""))
        c = c.try_cast(KINDS[a.kind])
        if not a.optional:
            fill = a.default if a.default is not None else TYPE_DEFAULTS.get(a.kind)
            c = c if fill is None else F.coalesce(c, F.lit(fill).cast(KINDS[a.kind]))
        return c.alias(a.physical)

    known = {a.physical: a for a in model.attributes(entity) if not a.derived and not a.parts and not a.transient}
    return df.select(*(value(known[c]) if c in known else F.col(c) for c in df.columns))
