"""XML stores: one <object> for each row, with typed <attribute> values and <relationship> references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.model import KINDS, Model, Store
from orrery.sources.tables import register

SCHEMA = "_id string, _type string, attribute array<struct<_VALUE:string,_name:string,_type:string>>, relationship array<struct<_VALUE:string,_name:string,_destination:string,_references:string>>"


def write(store: Store, path: str) -> None:
    """Writes the tables of concrete root entities as one folder of XML files; to-one keys become references."""
    rows = None
    for e in store.model.entities.values():
        if e.abstract or e.parent:
            continue
        table, kinds = store.table(e.table), {a.physical: (a.name, a.kind) for a in e.attributes if not a.derived and not a.parts}
        attributes = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("string").alias("_VALUE"), F.lit(n).alias("_name"), F.lit(k).alias("_type"))) for c, (n, k) in kinds.items()))
        ones = [r for r in e.relationships if r.key]
        kind = "array<struct<_VALUE:string,_name:string,_destination:string,_references:string>>"
        references = F.array(*(F.when(F.col(r.key).isNotNull(), F.struct(F.lit(None).cast("string").alias("_VALUE"), F.lit(r.name).alias("_name"), F.lit(r.target).alias("_destination"), F.col(r.key).cast("string").alias("_references"))) for r in ones))
        part = table.select(F.col(e.key).cast("string").alias("_id"), F.lit(e.name).alias("_type"), F.array_compact(attributes).alias("attribute"), (F.array_compact(references) if ones else F.array().cast(kind)).cast(kind).alias("relationship"))
        rows = part if rows is None else rows.unionByName(part)
    rows.write.option("rowTag", "object").option("rootTag", "database").format("xml").save(path)


def read(spark: SparkSession, model: Model, path: str) -> Store:
    """A store over the objects of XML files; values are cast to the model's kinds, unreadable ones are null."""
    objects = spark.read.format("xml").option("rowTag", "object").schema(SCHEMA).load(path)
    tables: dict[str, DataFrame] = {}
    for e in model.entities.values():
        if e.abstract or e.parent:
            continue
        named = F.map_from_entries(F.transform(F.coalesce("attribute", F.array()), lambda a: F.struct(a["_name"], a["_VALUE"])))
        to = F.map_from_entries(F.transform(F.coalesce("relationship", F.array()), lambda r: F.struct(r["_name"], r["_references"])))
        columns = [F.col("_id").cast("bigint").alias(e.key)]
        columns += [F.element_at(named, a.name).try_cast(KINDS[a.kind]).alias(a.physical) for a in e.attributes if not a.derived and not a.parts and a.physical != e.key]
        columns += [F.element_at(to, r.name).try_cast("bigint").alias(r.key) for r in e.relationships if r.key and r.key != e.key]
        tables[e.table] = objects.where(F.col("_type") == e.name).select(*columns)
    return Store(spark, model, tables)


register("xml", read)
