"""JSON backups: a folder for each collection, references kept by key or led to the new keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import mutate
from ..plans.catalog import Catalog


def export(catalog: Catalog, path: str, names: list[str] | None = None) -> None:
    """Each collection's living documents, with _docID where it isn't a field."""
    for name in names or sorted(catalog.collections):
        c = catalog[name]
        df = c.frame().where("not _deleted").drop("_deleted")
        df = df if c.table is not None and c.key is None else df.drop("_docID")
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def restore(spark: SparkSession, path: str, schema, name: str) -> DataFrame:
    """A collection of a backup; rows that don't parse are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")


def restore_all(catalog: Catalog, path: str, names: list[str]) -> None:
    """Fill stored collections from a backup; they may refer to each other in any order.

    Documents that are named by a hash of their fields get their names without
    their references first; then references are led from the old names to the
    new ones. So circles of references need no order.
    """
    rows, new = {}, {}
    for name in names:
        c = catalog[name]
        hashed = c.key is None
        schema = c.table.schema if not hashed else c.table.schema.fields and type(c.table.schema)([*c.table.schema.fields]).add("_docID", "string")
        rows[name] = restore(catalog.spark, path, schema, name)
        if hashed:
            refers = [r.ours for r in c.relations.values() if not r.many]
            own = [f for f in c.table.schema.fieldNames() if f not in refers]
            new[name] = rows[name].select(F.col("_docID").alias("__old"), F.sha2(F.to_json(F.struct(*own)), 256).alias("__new"))
    for name in names:
        c, df = catalog[name], rows[name]
        for r in c.relations.values():
            if not r.many and r.to in new and r.theirs == "_docID":
                df = df.join(new[r.to].withColumnRenamed("__old", r.ours), r.ours, "left").withColumn(r.ours, F.coalesce("__new", r.ours)).drop("__new")
        if c.key is None:
            df = df.join(new[name].withColumnRenamed("__old", "_docID"), "_docID").withColumn("_docID", F.col("__new")).drop("__new")
        else:
            df = df.withColumn("_docID", F.col(c.key).cast("string"))
        mutate.insert(c, df.withColumn("_deleted", F.lit(False)).select(*c.table.stored().fieldNames()))
