"""Documents from a log of changes, merged without conflict.

The log has a row for each change: doc_id, field (``_C`` for the document
itself), priority, value (text), delta (of counters), deleted, cid, parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _number(n: int):
    return F.lit(str(n)).cast("decimal(38,0)")


def last_writes(log: DataFrame) -> DataFrame:
    """Of each document's field the value of the highest priority; of equal ones the greater bytes. An empty value is a tombstone."""
    best = F.max(F.struct("priority", F.col("value").cast("binary").alias("bytes"))).alias("best")
    return log.where("field <> '_C' and delta is null").groupBy("doc_id", "field").agg(best).select("doc_id", "field", F.nullif(F.col("best.bytes").cast("string"), F.lit("")).alias("value"))


def counters(log: DataFrame, saturate: bool = False) -> DataFrame:
    """Of each counter the sum of its increments, wrapped to 64 bits; a replay of history stops at the bounds instead.

    A replay adds in the order of heights, so a bound that was reached on the
    way counts; it needs a counter's increments in one task, in order.
    """
    least, most = _number(-(1 << 63)), _number((1 << 63) - 1)
    if saturate:
        steps = F.transform(F.array_sort(F.collect_list(F.struct("priority", "cid", "delta"))), lambda x: x["delta"].cast("decimal(38,0)"))
        value = F.aggregate(steps, _number(0), lambda a, x: F.least(most, F.greatest(least, (a + x).cast("decimal(38,0)"))))
        return log.where("delta is not null").groupBy("doc_id", "field").agg(value.cast("long").alias("value"))
    total = F.sum(F.col("delta").cast("decimal(38,0)"))
    wrapped = F.pmod(total - least, _number(1 << 64)) + least
    return log.where("delta is not null").groupBy("doc_id", "field").agg(wrapped.cast("long").alias("value"))


def statuses(log: DataFrame) -> DataFrame:
    """Whether each document's last change of itself deleted it."""
    return log.where("field = '_C'").groupBy("doc_id").agg(F.max_by("deleted", F.struct("priority", "cid")).alias("_deleted"))


def documents(log: DataFrame, fields: list[str], counted: list[str] = (), saturate: bool = False) -> DataFrame:
    """The current documents: doc_id, a column for each field, _deleted."""
    one = last_writes(log).groupBy("doc_id").pivot("field", [f for f in fields if f not in counted]).agg(F.first("value"))
    if counted:
        first = log.where(F.col("field").isin(list(counted)) & F.col("delta").isNull() & (F.col("value") != "")).withColumn("delta", F.col("value").cast("long"))  # a counter's first value
        many = counters(log.unionByName(first), saturate).groupBy("doc_id").pivot("field", list(counted)).agg(F.first("value"))
        one = one.join(many, "doc_id", "full_outer")
    out = one.join(statuses(log), "doc_id", "full_outer")
    return out.select("doc_id", *fields, F.coalesce("_deleted", F.lit(False)).alias("_deleted"))


def as_of(log: DataFrame, cids: list[str], root: str) -> DataFrame:
    """The changes that ``cids`` build on, themselves included: a step to all parents at a time, until there are no more."""
    spark = log.sparkSession
    found = spark.createDataFrame([(c,) for c in cids], "cid string")
    step, front = 0, found
    while not front.isEmpty():
        parents = log.join(front, "cid", "left_semi").select(F.explode("parents").alias("cid")).distinct()
        new = parents.join(found, "cid", "left_anti")
        new.write.mode("overwrite").parquet(f"{root}/ancestors-{step}")
        front = spark.read.parquet(f"{root}/ancestors-{step}")
        found, step = found.union(front), step + 1
    return log.join(found.distinct(), "cid", "left_semi")


def at_height(log: DataFrame, height: int) -> DataFrame:
    """The changes of a history without branches up to ``height``."""
    return log.where(F.col("priority") <= height)


# changes to a table of documents


def created(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``df`` with new rows; a key that is or was taken, or is there twice, is an error."""
    if not rows.join(df.select(key), key, "left_semi").isEmpty() or not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a document of this key is there already")
    return df.unionByName(rows.withColumn("_deleted", F.lit(False)), allowMissingColumns=True)


def updated(df: DataFrame, where, values: dict, counted: tuple = ()) -> DataFrame:
    """Rows that meet ``where`` get ``values``; of counters these are increments."""
    hit = F.coalesce(where, F.lit(False)) & ~F.col("_deleted")
    new = {k: F.when(hit, F.col(k) + v if k in counted else (v if hasattr(v, "cast") else F.lit(v))).otherwise(F.col(k)).cast(df.schema[k].dataType) for k, v in values.items()}
    return df.withColumns(new)


def deleted(df: DataFrame, where) -> DataFrame:
    return df.withColumn("_deleted", F.col("_deleted") | F.coalesce(where, F.lit(False)))


def upserted(df: DataFrame, where, add: DataFrame, update: dict, key: str) -> DataFrame:
    """No match: ``add`` is created; one: it is updated; more: an error."""
    n = df.where(F.coalesce(where, F.lit(False)) & ~F.col("_deleted")).limit(2).count()
    if n > 1:
        raise ValueError("more than one document matches")
    return updated(df, where, update) if n else created(df, add, key)


def unique(df: DataFrame, keys: list[str]) -> None:
    """An error if two living documents share the keys."""
    if not df.where("not _deleted").groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} isn't unique")
