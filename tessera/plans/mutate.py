"""Mutations: documents are created, changed, deleted and removed by appended changes.

A stored collection is a base table and the changes since: for each mutation
that touched it the touched documents as they are afterwards, with a sequence
number, and the commits that say what changed. Reading takes of each document
its last version; documents without changes come from the base untouched.
``compact`` writes a new base. One writer at a time.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.filters import compile_filter
from .catalog import Catalog, Collection, Index, Relation
from .graphql import Node, QueryError

VERBS = ("add", "create", "update", "delete", "upsert", "truncate")
#: What a log holds.
LOG = "doc_id string, field string, priority long, value string, delta long, deleted boolean, cid string, parents array<string>, links array<struct<cid:string,fieldName:string>>, version string"


class WriteError(QueryError):
    """A write that a constraint refuses."""


class Table:
    """The stored rows of a collection: a base table, changes and a log below ``root``."""

    def __init__(self, spark, root: str, schema: T.StructType, key: str | None):
        self.spark, self.root, self.schema, self.key = spark, f"{root.rstrip('/')}/{uuid.uuid4().hex[:12]}", schema, key
        self.base: str | None = None
        self.changes: list[str] = []
        self.logs: list[str] = []
        self.seq = 0

    def state(self) -> tuple:
        return self.base, list(self.changes), list(self.logs), self.seq

    def reset(self, state: tuple) -> None:
        self.base, self.changes, self.logs, self.seq = state[0], list(state[1]), list(state[2]), state[3]

    def stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("_docID", T.StringType()), T.StructField("_deleted", T.BooleanType())])

    def kept(self) -> T.StructType:
        return self.stored().add("_seq", "long").add("_gone", "boolean")

    def rows(self) -> DataFrame:
        """The current version of every document, the deleted ones included."""
        schema = self.stored()
        base = self.spark.read.schema(schema).parquet(self.base) if self.base else self.spark.createDataFrame([], schema)
        if not self.changes:
            return base
        changed = self.spark.read.schema(self.kept()).parquet(*self.changes)
        last = changed.withColumn("_n", F.row_number().over(Window.partitionBy("_docID").orderBy(F.desc("_seq")))).where("_n = 1")
        kept = base.join(last.select("_docID"), "_docID", "left_anti") if self.base else base
        return kept.select(*schema.fieldNames()).union(last.where("not _gone").select(*schema.fieldNames()))

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*self.logs) if self.logs else self.spark.createDataFrame([], LOG)

    def append(self, rows: DataFrame, commits: DataFrame | None, gone: bool = False) -> DataFrame:
        """Write the new versions of documents, and their commits; returns the rows as they were written."""
        self.seq += 1
        at = f"{self.root}/changes-{self.seq}-{uuid.uuid4().hex[:8]}"
        names = self.stored().fieldNames()
        rows.select(*names, F.lit(self.seq).cast("long").alias("_seq"), F.lit(gone).alias("_gone")).write.parquet(at)
        written = self.spark.read.schema(self.kept()).parquet(at)
        if commits is not None:
            commits.write.parquet(f"{at}-log")
            self.logs.append(f"{at}-log")
        self.changes.append(at)
        return written.select(*names)

    def compact(self) -> None:
        """A new base of the current rows; the log stays."""
        path = f"{self.root}/base-{self.seq}-{uuid.uuid4().hex[:8]}"
        self.rows().write.parquet(path)
        self.base, self.changes = path, []


def stored(catalog: Catalog, name: str, schema: str | T.StructType, root: str, key: str | None = None, rules: dict | None = None, indexes: list[Index] = (), rows: DataFrame | None = None, **relations: Relation) -> Collection:
    """A collection that mutations can change, kept below ``root``; ``rows`` are its first base.

    A document without ``key`` is named by a hash of its fields.
    """
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    table = Table(catalog.spark, root, kind, key)
    c = catalog.add(name, table.rows, key, **relations)
    c.rules, c.indexes, c.table, c.log = rules or {}, list(indexes), table, table.log
    if rows is not None:
        path = f"{table.root}/base-0"
        rows.select(*kind.fieldNames()).withColumn("_docID", _doc_id(c)).withColumn("_deleted", F.lit(False)).write.parquet(path)
        table.base = path
    return c


def _doc_id(c: Collection) -> Column:
    return F.col(c.key).cast("string") if c.key else F.sha2(F.to_json(F.struct(*c.table.schema.fieldNames())), 256)


def _table(c: Collection) -> Table:
    if c.table is None:
        raise QueryError(f"{c.name} can't be changed")
    return c.table


def _literal(v, kind: T.DataType, name: str) -> Column:
    """A value as a field's; UTC_NOW is one instant a query."""
    if v == "UTC_NOW" and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.current_timestamp().cast(kind)
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    wrong = isinstance(kind, T.NumericType) and not number or isinstance(kind, T.BooleanType) and not isinstance(v, bool) or isinstance(kind, T.ArrayType) and not isinstance(v, list) or isinstance(kind, T.IntegralType) and isinstance(v, float) and v != int(v)
    if v is not None and wrong:
        raise WriteError(f"{name} can't be {v!r}")
    if isinstance(v, dict):
        import json

        return F.lit(json.dumps(v))
    return (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(kind)


def _known(c: Collection, values: dict) -> dict:
    """Input by column: relations by their key; unknown fields are an error."""
    out = {}
    for k, v in values.items():
        name = c.relations[k].ours if k in c.relations and not c.relations[k].many else c.relations[k[1:-2]].ours if k.startswith("_") and k[1:-2] in c.relations else k
        if name not in c.table.schema.fieldNames():
            raise WriteError(f"{c.name} has no field {k}")
        out[name] = v
    return out


def created(c: Collection, inputs: list[dict]) -> DataFrame:
    """New documents with their defaults, as a DataFrame; nothing is written yet."""
    table, schema, frames = _table(c), c.table.schema, []
    for values in inputs:
        values = {k: r["default"] for k, r in c.rules.items() if "default" in r} | _known(c, values)
        frames.append(table.spark.range(1).select(*[_literal(values.get(f.name), f.dataType, f.name).alias(f.name) for f in schema.fields]))
    rows = reduce(lambda a, b: a.union(b), frames) if frames else table.spark.createDataFrame([], schema)
    return rows.withColumn("_docID", _doc_id(c)).withColumn("_deleted", F.lit(False))


def insert(c: Collection, rows: DataFrame) -> DataFrame:
    """Append new documents. A docID that exists, deleted or not, or occurs twice, is an error, as is a broken constraint."""
    table = _table(c)
    if not rows.where("_docID is null").isEmpty():
        raise WriteError(f"{c.name}: a document needs its key")
    if not rows.groupBy("_docID").count().where("count > 1").isEmpty():
        raise WriteError(f"{c.name}: a document of this key is there twice")
    if not rows.join(table.rows().select("_docID"), "_docID", "left_semi").isEmpty():
        raise WriteError(f"{c.name}: a document of this key is or was there already")
    _check(c, rows, None)
    changed = {f.name: F.col(f.name).isNotNull() for f in table.schema.fields}
    return table.append(rows, _commits(c, rows, changed, {}))


def change(c: Collection, hit: DataFrame, values: dict, expressions: bool = False) -> DataFrame:
    """Write ``hit`` with new values; of counters these are increments."""
    table, values = _table(c), _known(c, values)
    for k in values:
        if c.rules.get(k, {}).get("immutable"):
            raise WriteError(f"{c.name}.{k} can't be changed")
        if k == c.key:
            raise WriteError(f"{c.name}.{k} is the key")
        counter = c.rules.get(k, {}).get("counter")
        if counter == "p" and not expressions and values[k] is not None and values[k] < 0:
            raise WriteError(f"{c.name}.{k} only grows")
    kinds = {f.name: f.dataType for f in table.schema.fields}
    put = {k: v.cast(kinds[k]) if expressions else _literal(v, kinds[k], k) for k, v in values.items()}
    deltas = {k: v for k, v in put.items() if "counter" in c.rules.get(k, {}) and not expressions}
    rows = hit.withColumns({k: F.coalesce(F.col(k), F.lit(0)) + v if k in deltas else v for k, v in put.items()})
    _check(c, rows, set(values))
    return table.append(rows, _commits(c, rows, {k: F.lit(True) for k in values}, deltas))


def delete(c: Collection, hit: DataFrame, cascade: Catalog | None = None) -> DataFrame:
    """Mark ``hit`` as deleted; with a catalog also the documents that refer to them, as long as relations lead on."""
    table = _table(c)
    rows = table.append(hit.withColumn("_deleted", F.lit(True)), _commits(c, hit.withColumn("_deleted", F.lit(True)), {}, {}))
    if cascade is not None:
        for r in c.relations.values():
            child = cascade[r.to]
            if r.many and child.table is not None:
                theirs = child.table.rows().where("not _deleted")
                below = theirs.join(rows.select(F.col(r.ours).alias(r.theirs)).where(F.col(r.theirs).isNotNull()).distinct(), r.theirs, "left_semi").select(*theirs.columns)
                if not below.isEmpty():
                    delete(child, below, cascade)
    return rows


def truncate(c: Collection) -> int:
    """Remove all documents, their history too; returns how many there were."""
    table = _table(c)
    n = table.rows().count()
    table.base, table.changes, table.logs = None, [], []
    return n


def _check(c: Collection, rows: DataFrame, touched: set | None) -> None:
    """The constraints of the collection's fields and unique indexes on ``rows``, which are about to be written."""
    bad = []
    for k, rule in c.rules.items():
        if touched is not None and k not in touched:
            continue
        if "size" in rule:
            bad.append((F.col(k).isNotNull() & (F.size(k) != rule["size"]), f"{k} needs {rule['size']} elements"))
        if rule.get("counter") == "p":
            bad.append((F.col(k) < 0, f"{k} can't be below 0"))
        if rule.get("required"):
            bad.append((F.col(k).isNull(), f"{k} is required"))
    if bad:
        found = rows.agg(*[F.coalesce(F.bool_or(b), F.lit(False)) for b, _ in bad]).first()
        for (_, why), broken in zip(bad, found):
            if broken:
                raise WriteError(f"{c.name}: {why}")
    for i in c.indexes:
        if i.kind == "unique" and (touched is None or touched & set(i.fields)):
            keys, full = list(i.fields), reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in i.fields])
            others = c.table.rows().where("not _deleted").join(rows.select("_docID"), "_docID", "left_anti").join(rows.select(*keys).distinct(), keys, "left_semi")
            if not rows.where(full).select(*keys).unionByName(others.select(*keys)).groupBy(*keys).count().where("count > 1").isEmpty():
                raise WriteError(f"{c.name}: {', '.join(keys)} isn't unique")


def _commits(c: Collection, rows: DataFrame, fields: dict[str, Column], deltas: dict[str, Column]) -> DataFrame:
    """The commits of a change: one for each field that it sets and one for the document, which links to them.

    A commit stands one above the highest commit of its field; its cid is a
    hash of what it says and builds on.
    """
    text = lambda k: F.to_json(F.col(k)) if isinstance(rows.schema[k].dataType, (T.ArrayType, T.StructType)) else F.col(k).cast("string")
    none = F.lit(None)
    each = [F.struct(F.lit(k).alias("field"), (none.cast("string") if k in deltas else F.coalesce(text(k), F.lit(""))).alias("value"), (deltas[k].cast("long") if k in deltas else none.cast("long")).alias("delta"), on.alias("on")) for k, on in fields.items()]
    each.append(F.struct(F.lit("_C").alias("field"), none.cast("string").alias("value"), none.cast("long").alias("delta"), F.lit(True).alias("on")))
    said = rows.select(F.col("_docID").alias("doc_id"), F.col("_deleted").alias("deleted"), F.explode(F.filter(F.array(*each), lambda x: x.on)).alias("x")).select("doc_id", "x.field", "x.value", "x.delta", F.when(F.col("x.field") == "_C", F.col("deleted")).alias("deleted"))
    log = c.table.log()
    heads = log.groupBy("doc_id", "field").agg(F.max("priority").alias("top")).join(log.select("doc_id", "field", F.col("priority").alias("top"), "cid"), ["doc_id", "field", "top"]).groupBy("doc_id", "field", "top").agg(F.array_sort(F.collect_list("cid")).alias("parents"))
    met = said.join(heads, ["doc_id", "field"], "left").withColumn("priority", F.coalesce(F.col("top"), F.lit(0)) + 1).withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    version = F.lit(schema_version(c.table.schema))
    # the document's commit holds a hash of its links, so it differs whenever the change does
    cid = lambda *more: F.sha2(F.concat_ws("\x1f", "doc_id", "field", F.col("priority").cast("string"), F.coalesce("value", F.lit("\x00")), F.coalesce(F.col("delta").cast("string"), F.lit("")), F.coalesce(F.col("deleted").cast("string"), F.lit("")), F.array_join("parents", ","), *more), 256)
    own = met.where("field <> '_C'").withColumn("cid", cid())
    links = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cid", F.col("field").alias("fieldName")))).alias("links"))
    whole = met.where("field = '_C'").join(links, "doc_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<cid:string,fieldName:string>>")))
    whole = whole.withColumn("cid", cid(F.array_join(F.transform("links", lambda x: x["cid"]), ",")))
    names = [f.name for f in T._parse_datatype_string(LOG).fields]
    none_yet = F.array().cast("array<struct<cid:string,fieldName:string>>")
    return whole.withColumn("version", version).select(*names).union(own.withColumn("links", none_yet).withColumn("version", version).select(*names))


def schema_version(schema: T.StructType) -> str:
    """A name for a collection's fields and their types."""
    import hashlib

    return hashlib.sha256(schema.simpleString().encode()).hexdigest()[:16]


# query text


def mutate(catalog: Catalog, node: Node) -> DataFrame:
    """One mutation; returns the selection of the documents that it touched."""
    from .select import Planner

    m = re.fullmatch(r"([a-z]+)_(\w+)", node.name)
    if not m or m[1] not in VERBS:
        raise QueryError(f"no such mutation: {node.name}")
    verb, c, args, planner = m[1], catalog[m[2]], node.args, Planner(catalog)
    if verb == "truncate":
        return catalog.spark.range(1).select(F.lit(truncate(c)).cast("long").alias(node.alias))
    inputs = args.get("input", args.get("create"))
    if verb in ("add", "create"):
        rows = insert(c, created(c, inputs if isinstance(inputs, list) else [inputs or {}]))
    elif verb == "upsert":
        if not {"filter", "update"} <= set(args) or "add" not in args and "create" not in args:
            raise QueryError("upsert needs filter, add and update")
        hit = _touched(catalog, planner, c, {"filter": args["filter"]})
        n = len(hit.select("_docID").limit(2).collect())
        if n > 1:
            raise WriteError("more than one document matches")
        rows = change(c, hit, args["update"]) if n else insert(c, created(c, [args.get("add", args.get("create"))]))
    else:
        hit = _touched(catalog, planner, c, {k: v for k, v in args.items() if k in ("docID", "docIDs", "filter")})
        rows = change(c, hit, inputs or {}) if verb == "update" else delete(c, hit, catalog if args.get("cascade") else None)
    touched = Collection(c.name, lambda: rows, c.key, c.relations, c.indexes, c.rules, c.log, c.table)
    df, shown = planner.fields(touched.frame(), touched, node.kids)
    return df.select(*[f.alias(n) for n, f in shown])


def _touched(catalog: Catalog, planner, c: Collection, args: dict) -> DataFrame:
    _table(c)
    df = planner.scan(c, args)
    return df.select(*c.table.stored().fieldNames())


class Transaction:
    """Mutations of a catalog that are kept together: all of them count when the block ends, none if it fails.

    If someone else changed a touched collection meanwhile, the block fails.
    """

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def __enter__(self) -> Catalog:
        self.staged = Catalog(self.catalog.spark)
        self.before = {}
        for name, c in self.catalog.collections.items():
            if c.table is None:
                self.staged.collections[name] = c
                continue
            t = Table.__new__(Table)
            t.__dict__.update(c.table.__dict__)
            t.reset(c.table.state())
            self.before[name] = c.table.state()
            self.staged.collections[name] = Collection(name, t.rows, c.key, c.relations, c.indexes, c.rules, t.log, t)
        return self.staged

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            return
        changed = {n: self.staged[n].table.state() for n, s in self.before.items() if self.staged[n].table.state() != s}
        for name in changed:
            if self.catalog[name].table.state() != self.before[name]:
                raise WriteError(f"{name} was changed by someone else")
        for name, state in changed.items():
            self.catalog[name].table.reset(state)


def matching(c: Collection, cond: dict) -> DataFrame:
    """The living documents of a stored collection that meet a filter of its own fields."""
    rows = _table(c).rows().where("not _deleted")
    return rows.where(compile_filter(cond, lambda *_: None, rows.schema))
