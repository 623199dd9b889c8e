"""Schemas: SDL read and written, introspection, patches that make new versions, indexes."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Catalog, Collection, Index, Relation
from .graphql import Node, QueryError, parse

#: SDL's scalar types and Spark's.
SCALARS = {"ID": T.StringType(), "Boolean": T.BooleanType(), "Int": T.LongType(), "Float": T.DoubleType(), "Float64": T.DoubleType(), "Float32": T.FloatType(), "DateTime": T.TimestampType(), "String": T.StringType(), "Blob": T.StringType(), "JSON": T.VariantType()}
EQUALITY = ("_eq", "_neq", "_in", "_nin")
COMPARISON = ("_gt", "_geq", "_lt", "_leq")
PATTERNS = ("_like", "_nlike", "_ilike", "_nilike")
LISTS = ("_any", "_all", "_none")


def operators(kind: T.DataType) -> tuple[str, ...]:
    """The filter operators that a field of this type takes."""
    if isinstance(kind, T.ArrayType):
        return (*LISTS, "_contains", "_contained_in", "_eq", "_neq")
    if isinstance(kind, T.VariantType):
        return (*EQUALITY, *COMPARISON, *PATTERNS, "_has_key")
    if isinstance(kind, T.StringType):
        return (*EQUALITY, *COMPARISON, *PATTERNS)
    if isinstance(kind, T.BooleanType):
        return EQUALITY
    return (*EQUALITY, *COMPARISON)


def type_name(kind: T.DataType) -> str:
    """SDL's name of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return f"[{type_name(kind.elementType)}{'' if kind.containsNull else '!'}]"
    if isinstance(kind, T.IntegralType):
        return "Int"
    if isinstance(kind, T.FloatType):
        return "Float32"
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return "Float"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "DateTime"
    return {"boolean": "Boolean", "variant": "JSON"}.get(kind.simpleString(), "String")


def sdl(c: Collection) -> str:
    """A collection as an SDL type."""
    lines = [f"  {f.name}: {type_name(f.dataType)}" + "".join(f" @{i.kind}(name: \"{i.name}\")" for i in c.indexes if i.fields[0] == f.name) for f in c.load().schema.fields if not f.name.startswith("_")]
    lines += [f"  {n}: {f'[{r.to}]' if r.many else r.to}" for n, r in c.relations.items()]
    return "\n".join([f"type {c.name} {{", *lines, "}"])


_TYPE = re.compile(r"type\s+(\w+)\s*((?:@\w+(?:\([^)]*\))?\s*)*)\{([^}]*)\}", re.S)
_FIELD = re.compile(r"(\w+)\s*:\s*(\[?\s*\w+!?\s*\]?!?)((?:\s*@\w+(?:\([^)]*\))?)*)")
_DIRECTIVE = re.compile(r"@(\w+)(\([^)]*\))?")


def parse_sdl(text: str) -> dict[str, dict]:
    """Types by name: fields (a StructType), relations (name: type, whether many), rules, indexes.

    Directives of fields: ``@default(value:)``, ``@immutable``, ``@size(n:)``,
    ``@crdt(type: pncounter|pcounter)``, ``@index(unique:, name:)``,
    ``@fulltext(language:)``, ``@vector(metric:, dimensions:)``,
    ``@encrypted(key:)``.
    """
    text = re.sub(r'"""(?:.|\n)*?"""|#[^\n]*', "", text)
    found, out = _TYPE.findall(text), {}
    rest = _TYPE.sub("", text).strip()
    if rest or not found:
        raise QueryError(f"no type: {rest[:40]!r}")
    names = {n for n, _, _ in found}
    if len(names) < len(found):
        raise QueryError("a type is declared twice")
    for name, _, body in found:
        fields, relations, rules, indexes = [], {}, {}, []
        left = _FIELD.sub("", body).replace(",", "").strip()
        if left:
            raise QueryError(f"no field of {name}: {left[:40]!r}")
        for field, kind, directives in _FIELD.findall(body):
            kind = kind.replace(" ", "")
            bare = kind.strip("[]!").rstrip("!")
            rule: dict = {"required": True} if kind.endswith("!") else {}
            if bare in names:
                relations[field] = (bare, kind.startswith("["))
                continue
            if bare not in SCALARS:
                raise QueryError(f"{name}.{field} is of an unknown type, {bare}")
            of = SCALARS[bare]
            fields.append(T.StructField(field, T.ArrayType(of, "!]" not in kind) if kind.startswith("[") else of))
            for what, args in _DIRECTIVE.findall(directives):
                said = parse("{ f" + (args or "") + " }")[0].roots[0].args
                if what == "default":
                    rule["default"] = next(iter(said.values()))
                elif what == "immutable":
                    rule["immutable"] = True
                elif what == "size":
                    rule["size"] = next(iter(said.values()))
                elif what == "crdt":
                    if (kind_of := {"pncounter": "pn", "pcounter": "p"}.get(str(said.get("type")).lower())) is not None:
                        rule["counter"] = kind_of
                elif what in ("index", "fulltext", "vector", "encrypted"):
                    mode = "unique" if said.get("unique") else "ordered" if what == "index" else what
                    indexes.append(Index(said.get("name", f"{name}_{field}"), (field,), mode, {k: v for k, v in said.items() if k not in ("name", "unique")}))
                else:
                    raise QueryError(f"no such directive: @{what}")
            if rule:
                rules[field] = rule
        out[name] = {"fields": T.StructType(fields), "relations": relations, "rules": rules, "indexes": indexes}
    return out


def declare(catalog: Catalog, text: str, root: str) -> list[str]:
    """Stored collections of an SDL text. A to-one relation ``r`` keeps the other's _docID in ``r_id``; a to-many one is its other side."""
    from .mutate import stored

    types = parse_sdl(text)
    for name, t in types.items():
        fields = T.StructType(t["fields"].fields + [T.StructField(f"{r}_id", T.StringType()) for r, (_, many) in t["relations"].items() if not many])
        relations = {}
        for r, (to, many) in t["relations"].items():
            if not many:
                relations[r] = Relation(to, f"{r}_id", "_docID")
                continue
            back = [b for b, (of, m) in types[to]["relations"].items() if of == name and not m]
            if len(back) != 1:
                raise QueryError(f"{name}.{r} needs one relation back from {to}")
            relations[r] = Relation(to, "_docID", f"{back[0]}_id", True)
        stored(catalog, name, fields, root, None, t["rules"], t["indexes"], **relations)
    return list(types)


def introspect(catalog: Catalog, node: Node) -> dict | None:
    """``__schema`` and ``__type``: types, their fields, and the operators that each field's filter takes."""

    def field(name: str, kind: str, ops: tuple = ()) -> dict:
        many = kind.startswith("[")
        bare = kind.strip("[]!")
        one = {"kind": "SCALAR" if bare in SCALARS else "OBJECT", "name": bare, "ofType": None}
        return {"name": name, "type": {"kind": "LIST", "name": None, "ofType": one} if many else one, "filters": list(ops)}

    def of(c: Collection) -> dict:
        fields = [field(f.name, type_name(f.dataType), operators(f.dataType)) for f in c.frame().schema.fields]
        fields += [field(n, f"[{r.to}]" if r.many else r.to) for n, r in c.relations.items()]
        return {"kind": "OBJECT", "name": c.name, "fields": sorted(fields, key=lambda f: f["name"])}

    def shown(value, kids: list[Node]):
        if isinstance(value, list):
            return [shown(v, kids) for v in value]
        if not isinstance(value, dict) or not kids:
            return value
        return {k.alias: shown(value.get(k.name), k.kids) for k in kids}

    if node.name == "__type":
        name = node.args.get("name")
        if name in SCALARS:
            return shown({"kind": "SCALAR", "name": name, "fields": None}, node.kids)
        return shown(of(catalog[name]), node.kids) if name in catalog.collections else None
    types = [of(c) for _, c in sorted(catalog.collections.items())] + [{"kind": "SCALAR", "name": n, "fields": None} for n in SCALARS]
    return shown({"queryType": {"name": "Query"}, "mutationType": {"name": "Mutation"}, "subscriptionType": {"name": "Subscription"}, "types": types}, node.kids)


# indexes


def create_index(catalog: Catalog, collection: str, fields: list[str], name: str | None = None, kind: str = "ordered", **options) -> Index:
    """Declare an index; a unique one is checked against the rows that are there."""
    c = catalog[collection]
    known = c.load().schema.fieldNames()
    if kind not in ("ordered", "unique", "vector", "fulltext", "encrypted") or not fields or any(f not in known for f in fields):
        raise QueryError(f"no such index of {collection}: {kind} on {fields}")
    name = name or f"{collection}_{'_'.join(fields)}"
    if any(i.name == name for i in c.indexes):
        raise QueryError(f"{collection} has an index {name} already")
    index = Index(name, tuple(fields), kind, options)
    if kind == "unique" and not c.frame().where("not _deleted").dropna(subset=fields).groupBy(*fields).count().where("count > 1").isEmpty():
        raise QueryError(f"{', '.join(fields)} isn't unique")
    c.indexes.append(index)
    return index


def drop_index(catalog: Catalog, collection: str, name: str) -> None:
    c = catalog[collection]
    if not any(i.name == name for i in c.indexes):
        raise QueryError(f"{collection} has no index {name}")
    c.indexes = [i for i in c.indexes if i.name != name]


def indexes(catalog: Catalog) -> DataFrame:
    """All indexes: collection, name, kind, fields, options."""
    rows = [(c.name, i.name, i.kind, list(i.fields), {k: str(v) for k, v in i.options.items() if k != "key"}) for c in catalog.collections.values() for i in c.indexes]
    return catalog.spark.createDataFrame(rows, "collection string, name string, kind string, fields array<string>, options map<string,string>")


# versions


def _at(doc: dict, path: str) -> tuple[dict, str]:
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path.strip("/").split("/")]
    for p in parts[:-1]:
        if p not in doc:
            raise QueryError(f"nothing at {path}")
        doc = doc[p]
    return doc, parts[-1]


def patched(doc: dict, patch: list[dict]) -> dict:
    """A JSON patch (add, remove, replace, copy, move, test) on nested dictionaries; all of it or, on an error, nothing."""
    out = copy.deepcopy(doc)
    for step in patch:
        op, (parent, last) = step["op"], _at(out, step["path"])
        if op in ("remove", "replace", "test") and last not in parent:
            raise QueryError(f"nothing at {step['path']}")
        if op == "test":
            if parent[last] != step["value"]:
                raise QueryError(f"{step['path']} isn't {step['value']!r}")
        elif op == "remove":
            del parent[last]
        elif op in ("add", "replace"):
            parent[last] = step["value"]
        elif op in ("copy", "move"):
            source, name = _at(out, step["from"])
            if name not in source:
                raise QueryError(f"nothing at {step['from']}")
            parent[last] = copy.deepcopy(source[name])
            if op == "move":
                del source[name]
        else:
            raise QueryError(f"no such step: {op}")
    return out


def patch_collection(catalog: Catalog, name: str, patch: list[dict], lens: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """A new version of a stored collection's fields (``/fields/<name>`` holds an SDL type); returns its name.

    Rows of the old version are read through ``lens``, if there is one; fields
    that it doesn't give are null. What a move leads from becomes the new field.
    """
    from .mutate import Table, schema_version

    c = catalog[name]
    old = c.table
    if old is None:
        raise QueryError(f"{name} isn't stored")
    doc = {"fields": {f.name: type_name(f.dataType) for f in old.schema.fields}}
    new = patched(doc, patch)["fields"]
    kinds = parse_sdl("type X { " + " ".join(f"{k}: {v}" for k, v in new.items()) + " }")["X"]["fields"]
    same = {f.name: f.dataType for f in old.schema.fields}
    schema = T.StructType([T.StructField(f.name, same[f.name] if f.name in same and type_name(same[f.name]) == new[f.name] else f.dataType) for f in kinds.fields])
    if c.key is not None and c.key not in schema.fieldNames():
        raise QueryError(f"{c.key} is the key of {name}")
    rows = old.rows()
    for step in patch:
        if step["op"] == "move" and step["from"].startswith("/fields/"):
            rows = rows.withColumnRenamed(step["from"].split("/")[-1], step["path"].split("/")[-1])
        elif step["op"] == "copy" and step["from"].startswith("/fields/"):
            rows = rows.withColumn(step["path"].split("/")[-1], F.col(step["from"].split("/")[-1]))
    rows = lens(rows) if lens else rows
    table = Table(catalog.spark, old.root.rsplit("/", 1)[0], schema, c.key)
    table.logs, table.seq, path = list(old.logs), old.seq, f"{table.root}/base-0"
    have = rows.columns
    rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.stored().fields]).write.parquet(path)
    table.base = path
    c.table, c.load, c.log = table, table.rows, table.log
    c.rules = {k: r for k, r in c.rules.items() if k in schema.fieldNames()}
    c.indexes = [i for i in c.indexes if set(i.fields) <= set(schema.fieldNames())]
    return schema_version(schema)
