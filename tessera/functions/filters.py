"""Filters as two-valued columns: every predicate is true or false, never null.

A filter is a dictionary; its keys are fields, ``_and``, ``_or`` and ``_not``,
and sibling keys must all hold.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 2.220446049250313e-16
ALIASES = {"_ne": "_neq", "_gte": "_geq", "_ge": "_geq", "_lte": "_leq", "_le": "_leq"}
#: How deep and wide a filter may be; 0: as it likes.
MAX_DEPTH, MAX_WIDTH = 50, 100


class FilterError(ValueError):
    pass


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _value(v, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(v, str):
        return F.lit(v).cast(kind)
    return F.lit(v)


#: Kinds of operands and of fields that order each other.
_KINDS = {"number": (T.NumericType,), "string": (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType), "boolean": (T.BooleanType,)}


def _kind_of(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    return "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, (list, tuple)) else "object"


def _fits(v, kind: T.DataType) -> bool:
    """Whether an operand is of the field's kind; a null is of any."""
    return v is None or isinstance(kind, T.VariantType) or isinstance(kind, _KINDS.get(_kind_of(v), ()))


def equal(c: Column, v, kind: T.DataType) -> Column:
    """Null-safe equality; numbers that aren't both integers may differ by rounding, and values of different kinds are never equal."""
    if isinstance(v, dict):
        return _object(c, v, kind)
    if isinstance(v, list):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        each = F.lit(True)
        for i, x in enumerate(v):
            each = each & equal(F.element_at(c, i + 1), x, kind.elementType)
        return _sure((F.size(c) == len(v)) & each) if v else _sure(F.size(c) == 0)
    if v is None:
        return c.isNull()
    if not _fits(v, kind):
        return F.lit(False)
    if isinstance(kind, (T.DoubleType, T.FloatType)) or isinstance(v, float) and isinstance(kind, T.NumericType):
        return _sure(F.abs(c - F.lit(float(v))) < EPSILON)
    return c.eqNullSafe(_value(v, kind))


def _object(c: Column, v: dict, kind: T.DataType) -> Column:
    """Equality with an object: the same keys, each with an equal value."""
    if isinstance(kind, T.StructType):
        known = set(kind.fieldNames())
        out = c.isNotNull() & F.lit(set(v) <= known)
        for name in known:
            out = out & equal(c[name], v.get(name), kind[name].dataType)
        return _sure(out)
    if not isinstance(kind, (T.StringType, T.VariantType)):
        return F.lit(False)
    parsed = c if isinstance(kind, T.VariantType) else F.try_parse_json(c)
    keys = F.json_object_keys(F.to_json(parsed))
    out = _sure(F.size(keys) == len(v)) if v else _sure(F.size(keys) == 0)
    for name, x in v.items():
        at = F.try_variant_get(parsed, f"$['{name}']", "variant")
        if x is None:
            out = out & _sure(F.array_contains(keys, name)) & F.try_variant_get(parsed, f"$['{name}']", "string").isNull()
        else:
            of = {"number": "double", "boolean": "boolean", "string": "string"}.get(_kind_of(x))
            below = equal(F.try_variant_get(parsed, f"$['{name}']", of), x, {"double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}[of]) if of else _object(at, x, T.VariantType()) if isinstance(x, dict) else F.to_json(at).eqNullSafe(F.to_json(F.parse_json(F.lit(json.dumps(x)))))
            out = out & below
    return _sure(out)


def like(c: Column, pattern: str, fold: bool = False) -> Column:
    """``%`` is any run; ``_`` and backslash are literal. Null never matches."""
    escaped = pattern.replace("\\", "\\\\").replace("_", "\\_")
    return _sure((F.lower(c).like(escaped.lower()) if fold else c.like(escaped)))


def _compare(c: Column, op: str, v, kind: T.DataType) -> Column:
    if v is None:
        return {"_gt": c.isNotNull(), "_geq": F.lit(True), "_lt": F.lit(False), "_leq": c.isNull()}[op]
    if not _fits(v, kind):  # a number orders nothing else, and so matches nothing; other kinds are an error
        if _kind_of(v) == "number":
            return F.lit(False)
        raise FilterError(f"unexpected type of {v!r} for {kind.simpleString()}")
    v = _value(v, kind)
    return _sure({"_gt": c > v, "_geq": c >= v, "_lt": c < v, "_leq": c <= v}[op])


def _array(c: Column, op: str, cond: dict, kind: T.DataType) -> Column:
    if not isinstance(kind, T.ArrayType):
        return F.lit(False)
    inner = lambda x: predicate(x, cond, kind.elementType)
    if op == "_any":
        return _sure(F.exists(c, inner))
    return _sure(c.isNotNull() & (F.forall(c, inner) if op == "_all" else ~F.exists(c, inner)))


def predicate(c: Column, cond, kind: T.DataType, depth: int = 0) -> Column:
    """A field's condition: operators by name, a bare value for equality, or null."""
    if MAX_DEPTH and depth > MAX_DEPTH:
        raise FilterError("the filter is nested too deeply")
    if not isinstance(cond, dict):
        return equal(c, cond, kind)
    out = F.lit(True)
    for op, v in cond.items():
        op = ALIASES.get(op, op)
        if op == "_eq":
            p = equal(c, v, kind)
        elif op == "_neq":
            p = ~equal(c, v, kind)
        elif op in ("_gt", "_geq", "_lt", "_leq"):
            p = _compare(c, op, v, kind)
        elif op in ("_in", "_nin"):
            p = F.lit(False)
            for x in v:
                p = p | equal(c, x, kind)
            if len(v) > 8 and None not in v and not any(isinstance(x, (float, dict, list)) or not _fits(x, kind) for x in v):
                p = _sure(c.isin(v))
            p = ~p if op == "_nin" else p
        elif op in ("_like", "_ilike", "_nlike", "_nilike"):
            p = like(c, v, "ilike" in op) if isinstance(kind, T.StringType) else F.lit(False)
            p = ~p if op in ("_nlike", "_nilike") else p
        elif op == "_contains":
            if not isinstance(kind, T.ArrayType):
                raise FilterError("_contains needs an array")
            p = _sure(F.exists(c, lambda x: equal(x, v, kind.elementType)))
        elif op == "_contained_in":
            p = _sure(F.forall(c, lambda x: predicate(x, {"_in": v}, kind.elementType)))
        elif op in ("_any", "_all", "_none"):
            p = _array(c, op, v, kind)
        elif op == "_has_key":
            p = _sure(F.array_contains(F.json_object_keys(c.cast("string")), v))
        elif op == "_and":
            p = F.lit(True)
            for x in v or []:
                p = p & predicate(c, x, kind, depth + 1)
        elif op == "_or":
            p = F.lit(v is None)
            for x in v or []:
                p = p | predicate(c, x, kind, depth + 1)
        elif op == "_not":
            p = F.lit(True) if v is None else ~predicate(c, v, kind, depth + 1)
        elif not op.startswith("_") and isinstance(kind, (T.StringType, T.VariantType)):
            p = json_path(c, [op], v, kind)
        else:
            raise FilterError(f"no such operator: {op}")
        out = out & p
    return out


def index_predicate(c: Column, cond: dict, kind: T.DataType) -> Column:
    """A condition as entries of an index meet it: what isn't text meets no pattern, not even a negated one; rows themselves do (``predicate``)."""
    patterns = {"_like", "_ilike", "_nlike", "_nilike"} & set(cond)
    out = predicate(c, cond, kind)
    return out & F.lit(isinstance(kind, T.StringType)) & c.isNotNull() if patterns else out


def json_path(c: Column, path: list[str], cond, kind: T.DataType) -> Column:
    """A condition below keys of a JSON object; a missing key meets only a null operand, ``_in`` and ``_nin`` as null."""
    if isinstance(cond, dict) and cond and not next(iter(cond)).startswith("_"):
        out = F.lit(True)
        for key, below in cond.items():
            out = out & json_path(c, [*path, key], below, kind)
        return out
    parsed = c if isinstance(kind, T.VariantType) else F.try_parse_json(c)
    at = "$." + ".".join(path)
    there = F.try_variant_get(parsed, at, "variant").isNotNull()
    cond, out = cond if isinstance(cond, dict) else {"_eq": cond}, F.lit(True)
    for op, v in cond.items():
        if isinstance(v, dict) and op in ("_eq", "_neq"):
            p = _object(F.try_variant_get(parsed, at, "variant"), v, T.VariantType())
            out = out & (p if op == "_eq" else there & ~p)
            continue
        sample = next((x for x in v if x is not None), None) if isinstance(v, list) else v
        name, of = next(((n, t) for k, n, t in ((bool, "boolean", T.BooleanType()), ((int, float), "double", T.DoubleType())) if isinstance(sample, k)), ("string", T.StringType()))
        p = predicate(F.try_variant_get(parsed, at, name), {op: v}, of)
        out = out & (p if op in ("_in", "_nin") or v is None else there & p)
    return out


def compile_filter(cond: dict | None, field: Callable[[str, object], Column | None], schema: T.StructType, col: Callable[[str], Column] = F.col, depth: int = 0) -> Column:
    """The whole filter. ``field`` may answer for keys that aren't columns (relations, aliases)."""
    if MAX_DEPTH and depth > MAX_DEPTH or MAX_WIDTH and cond and len(cond) > MAX_WIDTH:
        raise FilterError("the filter is too deep or too wide")
    out = F.lit(True)
    for key, v in (cond or {}).items():
        if key in ("_and", "_or"):
            parts = [compile_filter(x, field, schema, col, depth + 1) for x in v or []]
            p = F.lit(key == "_and" or v is None)
            for x in parts:
                p = p & x if key == "_and" else p | x
        elif key == "_not":
            p = F.lit(True) if v is None else ~compile_filter(v, field, schema, col, depth + 1)
        elif (own := field(key, v)) is not None:
            p = own
        elif key in schema.fieldNames():
            p = predicate(col(key), v, schema[key].dataType)
        else:
            raise FilterError(f"no such field: {key}")
        out = out & p
    return out
