"""Commits as a query root: the log of a collection, filtered, walked, ordered, grouped and summed.

A commit has cid, docID, fieldName (``_C``: the document itself), height,
delta, heads (the commits of the same field that it builds on), links (of a
document's commit: the fields' commits of the same change),
collectionVersionId and signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from .graphql import Node, QueryError

FIELDS = ("cid", "docID", "fieldName", "height", "delta", "heads", "links", "collectionVersionId", "signature", "deleted")
#: Steps that a walk takes at most where none are given.
MOST_STEPS = 10_000


def rendered(log: DataFrame) -> DataFrame:
    """A log (doc_id, field, priority, value, delta, deleted, cid, parents and, where there are, links, version, signature) as commits."""
    has = lambda name, kind: F.col(name) if name in log.columns else F.lit(None).cast(kind)
    delta = F.coalesce(F.col("value").cast("string"), F.col("delta").cast("string"))
    heads = F.transform(F.coalesce(has("parents", "array<string>"), F.array().cast("array<string>")), lambda c: F.struct(c.alias("cid"), F.col("field").alias("fieldName")))
    return log.select("cid", F.col("doc_id").alias("docID"), F.col("field").alias("fieldName"), F.col("priority").alias("height"), delta.alias("delta"), heads.alias("heads"), F.coalesce(has("links", "array<struct<cid:string,fieldName:string>>"), F.array().cast("array<struct<cid:string,fieldName:string>>")).alias("links"), has("version", "string").alias("collectionVersionId"), has("signature", "string").alias("signature"), F.coalesce(has("deleted", "boolean"), F.lit(False)).alias("deleted"))


def heights(cond: dict | None) -> Column | None:
    """What a filter says of the height for certain: conditions at the top and below ``_and``; anything below ``_or`` or ``_not`` says nothing."""
    out = None
    for key, v in (cond or {}).items():
        parts = [heights(x) for x in v or []] if key == "_and" else []
        if key == "height" and isinstance(v, dict) and set(v) <= {"_eq", "_gt", "_geq", "_lt", "_leq"}:
            h = F.col("height")
            parts = [{"_eq": h == x, "_gt": h > x, "_geq": h >= x, "_lt": h < x, "_leq": h <= x}[op] for op, x in v.items() if x is not None]
        for p in parts:
            out = p if out is None else out if p is None else out & p
    return out


def walked(rows: DataFrame, start: DataFrame, depth: int | None) -> DataFrame:
    """The commits that ``start`` (cid) reaches by heads in fewer than ``depth`` steps; each step is a join on the cid."""
    from .catalog import checkpointed

    edges = rows.select("cid", F.explode("heads.cid").alias("to"))
    front = found = checkpointed(start.select("cid").distinct())
    for _ in range((MOST_STEPS if depth is None else depth) - 1):
        step = edges.join(front, "cid", "left_semi").select(F.col("to").alias("cid")).distinct()
        front = checkpointed(step.join(found, "cid", "left_anti"))
        if front.isEmpty():
            break
        found = checkpointed(found.union(front))
    return rows.join(found, "cid", "left_semi")


def as_of(c, cids: str | list[str]) -> DataFrame:
    """The documents of a collection as they were at commits: what these build on, and what those link to, merged."""
    from ..operators import history
    from .catalog import checkpointed

    if c.log is None or c.table is None:
        raise QueryError(f"{c.name} keeps no log")
    log, cids = c.log(), [cids] if isinstance(cids, str) else list(dict.fromkeys(cids))
    edges = log.select("cid", F.explode(F.concat("parents", F.coalesce(F.transform("links", lambda x: x["cid"]), F.array().cast("array<string>")))).alias("to"))
    front = found = checkpointed(log.where(F.col("cid").isin(cids)).select("cid").distinct())
    while not front.isEmpty():
        front = checkpointed(edges.join(front, "cid", "left_semi").select(F.col("to").alias("cid")).distinct().join(found, "cid", "left_anti"))
        found = checkpointed(found.union(front))
    kinds = {f.name: f.dataType for f in c.table.schema.fields}
    counted = [k for k, r in c.rules.items() if "counter" in r]
    rows = history.documents(log.join(found, "cid", "left_semi"), list(kinds), counted, saturate=True)
    made = lambda k, t: F.from_json(k, t) if t.typeName() in ("array", "struct") else F.try_parse_json(k) if t.typeName() == "variant" else F.col(k).cast(t)
    return rows.select(*[made(k, t).alias(k) for k, t in kinds.items()], F.col("doc_id").alias("_docID"), "_deleted")


def scan(log: DataFrame, args: dict) -> DataFrame:
    """The commits of the arguments: docID, fieldName, cid (one or several), depth from the heads, filter."""
    rows = rendered(log)
    if (sure := heights(args.get("filter"))) is not None and args.get("depth") is None:
        rows = rows.where(sure)  # known before anything is joined, so it reaches the scan
    for arg in ("docID", "fieldName"):
        if args.get(arg) is not None:
            rows = rows.where(F.col(arg).isin(args[arg] if isinstance(args[arg], list) else [args[arg]]))
    cids = args.get("cid")
    if cids is not None:
        cids = list(dict.fromkeys([cids] if isinstance(cids, str) else cids))
    depth = args.get("depth")
    if depth is not None:
        if not isinstance(depth, int) or depth < 1:
            raise QueryError("depth is at least 1")
        if cids is not None:
            start = rows.where(F.col("cid").isin(cids))
        else:
            start = rows.join(rows.select(F.explode("heads.cid").alias("cid")).distinct(), "cid", "left_anti")
        rows = walked(rows, start, depth)
    elif cids is not None:
        rows = rows.where(F.col("cid").isin(cids)).dropDuplicates(["cid", "docID"])
    if args.get("filter"):
        rows = rows.where(compile_filter({k: v for k, v in args["filter"].items() if k != "_alias"}, lambda *_: None, rows.schema))
    return rows


def fields(rows: DataFrame, kids: list[Node]) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """What a selection shows of commits; COUNT of links or heads is their number."""
    out = []
    for kid in kids:
        if kid.name == "COUNT":
            (of, _), = kid.args.items()
            out.append((kid.alias, F.size(of).cast("long")))
        elif kid.name not in FIELDS:
            raise QueryError(f"commits have no {kid.name}")
        elif kid.kids:
            out.append((kid.alias, _each(kid)))
        else:
            out.append((kid.alias, F.col(kid.name)))
    return rows, out


def _each(kid: Node) -> Column:
    return F.transform(kid.name, lambda x: F.struct(*[x[k.name].alias(k.alias) for k in kid.kids]))


def aggregate(kind: str, rows: DataFrame, field: str | None) -> Column:
    """An aggregate of commits; ``delta`` is decoded as a number, and what isn't one adds nothing."""
    value = F.lit(1) if field is None else F.expr("try_cast(delta as double)") if field == "delta" else F.col(field)
    if kind == "COUNT":
        return F.count(F.lit(1))
    if kind == "SUM":
        return F.coalesce(F.sum(value), F.lit(0))
    return F.coalesce(F.avg(value), F.lit(0.0)) if kind == "AVG" else F.min(value) if kind == "MIN" else F.max(value)


def log_of(catalog, args: dict) -> DataFrame:
    """The log of one collection, or those of all that keep one."""
    names = [args["collection"]] if args.get("collection") else sorted(n for n, c in catalog.collections.items() if c.log)
    logs = [catalog[n].log() for n in names if catalog[n].log]
    if not logs:
        raise QueryError("no collection keeps a log")
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def select(catalog, node: Node) -> DataFrame:
    """``_commits``; unless ordered by docID, then field, the document's own commits last, then falling height."""
    args, rows = node.args, scan(log_of(catalog, node.args), node.args)
    if by := args.get("groupBy"):
        by = [by] if isinstance(by, str) else by
        aggs, shown = [], []
        for kid in node.kids:
            if kid.name in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
                aggs.append(aggregate(kid.name, rows, (kid.args.get("GROUP") or {}).get("field")).alias(kid.alias))
            elif kid.name == "GROUP":
                row = F.struct(*[f.alias(n) for n, f in fields(rows, kid.kids)[1]])
                aggs.append(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("h"), "cid", row.alias("row")))), lambda x: x["row"]).alias(kid.alias))
            elif kid.name not in by:
                raise QueryError(f"{kid.name} isn't grouped by")
            else:
                shown.append(F.col(kid.name).alias(kid.alias))
                continue
            shown.append(F.col(kid.alias))
        rows = rows.groupBy(*by).agg(*aggs) if aggs else rows.select(*by).distinct()
    else:
        rows, named = fields(rows, node.kids)
        shown = [f.alias(n) for n, f in named]
    order = args.get("order") or []
    keys = [(k, str(w).upper()) for item in (order if isinstance(order, list) else [order]) for k, w in item.items()]
    sort = [F.col(k).asc_nulls_first() if w == "ASC" else F.col(k).desc_nulls_last() for k, w in keys]
    if sort:
        rows = rows.orderBy(*sort, *([] if by else [F.col("cid")]))
    elif not by and not args.get("unordered"):
        rows = rows.orderBy("docID", F.col("fieldName") == "_C", "fieldName", F.desc("height"), "cid")
    rows = rows.offset(args["offset"]) if args.get("offset") else rows
    rows = rows.limit(args["limit"]) if args.get("limit") else rows
    return rows.select(*shown)


def total(catalog, kind: str, args: dict, alias: str) -> DataFrame:
    """An aggregate over commits as one row."""
    rows = scan(log_of(catalog, args), args)
    return rows.agg(aggregate(kind, rows, args.get("field")).alias(alias))
