"""From a parsed selection to a DataFrame.

The order of steps: scan and filter, relation filters as semi joins, relation
aggregates and nested selections, scores, alias filter, grouping, order, limit.
Children are aggregated by their foreign key before they meet their parents, so
a to-many relation never multiplies rows.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.filters import compile_filter, predicate
from ..operators import search
from .catalog import Catalog, Collection, Relation
from .graphql import Node, QueryError, parse

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


class Planner:
    def __init__(self, catalog: Catalog, exhaustive: bool = False):
        self.catalog, self.names, self.exhaustive, self.warnings = catalog, 0, exhaustive, []
        #: docIDs that the root is confined to, as a DataFrame.
        self.within: DataFrame | None = None

    def new(self, what: str) -> str:
        self.names += 1
        return f"__{what}{self.names}"

    # rows

    def scan(self, c: Collection, args: dict) -> DataFrame:
        if args.get("cid") is not None:
            from . import commits

            df = commits.as_of(c, args["cid"])
        else:
            df = c.frame()
        if not args.get("showDeleted"):
            df = df.where(~F.col("_deleted"))
        if c.grants is not None:  # before anything is grouped, limited or counted
            from ..operators.views import readable

            df = readable(df, c.grants(), self.catalog.identity or "")
        ids = args.get("docIDs", args.get("docID"))
        if ids is not None:
            df = df.where(F.col("_docID").isin([ids] if isinstance(ids, str) else ids))
        return self.filtered(df, c, args.get("filter"))

    def filtered(self, df: DataFrame, c: Collection, cond: dict | None) -> DataFrame:
        """Top-level conditions on relations become semi joins, those within ``_or`` and ``_not`` flags of an outer join."""
        if not cond:
            return df
        columns, plain = df.columns, {k: v for k, v in cond.items() if k in c.relations and v is not None}
        rest = {k: v for k, v in cond.items() if k not in plain and k != "_alias"}
        for key, v in plain.items():
            r = c.relations[key]
            keys = self.children(r, {"filter": v}).select(F.col(r.theirs).alias("__their")).where("__their is not null")
            df = df.join(keys, df[r.ours] == keys["__their"], "left_semi")
        held = [df]

        def related(key: str, v) -> Column | None:
            if key not in c.relations:
                return None
            r, flag = c.relations[key], self.new("flag")
            keys = self.children(r, {"filter": v}).select(F.col(r.theirs).alias(flag)).where(F.col(flag).isNotNull()).distinct()
            held[0] = held[0].join(keys, held[0][r.ours] == keys[flag], "left")
            return F.col(flag).isNotNull()

        where = compile_filter(rest, related, df.schema)
        return held[0].where(where).select(*columns)

    def children(self, r: Relation, args: dict) -> DataFrame:
        return self.scan(self.catalog[r.to], args)

    # expressions of one row

    def order(self, df: DataFrame, c: Collection | None, order) -> tuple[DataFrame, list[Column]]:
        """Sort columns, nulls first ascending and last descending; a relation path is joined in."""
        out = []
        for item in order if isinstance(order, list) else [order]:
            for key, way in item.items():
                if way is None:
                    continue
                if isinstance(way, dict) and c is not None and key in c.relations:
                    df, key, way = self.along(df, c, key, way)
                elif key == "_alias":
                    (key, way), = way.items()
                out.append(F.col(key).asc_nulls_first() if str(way).upper() == "ASC" else F.col(key).desc_nulls_last())
        return df, out

    def along(self, df: DataFrame, c: Collection, key: str, way: dict) -> tuple[DataFrame, str, str]:
        """``df`` with the value at the end of a relation path, the column's name and the direction.

        Rows without a related one stay, their value null. An index on the value
        orders by walking through it, which leaves them out unless the query is
        exhaustive.
        """
        r, hidden, k = c.relations[key], self.new("sort"), self.new("key")
        to = self.catalog[r.to]
        rows, ((inner, way),) = self.children(r, {}), way.items()
        if isinstance(way, dict) and inner in to.relations:
            rows, inner, way = self.along(rows, to, inner, way)
        other = rows.select(F.col(r.theirs).alias(k), F.col(inner).alias(hidden))
        other = other if r.theirs == to.key else other.groupBy(k).agg(F.min(hidden).alias(hidden))
        walked = not self.exhaustive and any(i.fields[0] == inner and i.kind == "ordered" for i in to.indexes)
        return df.join(other, df[r.ours] == other[k], "inner" if walked else "left").drop(k), hidden, way

    def window(self, df: DataFrame, c: Collection | None, args: dict) -> DataFrame:
        """Order, offset and limit; limit 0 is none. Where there is an order or an offset, ties go by key, so pages are the same each time.

        A limit without an order stops the scan at the first rows found.
        """
        ids = args.get("docIDs", args.get("docID"))
        ties = [F.col("_docID").asc()] if c is not None and c.ordered and "_docID" in df.columns else []
        if args.get("order"):
            df, keys = self.order(df, c, args["order"])
            df = df.orderBy(*keys, *ties)
        elif isinstance(ids, list) and "_docID" in df.columns:
            df = df.orderBy(F.array_position(F.array(*map(F.lit, ids)), F.col("_docID")))  # as asked
        elif args.get("offset") and ties:
            df = df.orderBy(*ties)
        if args.get("offset"):
            df = df.offset(args["offset"])
        return df.limit(args["limit"]) if args.get("limit") else df

    def first_of_each(self, df: DataFrame, c: Collection | None, keys: list[str], args: dict) -> DataFrame:
        """Order, offset and limit within each of ``keys``; ``__place`` is a row's place in the order."""
        df, sort = self.order(df, c, args.get("order") or [])
        ties = [F.col("_docID").asc()] if "_docID" in df.columns else []
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(sort + ties or [F.lit(1)])))
        lo, n = args.get("offset") or 0, args.get("limit") or 0
        return df.withColumn("__place", place).where((F.col("__place") > lo) & (F.col("__place") <= lo + n if n else F.lit(True)))

    @staticmethod
    def aggregate(kind: str, value: Column | None, keep: Column | None = None) -> Column:
        """Null-free defaults: sums, averages and counts of nothing are 0, extremes null."""
        value = F.lit(1) if value is None else value
        value = value if keep is None else F.when(keep, value)
        if kind == "COUNT":
            return F.count(value)
        if kind == "SUM":
            return F.coalesce(F.sum(value), F.lit(0))
        if kind == "AVG":
            return F.coalesce(F.avg(value), F.lit(0.0))
        return F.min(value) if kind == "MIN" else F.max(value)

    def with_aggregate(self, rows: DataFrame, c: Collection, name: str | None, kids: list[Node]) -> DataFrame:
        """``rows`` with an aggregate that is selected as ``name`` beside them, so it can be aggregated again."""
        if name is None or name in rows.columns:
            return rows
        if not (own := [k for k in kids if k.alias == name and k.name in AGGREGATES]):
            raise QueryError(f"{c.name} has no field {name}")
        return self.fields(rows, c, own[:1])[0]

    def related_aggregate(self, df: DataFrame, c: Collection, node: Node, siblings: list[Node] = ()) -> DataFrame:
        """COUNT, SUM, ... over children, each target summed up by its foreign key first; or over an array of the row."""
        parts = []
        for target, args in node.args.items():
            args = args or {}
            if target not in c.relations:
                parts.append(self.inline(node.name, df.schema[target], args))
                continue
            r, name, k = c.relations[target], self.new("agg"), self.new("key")
            rows = self.children(r, args)
            if args.get("limit") or args.get("offset"):
                rows = self.first_of_each(rows, self.catalog[r.to], [r.theirs], args)
            rows = self.with_aggregate(rows, self.catalog[r.to], args.get("field"), [k for n in siblings if n.name == target for k in n.kids])
            value = F.col(args["field"]) if "field" in args else None
            if node.name == "AVG":
                one = F.struct(F.sum(value.cast("double")).alias("s"), F.count(value).alias("n"))
            else:
                one = self.aggregate(node.name, value if node.name != "COUNT" else None)
            some = rows.groupBy(F.col(r.theirs).alias(k)).agg(one.alias(name))
            df = df.join(some, df[r.ours] == some[k], "left").drop(k)
            parts.append(F.col(name))
        if node.name in ("COUNT", "SUM"):
            out = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
        elif node.name == "AVG":
            total = lambda f: reduce(lambda a, b: a + b, [F.coalesce(p[f], F.lit(0)) for p in parts])
            out = F.when(total("n") > 0, total("s") / total("n")).otherwise(0.0)
        else:
            out = parts[0] if len(parts) == 1 else (F.least if node.name == "MIN" else F.greatest)(*parts)
        return df.withColumn(node.alias, out)

    def inline(self, kind: str, field: T.StructField, args: dict) -> Column:
        """An aggregate over the row's own array, or over its scalar fields."""
        c = F.col(field.name)
        if not isinstance(field.dataType, T.ArrayType):
            c, element = F.array(c), field.dataType
        else:
            element = field.dataType.elementType
        kept = F.filter(c, lambda x: x.isNotNull())
        if args.get("filter"):
            kept = F.filter(kept, lambda x: predicate(x, args["filter"], element))
        elif kind == "COUNT":
            kept = c
        if args.get("order"):
            kept = F.sort_array(kept, str(args["order"]).upper() == "ASC")
        if args.get("limit") or args.get("offset"):
            kept = F.slice(kept, (args.get("offset") or 0) + 1, F.lit(args.get("limit") or 1 << 30))
        total = F.aggregate(kept, F.lit(0).cast("double" if isinstance(element, (T.DoubleType, T.FloatType)) else "long"), lambda a, x: a + x)
        n = F.coalesce(F.size(kept), F.lit(0))
        if kind == "COUNT":
            return F.greatest(n, F.lit(0)).cast("long")
        if kind == "SUM":
            return F.coalesce(total, F.lit(0))
        if kind == "AVG":
            mean = F.struct(total.alias("s"), n.alias("n"))
            return mean if not isinstance(field.dataType, T.ArrayType) else F.when(n > 0, total / n).otherwise(0.0)
        return F.array_min(kept) if kind == "MIN" else F.array_max(kept)

    # selections

    def nested(self, df: DataFrame, c: Collection, node: Node) -> DataFrame:
        """A child as a struct or children as an array of structs, joined by key."""
        r, k, args = c.relations[node.name], self.new("key"), node.args
        to = self.catalog[r.to]
        rows = self.children(r, args).withColumn(k, F.col(r.theirs))
        if args.get("groupBy"):
            rows, fields = self.group(rows, to, [k], node)
        else:
            rows, fields = self.fields(rows, to, node.kids, by=k)
            rows = self.aliased(rows, args.get("filter"))
            if r.many and (args.get("order") or args.get("limit") or args.get("offset")):
                rows = self.first_of_each(rows, to, [k], args)
        row = F.struct(*[f.alias(n) for n, f in fields])
        if not r.many and r.theirs == to.key:  # one row a key: no need to look for the first
            some = rows.select(k, row.alias(node.alias))
            return df.join(some, df[r.ours] == some[k], "left").drop(k)
        place = F.col("__place") if "__place" in rows.columns else F.col("_docID") if to.ordered and "_docID" in rows.columns else None
        if not r.many:
            some = rows.groupBy(k).agg((F.min_by(row, F.col("_docID")) if place is None else F.min_by(row, place)).alias(node.alias))
            return df.join(some, df[r.ours] == some[k], "left").drop(k)
        return self.gathered(df, df[r.ours], rows, k, row, place, node.alias)

    @staticmethod
    def gathered(df: DataFrame, ours: Column, rows: DataFrame, k: str, row: Column, place: Column | None, alias: str) -> DataFrame:
        """``df`` with the ``rows`` of its key as an array, by ``place`` where there is one; no rows: an empty array."""
        listed = F.collect_list(row) if place is None else F.array_sort(F.collect_list(F.struct(place.alias("at"), row.alias("row"))))
        some = rows.groupBy(k).agg(listed.alias(alias))
        if place is not None:
            some = some.withColumn(alias, F.transform(alias, lambda x: x["row"]))
        out = df.join(some, ours == some[k], "left").drop(k)
        return out.withColumn(alias, F.coalesce(alias, F.array().cast(some.schema[alias].dataType)))

    def fields(self, df: DataFrame, c: Collection, kids: list[Node], by: str | None = None) -> tuple[DataFrame, list[tuple[str, Column]]]:
        """What a selection shows, computed as columns of ``df``; ``by``: the column of the parent that the rows belong to."""
        out = []
        for node in kids:
            if node.name in AGGREGATES:
                df = self.related_aggregate(df, c, node, kids)
            elif node.name == "SIMILARITY":
                (name, how), = node.args.items()
                metric = how.get("metric") or next((i.options["metric"] for i in c.indexes if i.kind == "vector" and i.fields[0] == name and "metric" in i.options), "cosine")
                df = df.withColumn(node.alias, search.similarity(F.col(name), how["vector"], metric))
            elif node.name == "BM25":
                df = self.full_text(df, c, node, by)
            elif node.name == "_version":
                df = self.versions(df, c, node)
            elif node.name == "__typename":
                df = df.withColumn(node.alias, F.lit(c.name))
            elif node.name in c.relations:
                if not node.kids:
                    raise QueryError(f"{node.name} needs a selection")
                df = self.nested(df, c, node)
            elif node.kids and node.name not in df.columns:
                raise QueryError(f"{c.name} has no relation {node.name}")
            elif node.name.startswith("_") and node.name.endswith("ID") and node.name[1:-2] in c.relations:
                df = self.related_id(df, c.relations[node.name[1:-2]], node.alias)
            else:
                out.append((node.alias, F.col(node.name)))
                continue
            out.append((node.alias, F.col(node.alias)))
        return df, out

    def full_text(self, df: DataFrame, c: Collection, node: Node, by: str | None) -> DataFrame:
        """BM25 over the row's fields and, along relation paths, the sum of the children's; within a parent its statistics are those of its children."""
        fields = node.args["fields"]
        own, parts = [], []
        for f in [fields] if isinstance(fields, str) else fields:
            if "." not in f:
                own.append(f)
                continue
            name, inner = f.split(".", 1)
            if name not in c.relations:
                raise QueryError(f"{c.name} has no relation {name}")
            r, hidden, k = c.relations[name], self.new("text"), self.new("key")
            rows = self.full_text(self.children(r, {}), self.catalog[r.to], Node("BM25", hidden, node.args | {"fields": [inner]}), None)
            some = rows.groupBy(F.col(r.theirs).alias(k)).agg(F.sum(hidden).alias(hidden))
            df = df.join(some, df[r.ours] == some[k], "left").drop(k)
            parts.append(F.coalesce(hidden, F.lit(0.0)))
        if own:
            hidden = self.new("text")
            df = search.bm25(df, own, node.args["query"], hidden, by=by, language=node.args.get("language"))
            parts.append(F.col(hidden))
        return df.withColumn(node.alias, reduce(lambda x, y: x + y, parts))

    def versions(self, df: DataFrame, c: Collection, node: Node) -> DataFrame:
        """Each document's own commits, newest first, as an array of structs."""
        from . import commits

        if c.log is None:
            raise QueryError(f"{c.name} keeps no log")
        k = self.new("key")
        rows = commits.rendered(c.log()).where("fieldName = '_C'").withColumn(k, F.col("docID"))
        rows, fields = commits.fields(rows, node.kids)
        row = F.struct(*[f.alias(n) for n, f in fields])
        return self.gathered(df, df["_docID"], rows.withColumn("__place", F.struct(-F.col("height"), F.col("cid"))), k, row, F.col("__place"), node.alias)

    def related_id(self, df: DataFrame, r: Relation, alias: str) -> DataFrame:
        k, to = self.new("key"), self.catalog[r.to]
        rows = self.children(r, {})
        if r.theirs == to.key:
            some = rows.select(F.col(r.theirs).alias(k), F.col("_docID").alias(alias))
        else:
            some = rows.groupBy(F.col(r.theirs).alias(k)).agg(F.min("_docID").alias(alias))
        return df.join(some, df[r.ours] == some[k], "left").drop(k)

    def select(self, node: Node) -> DataFrame:
        if node.name == "_commits":
            from . import commits

            return commits.select(self.catalog, node)
        if node.name.startswith("encrypted_"):
            return self.encrypted(self.catalog[node.name.removeprefix("encrypted_")], node)
        c = self.catalog[node.name]
        df = self.scan(c, node.args)
        if self.within is not None:
            df = df.join(self.within.select("_docID").distinct(), "_docID", "left_semi")
        if "groupBy" in node.args:
            out, shown = self.group(df, c, [], node)
            return out.select(*[f.alias(n) for n, f in shown])
        if any(k in node.args for k in ("first", "last", "after", "before")):
            from .cursor import MARKS, page

            df = page(self, df, c, node.args)
            df, shown = self.fields(df, c, node.kids)
            return df.select(*[f.alias(n) for n, f in shown], *MARKS)
        df, shown = self.fields(df, c, node.kids)
        df = self.aliased(df, node.args.get("filter"))
        self.routed(c, node)
        df = self.window(df, c, node.args)
        return df.select(*[f.alias(n) for n, f in shown])

    def routed(self, c: Collection, node: Node) -> None:
        """Say why a vector search can't go through an index; the search itself is complete either way."""
        if len(scored := [k for k in node.kids if k.name == "SIMILARITY"]) != 1:
            return
        (field, how), = scored[0].args.items()
        order = node.args.get("order") or []
        order = order if isinstance(order, list) else [order]
        indexes = [i for i in c.indexes if i.kind == "vector" and i.fields[0] == field]
        for fits, why in (
            (bool(node.args.get("limit")), "there is no limit"),
            (bool(order) and {k: str(w).upper() for k, w in order[0].get("_alias", {}).items()} == {scored[0].alias: "DESC"}, "the order isn't by falling similarity"),
            (bool(indexes), "there is no index"),
            (not indexes or indexes[0].options.get("dimensions", len(how["vector"])) == len(how["vector"]), "the index has other dimensions"),
        ):
            if not fits:
                self.warnings.append(f"{c.name}.{field}: all vectors are compared, as {why}")
                return

    def encrypted(self, c: Collection, node: Node) -> DataFrame:
        """The docIDs of rows whose encrypted fields equal the filter's; only fields with an encrypted index may be asked for."""
        cond, where = node.args.get("filter") or {}, F.lit(True)
        keys = {i.fields[0]: i.options["key"] for i in c.indexes if i.kind == "encrypted"}
        for field, v in cond.items():
            v = v["_eq"] if isinstance(v, dict) and set(v) == {"_eq"} else v
            if field not in keys or isinstance(v, (dict, list)):
                raise QueryError(f"{field} has no encrypted index, or the condition isn't equality")
            where = where & (F.col(f"{field}_tag") == search.tag(F.lit(str(v)), field, keys[field]))
        return self.scan(c, {}).where(where).agg(F.array_sort(F.collect_list("_docID")).alias("docIDs"))

    def aliased(self, df: DataFrame, cond: dict | None) -> DataFrame:
        """The filter on computed columns; anything but an object drops all rows."""
        if not cond or "_alias" not in cond:
            return df
        if not isinstance(cond["_alias"], dict):
            return df.limit(0)
        return df.where(compile_filter(cond["_alias"], lambda *_: None, df.schema))

    def group(self, df: DataFrame, c: Collection, lead: list[str], node: Node) -> tuple[DataFrame, list[tuple[str, Column]]]:
        """Groups within ``lead`` columns, with aggregates over GROUP and members; null is a group, a to-one relation its key.

        Members that are groups again are grouped by all keys so far and then
        gathered, so no group is ever held as an array to be cut up.
        """
        by, names = node.args["groupBy"], []
        for k in [by] if isinstance(by, str) else by:
            if k in c.relations and c.relations[k].many:
                raise QueryError(f"{k} is a list and can't be grouped by")
            name = f"_{k}ID" if k in c.relations else k
            if k in c.relations:
                df = df.withColumn(name, F.col(c.relations[k].ours))
            elif k not in df.columns:
                raise QueryError(f"{c.name} has no field {k}")
            names.append(name)
        keys, aggs, shown, joined = [*lead, *names], [], [], []
        for kid in node.kids:
            if kid.name in AGGREGATES:
                args = kid.args.get("GROUP") or {}
                inner = next((g for g in node.kids if g.name == "GROUP" and "groupBy" in g.args and any(x.alias == args.get("field") and x.name in AGGREGATES for x in g.kids)), None)
                if inner is not None and args["field"] not in df.columns:
                    rows, _ = self.group(self.kept(df, inner.args), c, keys, inner)
                    joined.append((kid.alias, rows.groupBy(*keys).agg(self.aggregate(kid.name, None if kid.name == "COUNT" else F.col(args["field"])).alias(kid.alias))))
                else:
                    df, one = self.group_aggregate(df, keys, kid)
                    aggs.append(one.alias(kid.alias))
            elif kid.name == "GROUP":
                if "groupBy" in kid.args:
                    rows, inside = self.group(self.kept(df, kid.args), c, keys, kid)
                    row, place = F.struct(*[f.alias(n) for n, f in inside]), F.col("__place") if "__place" in rows.columns else None
                    listed = F.collect_list(row) if place is None else F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), row.alias("row")))), lambda x: x["row"])
                    joined.append((kid.alias, rows.groupBy(*keys).agg(listed.alias(kid.alias))))
                else:
                    df, one = self.members(df, c, keys, kid)
                    aggs.append(one.alias(kid.alias))
            elif kid.name == "__typename":
                shown.append((kid.alias, F.lit(c.name)))
                continue
            elif kid.name not in names:
                raise QueryError(f"{kid.name} isn't grouped by")
            else:
                shown.append((kid.alias, F.col(kid.name)))
                continue
            shown.append((kid.alias, F.col(kid.alias)))
        out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        for alias, some in joined:
            renamed = some.withColumnsRenamed({k: f"__{k}" for k in keys})
            same = reduce(lambda x, y: x & y, [out[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
            out = out.join(renamed, same, "left").drop(*[f"__{k}" for k in keys])
            if isinstance(out.schema[alias].dataType, T.ArrayType):
                out = out.withColumn(alias, F.coalesce(alias, F.array().cast(out.schema[alias].dataType)))
        out = self.aliased(out, node.args.get("filter"))
        if not lead:
            return self.window(out, None, {k: v for k, v in node.args.items() if k not in ("docID", "docIDs")}), shown
        if node.args.get("order") or node.args.get("limit") or node.args.get("offset"):
            out = self.first_of_each(out, None, lead, {"order": [{n: "ASC"} for n in names]} | node.args)
        return out, shown

    def kept(self, df: DataFrame, args: dict) -> DataFrame:
        return df.where(self.keep(df, args))

    @staticmethod
    def keep(df: DataFrame, args: dict) -> Column:
        """Which rows of a group an aggregate or a list of members is of."""
        cond = {k: v for k, v in (args.get("filter") or {}).items() if k != "_alias"}
        out = compile_filter(cond, lambda *_: None, df.schema) if cond else F.lit(True)
        ids = args.get("docIDs", args.get("docID"))
        return out if ids is None else out & F.col("_docID").isin([ids] if isinstance(ids, str) else ids)

    def placed(self, df: DataFrame, c: Collection | None, keys: list[str], args: dict) -> tuple[DataFrame, Column, Column]:
        """``df`` with each row's place in its group, by the order and then _docID, of rows that are kept; which rows are asked for; the place."""
        keep, name, flag = self.keep(df, args), self.new("place"), self.new("keep")
        df, sort = self.order(df.withColumn(flag, keep), c, args.get("order") or [])
        df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(flag), *sort, F.col("_docID").asc())))
        lo, n = args.get("offset") or 0, args.get("limit") or 0
        return df, F.col(flag) & (F.col(name) > lo) & (F.col(name) <= lo + n if n else F.lit(True)), F.col(name)

    def group_aggregate(self, df: DataFrame, keys: list[str], kid: Node) -> tuple[DataFrame, Column]:
        """An aggregate over a group, or over its first rows by _docID where there is a limit."""
        args = kid.args.get("GROUP") or {}
        if args.get("limit") or args.get("offset"):
            df, keep, _ = self.placed(df, None, keys, {k: v for k, v in args.items() if k != "order"})
        else:
            keep = self.keep(df, args) if args.get("filter") or "docIDs" in args or "docID" in args else None
        return df, self.aggregate(kid.name, F.col(args["field"]) if "field" in args and kid.name != "COUNT" else None, keep)

    def members(self, df: DataFrame, c: Collection, keys: list[str], kid: Node) -> tuple[DataFrame, Column]:
        """A group's rows as an array. Only rows that are asked for are gathered."""
        df, fields = self.fields(df, c, kid.kids)
        row, args = F.struct(*[f.alias(n) for n, f in fields]), kid.args
        if args.get("order") or args.get("limit") or args.get("offset"):
            df, keep, place = self.placed(df, c, keys, args)
        else:
            keep, place = self.keep(df, args), F.col("_docID")
        listed = F.array_sort(F.collect_list(F.when(keep, F.struct(place.alias("at"), row.alias("row")))))
        return df, F.transform(listed, lambda x: x["row"])

    def top_level(self, node: Node) -> DataFrame:
        """COUNT(User: {filter: ...}) and the like: one row."""
        (name, args), = list(node.args.items())[:1]
        args = args or {}
        if name == "_commits":
            from . import commits

            return commits.total(self.catalog, node.name, args, node.alias)
        df = self.scan(self.catalog[name], args)
        if node.name == "COUNT" and args.get("groupBy"):
            return df.select(*args["groupBy"]).distinct().agg(F.count(F.lit(1)).alias(node.alias))
        df = self.window(df, self.catalog[name], args) if args.get("limit") or args.get("offset") else df
        return df.agg(self.aggregate(node.name, F.col(args["field"]) if "field" in args and node.name != "COUNT" else None).alias(node.alias))


def _aggregates(planner: Planner, roots: list[Node]) -> DataFrame:
    """Top-level aggregates as one row; those over the same rows share a scan."""
    scans: dict[str, list[Node]] = {}
    for node in roots:
        (name, args), = list(node.args.items())[:1]
        rest = {k: v for k, v in (args or {}).items() if k != "field"}
        scans.setdefault(repr((name, rest, "groupBy" in rest)), []).append(node)
    out = None
    for nodes in scans.values():
        (name, args), = list(nodes[0].args.items())[:1]
        if len(nodes) == 1 or name == "_commits" or (args or {}).get("groupBy"):
            rows = [planner.top_level(n) for n in nodes]
        else:
            df = planner.scan(planner.catalog[name], args or {})
            df = planner.window(df, planner.catalog[name], args) if args.get("limit") or args.get("offset") else df
            field = lambda n: (list(n.args.values())[0] or {}).get("field")
            rows = [df.agg(*[planner.aggregate(n.name, F.col(field(n)) if field(n) and n.name != "COUNT" else None).alias(n.alias) for n in nodes])]
        for one in rows:
            out = one if out is None else out.crossJoin(F.broadcast(one))  # rows of one each
    return out.select(*[n.alias for n in roots])


def query(catalog: Catalog, text: str, variables: dict | None = None) -> DataFrame:
    """The rows of a query with one root, or the one row of several aggregates; of a mutation the rows that it returns."""
    op = parse(text, variables)[0]
    if op.kind == "mutation":
        from .mutate import mutate

        if len(op.roots) != 1:
            raise QueryError("one root of a mutation is wanted")
        return mutate(catalog, op.roots[0])
    planner = Planner(catalog, "exhaustive" in op.directives)
    if op.kind == "query" and op.roots and all(r.name in AGGREGATES for r in op.roots):
        return _aggregates(planner, op.roots)
    if op.kind != "query" or len(op.roots) != 1:
        raise QueryError("one root of a query is wanted")
    return planner.select(op.roots[0])


def respond(catalog: Catalog, text: str, variables: dict | None = None) -> dict:
    """All roots as nested data, with errors instead of data where a query can't be planned, and warnings as an extension.

    Rows come to the driver a partition at a time; who wants a large result
    writes the DataFrame of ``query`` instead.
    """
    data, warnings = {}, []
    try:
        op = parse(text, variables)[0]
        if op.kind == "subscription":
            raise QueryError("a subscription needs a stream")
        for root in op.roots:
            if op.kind == "mutation":
                from .mutate import mutate

                data[root.alias] = [r.asDict(True) for r in mutate(catalog, root).toLocalIterator()]
                continue
            if root.name in ("__schema", "__type"):
                from .schema import introspect

                data[root.alias] = introspect(catalog, root)
                continue
            planner = Planner(catalog, "exhaustive" in op.directives)
            if root.name in AGGREGATES:
                data[root.alias] = planner.top_level(root).first()[0]
                continue
            data[root.alias] = [r.asDict(True) for r in planner.select(root).toLocalIterator()]
            ids = root.args.get("docIDs", root.args.get("docID"))
            if ids is not None and not root.args.get("filter") and root.name in catalog.collections:
                ids = dict.fromkeys([ids] if isinstance(ids, str) else ids)
                there = {r[0] for r in planner.scan(catalog[root.name], {k: v for k, v in root.args.items() if k in ("docIDs", "docID", "showDeleted")}).select("_docID").collect()}  # no more than were asked for
                warnings += [f"{root.name} has no document {i}" for i in ids if i not in there]
            warnings += planner.warnings
    except (ValueError, KeyError) as e:
        return {"data": None, "errors": [{"message": str(e)}]}
    return {"data": data} | ({"extensions": {"warnings": warnings}} if warnings else {})


def explain(catalog: Catalog, text: str, variables: dict | None = None, kind: str = "simple") -> dict:
    """The selection's columns and Spark's plan: ``simple`` as it will run, ``debug`` with all logical plans, ``execute`` run, with rows and seconds."""
    df = query(catalog, text, variables)
    if kind not in ("simple", "debug", "execute"):
        raise QueryError(f"no such explanation: {kind}")
    out = {}
    if kind == "execute":
        start = time.monotonic()
        out = {"rows": df.count(), "seconds": time.monotonic() - start}
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended" if kind == "debug" else "formatted")
    return {"columns": df.columns, "plan": df._jdf.queryExecution().explainString(mode)} | out
