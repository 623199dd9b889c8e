"""Pages by cursor: a token names the last row seen, and a page is a range of the order behind or before it."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphql import QueryError


def encode(doc_id: str, keys: list, order: list) -> str:
    """The token of a row; it is read by ``decode`` and by the queries here."""
    return base64.urlsafe_b64encode(json.dumps({"d": doc_id, "k": keys, "o": order}, separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def decode(token: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError as e:
        raise QueryError(f"no cursor: {token!r}") from e


def _beyond(names: list[tuple[str, bool]], at: list, kinds: dict) -> Column:
    """Rows behind the boundary ``at`` in the order of (column, ascending); nulls come first ascending, last descending."""
    out = F.lit(False)
    for k, (name, up) in enumerate(names):
        c, v = F.col(name), at[k]
        value = F.lit(v).cast(kinds[name]) if v is not None else None
        more = (c.isNotNull() if up else F.lit(False)) if v is None else (c > value if up else (c < value) | c.isNull())
        same = [F.col(n).eqNullSafe(F.lit(x).cast(kinds[n]) if x is not None else F.lit(None)) for (n, _), x in zip(names[:k], at)]
        out = out | reduce(lambda a, b: a & b, same, F.coalesce(more, F.lit(False)))
    return out


#: What a page's rows carry beside the selection: the row's token, and whether there are rows behind and before the page.
MARKS = ("_cursor", "_hasNext", "_hasPrevious")


def page(planner, df: DataFrame, c, args: dict) -> DataFrame:
    """The rows of a page, with MARKS. ``first``/``after`` run forward, ``last``/``before`` backward.

    One row more than asked for is read to know whether there are more. A token
    must be of the query's order. Behind a document that isn't there lies
    nothing; before it, everything.
    """
    if "first" in args and "last" in args or "limit" in args or "offset" in args or "after" in args and "before" in args:
        raise QueryError("first and last exclude each other, as do after and before, and limit and offset")
    n = args.get("last", args.get("first"))
    if n is not None and (not isinstance(n, int) or n < 1):
        raise QueryError("first and last are at least 1")
    order = args.get("order") or []
    order = order if isinstance(order, list) else [order]
    names = [(k, str(w).upper() == "ASC") for item in order for k, w in item.items()]
    for k, _ in names:
        if k not in df.columns:
            raise QueryError(f"{c.name} has no field {k} to order pages by")
    full = [*names, ("_docID", True)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    back = "last" in args or "before" in args
    token = args.get("before" if back else "after")
    if token is not None:
        said = decode(token)
        if said.get("o") != [k for k, _ in names]:
            raise QueryError("the cursor is of another order")
        there = df.where(F.col("_docID") == said["d"]).limit(1).agg((F.count(F.lit(1)) > 0).alias("__there"))
        beyond = _beyond([(k, up != back) for k, up in full], [*said["k"], said["d"]], kinds)
        df = df.crossJoin(F.broadcast(there)).where(F.when(F.col("__there"), beyond).otherwise(F.lit(back))).drop("__there")  # one row
    sort = lambda flip: [F.col(k).asc_nulls_first() if up != flip else F.col(k).desc_nulls_last() for k, up in full]
    df = df.orderBy(*sort(back))
    more = F.lit(False)
    if n:
        rows = df.limit(n + 1)
        df = rows.withColumn("__row", F.row_number().over(Window.orderBy(*sort(back)))).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy()))  # n + 1 rows
        more = F.col("__all") > n
        df = df.where(F.col("__row") <= n)
    df = df.orderBy(*sort(False))
    parts = F.to_json(F.struct(F.col("_docID").alias("d"), F.array(*[F.col(k).cast("string") for k, _ in names]).alias("k"), F.array(*[F.lit(k) for k, _ in names]).alias("o")), {"ignoreNullFields": "false"})
    token_of = F.rtrim(F.translate(F.base64(parts.cast("binary")), "+/\r\n", "-_"), F.lit("="))
    given = F.lit(token is not None)
    return df.withColumn("_cursor", token_of).withColumn("_hasNext", given if back else more).withColumn("_hasPrevious", more if back else given).drop("__row", "__all")
