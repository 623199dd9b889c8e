"""Stored queries, transforms, read policies and encrypted equality."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.catalog import Catalog
from ..plans.select import query
from . import search


def live(catalog: Catalog, name: str, text: str, *lenses: Callable[[DataFrame], DataFrame]) -> None:
    """A collection that is its query, each time it is read; lenses transform its rows in turn."""
    catalog.add(name, lambda: reduce(lambda df, f: f(df), lenses, query(catalog, text)))


def materialized(catalog: Catalog, name: str, text: str, path: str, *lenses: Callable[[DataFrame], DataFrame]) -> Callable[[], None]:
    """A collection that is stored at ``path``; the function returned refreshes it."""

    def refresh() -> None:
        reduce(lambda df, f: f(df), lenses, query(catalog, text)).write.mode("overwrite").parquet(path)

    refresh()
    catalog.add(name, lambda: catalog.spark.read.parquet(path))
    return refresh


def readable(df: DataFrame, grants: DataFrame, identity: str, key: str = "_docID") -> DataFrame:
    """Rows that nobody has registered, and those granted to ``identity``. ``grants``: key, identity."""
    registered, own = grants.select(key).distinct(), grants.where(F.col("identity") == identity).select(key).distinct()
    flags = registered.join(own.withColumn("__own", F.lit(True)), key, "left").withColumn("__held", F.lit(True))
    return df.join(flags, key, "left").where("__held is null or __own").drop("__own", "__held")


def tagged(df: DataFrame, column: str, key: str) -> DataFrame:
    """``df`` with ``{column}_tag``, by which equal values are found without showing them."""
    return df.withColumn(f"{column}_tag", search.tag(F.col(column), column, key))


def encrypted_search(df: DataFrame, column: str, value, key: str) -> DataFrame:
    """The docIDs whose tag is that of ``value``, as one list."""
    return df.where(F.col(f"{column}_tag") == search.tag(F.lit(str(value)), column, key)).agg(F.array_sort(F.collect_list("_docID")).alias("docIDs"))


@dataclass(frozen=True)
class Lens:
    """A transform of rows from one version to the next, and its inverse, if it has one."""

    forward: Callable[[DataFrame], DataFrame]
    inverse: Callable[[DataFrame], DataFrame] | None = None


def migrated(df: DataFrame, lenses: list[Lens], start: int, end: int) -> DataFrame:
    """Rows of version ``start`` as of version ``end``, by the lenses between; version k becomes k + 1 by ``lenses[k]``."""
    steps = lenses[start:end] if start <= end else lenses[end:start][::-1]
    for lens in steps:
        step = lens.forward if start <= end else lens.inverse
        if step is None:
            raise ValueError("a lens on the way back has no inverse")
        df = step(df)
    return df


def by_rows(step: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A transform that is given as code over rows (dictionaries), which may drop rows and make more; it runs in Python, a batch at a time."""

    def run(df: DataFrame) -> DataFrame:
        def each(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pylist(list(step(iter(batch.to_pylist()))), schema=kind)

        kind = to_arrow_schema(T._parse_datatype_string(schema))
        return df.mapInArrow(each, schema)

    return run


class Schedule:
    """Refreshes views when they are due: ``tick`` looks after them, ``start`` ticks by itself until ``stop``."""

    def __init__(self, every: float = 0.25):
        self.every, self.views, self.halt = every, [], threading.Event()

    def add(self, refresh: Callable[[], None], seconds: float) -> None:
        self.views.append([refresh, seconds, time.monotonic() + seconds])

    def tick(self) -> int:
        done = 0
        for view in self.views:
            if time.monotonic() >= view[2]:
                view[0]()
                view[2], done = time.monotonic() + view[1], done + 1
        return done

    def start(self) -> threading.Thread:
        def run() -> None:
            while not self.halt.wait(self.every):
                self.tick()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def stop(self) -> None:
        self.halt.set()
