"""Rollups and subscriptions over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import _interval, strictly, tumbling
from ..plans.catalog import Catalog
from ..plans.graphql import QueryError, parse
from ..plans.select import Planner


def stream_rollup(stream: DataFrame, time: str, value: str, interval, series: list[str], lateness="0s") -> DataFrame:
    """Windows as they get complete; in append mode each is given once, and rows later than ``lateness`` are dropped."""
    return tumbling(stream.withWatermark(time, _interval(lateness)), time, value, interval, series)


def strict_rollup(stream: DataFrame, time: str, value: str, interval, series: list[str], root: str) -> StreamingQuery:
    """Windows in order, below ``root``: a sample of a window that has been emitted stops the stream with an error.

    A window is emitted when a later one of its series has a sample. Samples of
    windows that are open wait in a table; a batch that is run again writes the
    same tables again.
    """
    spark, step = stream.sparkSession, _interval(interval)

    def read(kind: str, upto: int, schema) -> DataFrame:
        paths = [f"{root}/{kind}/{k}" for k in range(upto) if _there(spark, f"{root}/{kind}/{k}")]
        paths = paths[-1:] if kind == "open" else paths
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def each(batch: DataFrame, n: int) -> None:
        done = tumbling(batch.limit(0), time, value, interval, series)
        new = strictly(batch.where(F.col(time).isNotNull()), read("windows", n, done.schema), time, interval, series)
        held = read("open", n, batch.schema).union(new.select(*batch.columns))
        held = held.withColumn("__w", F.window(time, step).start)
        last = held.groupBy(*series).agg(F.max("__w").alias("__last")) if series else held.agg(F.max("__w").alias("__last"))
        held = held.join(last, series) if series else held.crossJoin(F.broadcast(last))
        held.where("__w = __last").select(*batch.columns).write.mode("overwrite").parquet(f"{root}/open/{n}")
        tumbling(held.where("__w < __last"), time, value, interval, series).write.mode("overwrite").parquet(f"{root}/windows/{n}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def _there(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def subscribe(changes: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``answer`` on the documents that each batch of changes has touched; empty answers are left out.

    ``every``: go on for ever, a batch in this interval; without it, what is
    there now.
    """

    def each(batch: DataFrame, _: int) -> None:
        out = answer(batch.select(key).where(F.col(key).isNotNull()).distinct())
        if not out.isEmpty():
            sink(out)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def subscription(catalog: Catalog, text: str, changes: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, variables: dict | None = None, key: str = "doc_id", every: str | None = None) -> StreamingQuery:
    """A subscription's query, of one root, answered for the documents of each batch of ``changes``; docID arguments confine it further."""
    op = parse(text, variables)[0]
    if op.kind != "subscription" or len(op.roots) != 1:
        raise QueryError("a subscription has one root")
    catalog[op.roots[0].name]

    def answer(ids: DataFrame) -> DataFrame:
        planner = Planner(catalog)
        planner.within = ids.select(F.col(key).cast("string").alias("_docID"))
        return planner.select(op.roots[0])

    return subscribe(changes, key, answer, sink, checkpoint, every)
