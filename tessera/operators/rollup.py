"""Tumbling windows of a series, aligned to the epoch, and rollups of rollups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(duration: str | int | float) -> float:
    """``1h30m`` and the like; numbers are seconds."""
    if isinstance(duration, (int, float)):
        return float(duration)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)", duration)
    if "".join(a + b for a, b in parts) != duration or not parts:
        raise ValueError(f"no duration: {duration!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def _interval(duration) -> str:
    return f"{round(seconds(duration) * 1000)} milliseconds"


def tumbling(df: DataFrame, time: str, value: str, interval, series: list[str] = (), source: tuple[str, str] | None = None) -> DataFrame:
    """Each series' windows: window_start, window_end, count, sum, avg, min, max; null values count but add nothing.

    ``source``: the columns of a sample's document and height; the windows then
    have source_doc_id and source_height, those of the highest sample.
    """
    w = F.window(F.col(time), _interval(interval))
    aggs = [F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(value), F.lit(0)).alias("sum"), F.coalesce(F.avg(value), F.lit(0.0)).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")]
    more = []
    if source:
        aggs.append(F.max(F.struct(F.col(source[1]).alias("h"), F.col(source[0]).alias("d"))).alias("source"))
        more = [F.col("source.d").alias("source_doc_id"), F.col("source.h").alias("source_height")]
    return df.where(F.col(time).isNotNull()).groupBy(*series, w).agg(*aggs).select(*series, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "count", "sum", "avg", "min", "max", *more)


def chained(rolled: DataFrame, interval, series: list[str] = (), whole: bool = False) -> DataFrame:
    """Windows of windows; the mean follows from sums and counts. ``whole``: only those that the inner windows cover to their end."""
    w = F.window(F.col("window_start"), _interval(interval))
    aggs = [F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("window_end").alias("covered")]
    out = rolled.groupBy(*series, w).agg(*aggs)
    out = out.where(F.col("covered") >= F.col("window.end")) if whole else out
    mean = F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0)
    return out.select(*series, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "count", "sum", mean.alias("avg"), "min", "max")


#: Rollups of rollups of ... at most.
MOST_LEVELS = 8


def check_chains(rollups: dict[str, tuple[str, object]], most: int = MOST_LEVELS) -> list[str]:
    """Rollups (name: source, interval) in an order in which each comes after its source.

    A circle is an error, as are more than ``most`` levels and an interval that
    isn't a whole multiple of the source's.
    """
    out: list[str] = []
    for name in rollups:
        path, at = [], name
        while at in rollups:
            if at in path:
                raise ValueError(f"{' -> '.join([*path, at])} is a circle")
            path.append(at)
            source, interval = rollups[at]
            if source in rollups and seconds(interval) % seconds(rollups[source][1]):
                raise ValueError(f"{at}'s interval isn't a multiple of {source}'s")
            at = source
        if len(path) > most:
            raise ValueError(f"{name} is more than {most} levels deep")
        out += [p for p in path[::-1] if p not in out]
    return out


def strictly(samples: DataFrame, emitted: DataFrame, time: str, interval, series: list[str]) -> DataFrame:
    """``samples``; one that falls in a window that its series has emitted (or an older one) is an error when it is read.

    ``emitted``: series and window_end; only the latest of each counts.
    """
    last = emitted.groupBy(*series).agg(F.max("window_end").alias("__through")) if series else emitted.agg(F.max("window_end").alias("__through"))
    met = samples.join(last, list(series), "left") if series else samples.crossJoin(F.broadcast(last))  # one row
    late = F.col(time) < F.col("__through")
    return met.withColumn(time, F.when(F.coalesce(late, F.lit(False)), F.raise_error(F.lit("out-of-order timestamps")).cast("timestamp")).otherwise(F.col(time))).drop("__through")


def complete(rolled: DataFrame, through) -> DataFrame:
    """Windows that no later sample can change."""
    return rolled.where(F.col("window_end") <= F.lit(through).cast("timestamp"))


def retained(samples: DataFrame, time: str, window_end, retention, head: tuple[list[str], str] | None = None) -> DataFrame:
    """Samples that aren't older than ``retention`` before ``window_end``.

    ``head``: a document's columns and its height; the highest sample of each
    document stays however old it is.
    """
    young = F.col(time) >= F.lit(window_end).cast("timestamp") - F.expr(f"interval {_interval(retention)}")
    if head is None:
        return samples.where(young)
    top = samples.groupBy(*head[0]).agg(F.max(head[1]).alias("__top"))
    return samples.join(top, head[0]).where(young | (F.col(head[1]) == F.col("__top"))).select(*samples.columns)


def latest(rolled: DataFrame, series: list[str]) -> DataFrame:
    """Each series' last window."""
    rest = [c for c in rolled.columns if c not in series]
    return rolled.groupBy(*series).agg(F.max_by(F.struct(*rest), F.col("window_start")).alias("w")).select(*series, "w.*")
