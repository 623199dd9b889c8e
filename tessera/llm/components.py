"""Connected components of a graph that is a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that one task joins up by itself (32 MB of them); more are joined by rounds of all tasks.
LOCAL_LINKS = 2_000_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each of n nodes' smallest connected node."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _joined(batches: common.Batches, roots: bool) -> common.Batches:
    """A partition's links as those of each node to the smallest one; with ``roots`` also of that one to itself."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    nodes, to = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u, v = np.concatenate([nodes, batch["u"].to_numpy()]), np.concatenate([to, batch["v"].to_numpy()])
        names, places = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = forest(len(names), places[: len(u)], places[len(u) :])
        nodes, to = names, names[label]
    keep = nodes >= to if roots else nodes > to
    yield common.batch_of(schema, [nodes[keep], to[keep]])


def _count(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, root: str, name: str, local_links: int = LOCAL_LINKS) -> DataFrame:
    """Of ``links`` (a, b), each node with the smallest node that it is connected to: node, component.

    Each partition first reduces its links to a forest. What is left of all of
    them goes to one task if it is no more than ``local_links``; otherwise
    alternating large-star and small-star steps join it, which need about as
    many rounds as the logarithm of the longest path and never gather a node's
    neighbours in a list. Links stay in tables below ``root``.
    """
    spark = links.sparkSession
    edges = links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) u", "least(a, b) v")
    edges = common.materialize(edges.mapInArrow(lambda x: _joined(x, False), "u long, v long"), root, f"{name}-0")
    before = _count(edges)
    if before[0] <= local_links:
        whole = edges.coalesce(1).mapInArrow(lambda x: _joined(x, True), "u long, v long")
        return common.materialize(whole.selectExpr("u node", "v component"), root, name)
    k = 0
    while True:
        # large star: larger neighbours go to the smallest of the node and its neighbours; small star: the rest do
        both = edges.union(edges.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").selectExpr("if(v = m, u, v) u", "m v").where("u <> v").distinct()
        k += 1
        edges = common.materialize(small, root, f"{name}-{k}")
        common.discard(spark, root, f"{name}-{k - 1}")
        if before == (now := _count(edges)):
            break
        before = now
    return edges.selectExpr("u node", "v component").union(edges.selectExpr("v node", "v component").distinct())
