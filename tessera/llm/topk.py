"""Exact top-k by inner product: a KD-tree for each shard, searched best first.

Shards are the leaves of a KD-tree, too: its median splits are fitted on a
bounded sample and every vector is dealt by them, so a shard's box is tight; a
leaf with more vectors than a shard holds is several shards. Within a shard
vectors are split at the median of the widest dimension, down to leaves, and
each node keeps its tight bounding box. What a query could score within a box
bounds the search: nodes are opened by falling bound until it is below the kth
best score so far. A query searches its own shard first; the kth score found
there decides, by the shards' boxes, which others it is sent to, and travels
with it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .vectors import usable

SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 128, 1024
#: Vectors that the shards' splits are fitted on at most, and boxes that meet a block of queries at once.
SAMPLE, BOXES = 65_536, 1024
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Tree:
    """Nodes in arrays: bounds of boxes, the rows of leaves, the children of others."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.lo, self.hi, self.kids, self.rows = [], [], [], []
        self.ids, self.x = ids, x
        self._add(np.arange(len(ids)), leaf)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _add(self, rows: np.ndarray, leaf: int) -> int:
        x = self.x[rows]
        lo, hi = x.min(0), x.max(0)
        me = len(self.kids)
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append(None)
        self.rows.append(None)
        if len(rows) <= leaf or (lo == hi).all():
            rows = rows[np.argsort(self.ids[rows], kind="stable")]
            self.rows[me] = (self.ids[rows], self.x[rows])
        else:
            order = np.argpartition(x[:, int(np.argmax(hi - lo))], len(rows) // 2)
            self.kids[me] = (self._add(rows[order[: len(rows) // 2]], leaf), self._add(rows[order[len(rows) // 2 :]], leaf))
        return me

    def search(self, q: np.ndarray, own: int, k: int, kth: float, bounds: np.ndarray) -> list[tuple[float, int]]:
        """Up to k (score, -id), of those that may be among the best k if the kth best elsewhere is ``kth``."""
        best: list[tuple[float, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bounds[kid] >= kth:
                        heapq.heappush(heap, (-bounds[kid], kid))
                continue
            ids, x = self.rows[node]
            score = x @ q
            near = np.flatnonzero((score >= kth) & (ids != own))
            if len(near) > k:  # rows are by id, so a stable order keeps ties by id
                near = near[np.argsort(-score[near], kind="stable")[:k]]
            for i in near.tolist():
                item = (score[i], -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best


def splits(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Median splits of the widest dimension (dimension, value, child below, child above), a leaf k as -1 - k."""
    out: list = []

    def add(x: np.ndarray, first: int, n: int) -> int:
        if n == 1 or len(x) < 2 or (x.min(0) == x.max(0)).all():
            return -1 - first
        d = int(np.argmax(x.max(0) - x.min(0)))
        v = float(np.quantile(x[:, d], (n // 2) / n, method="higher"))
        v = v if v > x[:, d].min() else float(x[x[:, d] > v, d].min())  # something lies below
        me, low = len(out), x[:, d] < v
        out.append(None)
        out[me] = (d, v, add(x[low], first, n // 2), add(x[~low], first + n // 2, n - n // 2))
        return me

    add(sample, 0, leaves)
    return out


def leaf_of(x: np.ndarray, nodes: list) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    while (on := np.flatnonzero(at >= 0)).size:
        d, v, low, high = (np.array(c) for c in zip(*[nodes[k] for k in at[on]]))
        at[on] = np.where(x[on, d] < v, low, high)
    return -1 - at


def _matrix(vecs: list) -> np.ndarray:
    return np.floor(256.0 * np.array(vecs, np.float64))


def _numbers(raw: bytes, ids: np.ndarray) -> np.ndarray:
    x = np.frombuffer(raw, np.float64).reshape(len(ids), -1)
    return x if not x.size or np.abs(x).max() ** 2 * x.shape[1] < 2**51 else np.array([[int(v) for v in r] for r in x.tolist()], object)


def _search(batches: common.Batches, k: int) -> common.Batches:
    last, tree = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            shard, x_ids, x, q_ids, q, kths = (batch[c][row].as_py() for c in ("shard", "x_ids", "x", "q_ids", "q", "kths"))
            ids = np.frombuffer(x_ids, np.int64)
            if last != shard:
                last, tree = shard, Tree(ids, _numbers(x, ids))
            qi, kth = np.frombuffer(q_ids, np.int64), np.frombuffer(kths, np.float64)
            qs = _numbers(q, qi)
            if qs.dtype == object or tree.x.dtype == object:
                bounds = np.maximum(qs[:, None, :].astype(object) * tree.lo, qs[:, None, :].astype(object) * tree.hi).sum(-1)
            else:
                bounds = np.maximum(qs, 0) @ tree.hi.T + np.minimum(qs, 0) @ tree.lo.T
            out = [(int(i), -b, int(s)) for i, v, t, bound in zip(qi, qs, kth, bounds) for s, b in tree.search(v, int(i), k, t, bound)]
            yield common.batch_of(FOUND, list(zip(*out)) or [[]] * 3)


def _blocks(df: DataFrame, key: str, prefix: str, extra: bool = False) -> DataFrame:
    """A row for each ``key``: ids and integer vectors, as bytes; with ``extra`` also their ``kth``."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = _matrix(pdf["vec"].tolist())
        row = {key: [pdf[key].iloc[0]], "dim": [x.shape[1]], f"{prefix}_ids": [pdf["id"].to_numpy(np.int64).tobytes()], prefix: [x.tobytes()]}
        return pd.DataFrame(row | ({"kths": [pdf["kth"].to_numpy(np.float64).tobytes()]} if extra else {"lo": [x.min(0).tobytes()], "hi": [x.max(0).tobytes()]}))

    return df.groupBy(key, F.size("vec")).applyInPandas(pack, f"{key} long, dim int, {prefix}_ids binary, {prefix} binary" + (", kths binary" if extra else ", lo binary, hi binary"))


def _worth(batches: common.Batches) -> common.Batches:
    """From blocks of queries and boxes: which queries may find one of their best in which shard."""
    schema = pa.schema([("id", pa.int64()), ("shard", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            r = {c: batch[c][row].as_py() for c in batch.schema.names}
            ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q"], np.float64).reshape(-1, r["dim"])
            lo, hi = (np.array([np.frombuffer(b[c], np.float64) for b in r["boxes"]]) for c in ("lo", "hi"))
            bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
            slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T)  # sums of large numbers are rounded
            i, j = np.nonzero(bound + slack >= np.frombuffer(r["kths"], np.float64)[:, None])
            yield common.batch_of(schema, [ids[i], np.array([b["shard"] for b in r["boxes"]], np.int64)[j]])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k highest inner products of floor(256 x) for each vector whose id is divisible by ``every``: query_id, rank, vec_id, score.

    All vectors but the query's own id are candidates; ties go to the smaller
    id. Rows without id, and vectors that are null, empty or hold null or
    non-finite components, take no part; a vector meets only those of its
    length; repeated rows count once. Other columns are ignored; an empty table
    gives no row. Queries meet the shards in blocks.
    """
    root = common.shared_dir(vectors.sparkSession)
    rows = common.materialize(usable(vectors, id_col, vec_col), root, "rows")
    n = rows.count()
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = dims["dim"] if dims else 0
    some = rows.where(F.size("vec") == dim).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE).select("vec").collect()
    nodes = splits(_matrix([r[0] for r in some]), max(1, math.ceil(n / shard_rows))) if some else []

    def dealt(batches: common.Batches) -> common.Batches:
        for batch in batches:
            same = [len(v) == dim for v in batch["vec"].to_pylist()]
            leaf = np.full(batch.num_rows, -1)  # vectors of other lengths have a leaf of their own
            if any(same):
                leaf[same] = leaf_of(_matrix(batch.filter(pa.array(same))["vec"].to_pylist()), nodes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    rows = common.materialize(rows.mapInArrow(dealt, "id long, vec array<double>, leaf long"), root, "dealt")
    first_of, shards = {}, 0
    for r in rows.groupBy("leaf").count().orderBy("leaf").collect():  # a row a leaf
        first_of[r["leaf"]] = (shards, math.ceil(r["count"] / shard_rows))
        shards += first_of[r["leaf"]][1]
    starts = rows.sparkSession.createDataFrame([(k, *v) for k, v in first_of.items()], "leaf long, start long, parts long")
    homed = rows.join(F.broadcast(starts), "leaf").select("id", "vec", (F.col("start") + F.pmod(F.xxhash64("id"), "parts")).alias("home"))
    packed = common.materialize(_blocks(homed.withColumnRenamed("home", "shard"), "shard", "x"), root, "shards")
    asked = homed.where(F.pmod("id", F.lit(every)) == 0)
    parts = max(1, math.ceil(n / every / query_rows))

    def searched(queries: DataFrame) -> DataFrame:
        """``queries`` (id, vec, shard, kth) against their shard."""
        blocks = _blocks(queries.withColumn("block", F.col("shard") * parts + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))), "block", "q", extra=True)
        met = blocks.withColumn("shard", F.expr(f"block div {parts}")).join(packed, ["shard", "dim"])
        wide = met.repartition(max(1, min(1000, shards * parts)), "shard", "block").sortWithinPartitions("shard", "dim")
        return wide.select(F.struct("shard", "dim").cast("string").alias("shard"), "x_ids", "x", "q_ids", "q", "kths").mapInArrow(lambda b: _search(b, k), "query_id long, vec_id long, score long")

    first = common.materialize(searched(asked.withColumnRenamed("home", "shard").withColumn("kth", F.lit(float("-inf")))), root, "first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(f"n >= {k}").select(F.col("query_id").alias("id"), F.col("worst").cast("double").alias("kth"))
    rest = asked.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    rest = common.materialize(rest, root, "rest")
    boxes = packed.select("dim", "shard", "lo", "hi").groupBy("dim", F.expr(f"shard div {BOXES}").alias("chunk")).agg(F.collect_list(F.struct("shard", "lo", "hi")).alias("boxes"))
    # queries in blocks against all boxes in blocks; what passes is a pair of numbers
    blocks = _blocks(rest.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))), "block", "q", extra=True)
    worth = blocks.join(boxes, "dim").select("dim", "q_ids", "q", "kths", "boxes").repartition(max(1, min(1000, parts * math.ceil(max(1, shards) / BOXES)))).mapInArrow(_worth, "id long, shard long")
    sent = rest.join(worth, "id").where("shard <> home").select("id", "vec", "shard", "kth")
    found = first.union(searched(sent)) if shards > 1 else first
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of each query; rows that take no part as in ``top_k``."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
