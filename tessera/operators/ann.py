"""Approximate vector search by inverted lists: vectors are dealt to the cells of centroids, and a search reads the nearest cells only.

Centroids are fitted on a bounded sample; every vector is indexed. With one
cell the index is flat, and exact. With product quantization a vector's parts
are kept as the numbers of their nearest codewords, beside it: a search first
ranks by tables of distances to codewords, a byte a part, and compares only the
best of them exactly. Graph indexes have no counterpart here: walking a graph
is a chain of dependent reads, which a cluster answers no faster than one disk;
``ENGINES`` gives lists of a similar recall in their place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import similarity

#: Vectors that centroids are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS, SEED = 20_000, 10, 5
PROBES = 8


#: Engines by name: cells, probes and, where vectors are quantized, their parts.
ENGINES = {"flat": (1, 1, 0), "ivf_flat": (64, 8, 0), "ivf_pq": (64, 8, 8), "hnsw": (64, 16, 0), "ssg": (64, 16, 0)}
#: Codewords of a part, and how many times k are compared exactly after ranking by codes.
CODEWORDS, AGAIN = 256, 20


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of ``cells`` groups of the sample by Lloyd's rounds; a group that runs empty starts anew."""
    rng = np.random.default_rng(SEED)
    centers = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(sample, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centers))
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[rng.integers(0, len(sample), len(centers))])
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    d = (centers * centers).sum(1)[None, :] - 2 * x @ centers.T
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def build(df: DataFrame, key: str, vector: str, path: str, cells: int = 64, metric: str = "cosine", sample: int = SAMPLE, parts: int = 0) -> None:
    """An index below ``path``: (key, vector, code) in a folder for each cell, centroids and codewords. Null vectors, and those of other dimensions than the first, are left out.

    ``parts``: of so many parts of a vector the nearest codewords are kept, too.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    first = rows.orderBy("key").limit(1).collect()
    dim = len(first[0]["vector"]) if first else 0
    if parts and dim % parts:
        raise ValueError(f"{dim} dimensions can't be cut in {parts} equal parts")
    rows = rows.where(F.size("vector") == dim)
    some = np.array([r[0] for r in rows.orderBy(F.xxhash64("key", F.lit(SEED))).limit(sample).select("vector").collect()], np.float64).reshape(-1, dim)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric.lower() == "cosine" else x
    centers = centroids(unit(some), cells) if len(some) else np.zeros((1, max(dim, 1)))
    books = [centroids(p, CODEWORDS) for p in np.split(unit(some), parts, axis=1)] if parts and len(some) else []

    def placed(batches):
        for batch in batches:
            x = unit(np.array(batch["vector"].to_pylist(), np.float64).reshape(-1, dim))
            cell = nearest(x, centers, 1)[:, 0].astype(np.int32) if len(x) else np.zeros(0, np.int32)
            codes = np.stack([nearest(p, book, 1)[:, 0] for p, book in zip(np.split(x, parts, axis=1), books)], 1).astype(np.uint8) if books and len(x) else np.zeros((len(x), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell)], names=[*batch.schema.names, "code", "cell"])

    out = rows.mapInArrow(placed, f"key {rows.schema['key'].dataType.simpleString()}, vector array<double>, code binary, cell int")
    # a cell may hold a third of all rows: it is spread over tasks by key
    out.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    table = df.sparkSession.createDataFrame([(i, c.tolist(), metric) for i, c in enumerate(centers)], "cell int, center array<double>, metric string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    words = [(i, book.ravel().tolist()) for i, book in enumerate(books)]
    df.sparkSession.createDataFrame(words, "part int, words array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/codewords")


def search(spark: SparkSession, path: str, vector: list[float], k: int, probes: int = PROBES) -> DataFrame:
    """The ``k`` best (key, score) of the ``probes`` nearest cells; all cells make it exact."""
    table = sorted(spark.read.parquet(f"{path}/centroids").collect())  # a row a cell
    centers, metric = np.array([r["center"] for r in table]), table[0]["metric"]
    q = np.array([vector], np.float64)
    q = q / max(np.linalg.norm(q), 1e-300) if metric.lower() == "cosine" else q
    cells = nearest(q, centers, probes)[0].tolist()
    rows = spark.read.parquet(f"{path}/cells").where(F.col("cell").isin(cells))
    books = sorted(spark.read.parquet(f"{path}/codewords").collect())  # a row a part
    if books:
        euclidean = metric.lower() in ("euclidean", "l2")
        tables = []
        for part, b in zip(np.split(q[0], len(books)), books):
            words = np.array(b["words"]).reshape(-1, len(part))
            tables.append(-((words - part) ** 2).sum(1) if euclidean else words @ part)
        table = np.stack(tables)

        def ranked(batches):
            for batch in batches:
                codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, len(books))
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(table[np.arange(len(books)), codes].sum(1))], names=["key", "near"])

        near = rows.select("key", "code").mapInArrow(ranked, f"key {rows.schema['key'].dataType.simpleString()}, near double")
        rows = rows.join(F.broadcast(near.orderBy(F.desc("near"), "key").limit(AGAIN * k).select("key")), "key")  # AGAIN * k rows
    scored = rows.select("key", similarity(F.col("vector"), vector, metric).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(k)
