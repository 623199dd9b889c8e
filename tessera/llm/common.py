"""Helpers that the operators of this subpackage share: storage that survives lost executors, and Arrow access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that Spark hands to Python at once; a longer row goes alone.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bound the batches of the session by bytes, unless it has a smaller bound: 10,000 documents can be any size."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is unset (tests, a single machine), a temporary folder
    takes its place.
    """
    bounded(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex[:16]}"


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/tessera-checkpoints"


def materialize(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write ``df`` below ``root`` and read it back: a cut in the lineage that no lost executor undoes."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, root: str, *names: str) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_column(df: DataFrame, name: str, kind: str) -> F.Column:
    """``df``'s column, or nulls of ``kind`` where it has none."""
    return df[name] if name in df.columns else F.lit(None).cast(kind)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's start in them (one more at the end); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_binary())
    _, starts, data = wide.buffers()
    at = np.frombuffer(starts, np.int64, len(wide) + 1, wide.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: How to drop what operators keep in a Python worker from task to task; whose that is just now.
KEPT: list[Callable[[], None]] = []
_USER: list[str] = []


def used_by(operator: str) -> None:
    """Workers outlive their tasks and serve any operator: when another one comes, what the one before it has kept goes."""
    if _USER != [operator]:
        _USER[:] = [operator]
        for drop in KEPT:
            drop()
        trim()


def trim() -> None:
    """Give freed memory back to the system, which the C library would keep for this process."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


Batches = Iterator[pa.RecordBatch]
Step = Callable[[Batches], Batches]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
