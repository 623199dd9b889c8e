"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

A document's ids fill whole windows first; what is left of it, cut into
pieces, joins the left-over pieces of the documents beside it. Multiway
differencing deals the pieces of such a block to windows: the two partial
partitions whose sums differ most within themselves are merged, largest sum on
smallest, until one is left, whose windows are nearly equal. If one of them is
over capacity, the number of windows rises and the block is dealt again.

A block is a run of documents within one input partition, so packing takes one
pass without a shuffle and a task holds one block; a lost executor's task packs
the same rows the same way again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

WINDOW = 4096
#: Windows' worth of left-over ids that are dealt together.
BLOCK_WINDOWS = 256
#: Left-over pieces are at most this long; smaller pieces make windows more equal.
GRAIN = 1024

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, n: int) -> np.ndarray:
    """Deal ``sizes`` to ``n`` bins of nearly equal sums; returns each one's bin.

    Each item starts as a partial partition with itself in one bin. Partial
    partitions share a pool of nodes, in which a bin of a merged one points to
    the two bins that it is made of.
    """
    m = len(sizes)
    if n <= 1 or m <= 1:
        return np.zeros(m, np.int64)
    left, right = [np.full(m + 1, -1)], [np.full(m + 1, -1)]  # node m: an empty bin
    total = m + 1
    heap = []
    for i in range(m):
        sums, nodes = np.zeros(n, np.int64), np.full(n, m)
        sums[-1], nodes[-1] = sizes[i], i
        heap.append((-int(sizes[i]), i, sums, nodes))
    heapq.heapify(heap)
    tick = m
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        x, y = x, y[::-1]
        both = (x != m) & (y != m)
        nodes = np.where(x == m, y, x)
        if k := int(both.sum()):
            left.append(x[both])
            right.append(y[both])
            nodes[both] = np.arange(total, total + k)
            total += k
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), tick, sums, nodes))
        tick += 1
    lefts, rights = np.concatenate(left), np.concatenate(right)
    bin_of = np.full(total, -1)
    top = heap[0][3]
    bin_of[top[top != m]] = np.flatnonzero(top != m)
    for i in range(total - 1, m, -1):  # a node is younger than those that it is made of
        if bin_of[i] >= 0:
            bin_of[lefts[i]] = bin_of[rights[i]] = bin_of[i]
    return bin_of[:m]


def deal(sizes: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Each item's window and the number of windows, none over ``window``."""
    total = int(sizes.sum())
    n = max(1, -(-total // window))
    while True:
        bins = differencing(sizes, n)
        most = int(np.bincount(bins, sizes, n).max()) if len(sizes) else 0
        if most <= window:
            return bins, n
        n += max(1, int(-(-(most - window) * n // window)) // 2)


def pack_block(lengths: list[int], window: int, grain: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) for the documents of one block."""
    number = 0
    items: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // window * window
        for start in range(0, whole, window):
            yield d, start, window, number, 0
            number += 1
        if rest := n - whole:
            parts = -(-rest // grain)
            cuts = [whole + rest * k // parts for k in range(parts + 1)]
            items += [(d, a, b - a) for a, b in zip(cuts, cuts[1:])]
    bins, n = deal(np.array([x[2] for x in items], np.int64), window)
    filled = [0] * n
    for (d, start, length), b in zip(items, bins.tolist()):
        yield d, start, length, number + b, filled[b]
        filled[b] += length


def _pack(batches: common.Batches, path: str, window: int, grain: int, block_windows: int) -> common.Batches:
    from pyspark import TaskContext

    encode, end = tokens.encoder(path).encode, tokens.END_ID.to_bytes(4, "little")
    sequence = TaskContext.get().partitionId() << 32
    docs: list[tuple[int | None, bytes]] = []
    waiting = 0

    def flush() -> pa.RecordBatch:
        nonlocal sequence
        rows, top = [], 0
        for d, start, length, number, offset in pack_block([len(ids) // 4 for _, ids in docs], window, grain):
            doc_id, ids = docs[d]
            rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence + number, offset))
            top = max(top, number + 1)
        sequence += top
        docs.clear()
        return common.batch_of(SCHEMA, list(zip(*rows)))

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist())):
                docs.append((doc_id, ids + end))
                waiting += (len(ids) // 4 + 1) % window
                if waiting >= block_windows * window or len(docs) >= 1 << 16:
                    yield flush()
                    waiting = 0
    if docs:
        yield flush()


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, grain: int = GRAIN, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in which window.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty
    text is one end id, a null doc_id stays null, a repeated row is packed
    again, an empty table gives no row. ``sequence_id`` is unique but not
    gapless; it holds the input partition's number in its upper half.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _pack(batches, tokenizer_path, window, grain, block_windows), DDL)


def op5_pack_differencing(spark, sf_dir: str) -> DataFrame:
    """All documents' pieces; nulls and repeats as in ``pack``."""
    return pack(common.table(spark, sf_dir, "documents"), tokens.public_path("word_bpe_49k.json"))
