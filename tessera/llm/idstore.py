"""Content-addressed store of token ids.

A rolling hash over the ids of a document cuts them into chunks where its top
bits are zero, so equal passages give equal chunks wherever they stand. A chunk
is stored once under its SHA-256; a document's recipe lists its chunks. The
Merkle tree over them has four levels (chunk, document, recipe file, store):
read_digests checks every chunk against its address, every recipe against its
document's root, all recipes of a file against the manifest and the manifest
against the store's root.

Layout of a store, all Parquet: ``chunks`` (sorted by address, each stored
once; rows without an address are the documents as they were cut, of which the
recipes are made), ``recipes`` (a file for each range of doc_id, ascending in
and across files), ``manifest`` (a row for each recipe file) and ``store`` (one
row, the root).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Bounds and mean of a chunk's ids; the mean is a power of two. The rolling hash looks at WINDOW ids, fewer than LEAST.
LEAST, MEAN, MOST, WINDOW = 64, 256, 1024, 16
#: Addresses that a task remembers, so as to pass on equal chunks once.
KNOWN = 1 << 18

_GEAR = np.random.default_rng(10).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Behind which ids, of documents one after the other, the rolling hash allows a cut.

    The hash reads over the start of a document only where its first chunk is
    shorter than LEAST, and no cut is made there.
    """
    gear = _GEAR[ids & 0xFFFF]
    rolled = gear.copy()
    for k in range(1, WINDOW):
        rolled[k:] += gear[:-k] << np.uint32(k)
    return np.flatnonzero(rolled >> np.uint32(32 - MEAN.bit_length() + 1) == 0) + 1


def cuts(allowed: list[int], n: int) -> list[int]:
    """Where the chunks of a document of ``n`` ids end, given where the hash allows it."""
    out, last = [], 0
    for e in [*allowed, n]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or e == n and e > last:
            out.append(e)
            last = e
    return out


CHUNKS = pa.schema([("hash", pa.binary()), ("n_ids", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("row_id", pa.int64()), ("hashes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))])
CHUNKS_DDL = "hash binary, n_ids int, width int, ids binary, doc_id bigint, row_id bigint, hashes array<binary>, sizes array<int>"
RECIPES = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("hashes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("root", pa.binary()), ("part_root", pa.binary())])
RECIPES_DDL = "doc_id bigint, row_id bigint, part int, start_in_part bigint, n_tokens bigint, hashes array<binary>, sizes array<int>, root binary, part_root binary"


def _cut(batches: common.Batches, path: str) -> common.Batches:
    """Chunks that this task hasn't passed on yet, and each document's list of chunks."""
    from pyspark import TaskContext

    enc, end = tokens.encoder(path), tokens.END_ID.to_bytes(4, "little")
    width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
    row_id, known = TaskContext.get().partitionId() << 33, set()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            each = [raw + end for raw in enc.encode(part["text"].to_pylist())]
            at = np.cumsum([0, *(len(raw) // 4 for raw in each)])
            flat = np.frombuffer(b"".join(each), "<u4")
            allowed = boundaries(flat)
            lo, hi = np.searchsorted(allowed, at[:-1], "right").tolist(), np.searchsorted(allowed, at[1:], "left").tolist()
            small, base = flat.astype(f"<u{width}").tobytes(), at.tolist()
            chunks, docs = [], []
            for d, doc_id in enumerate(part["doc_id"].to_pylist()):
                start, hashes, sizes = base[d], [], []
                for stop in cuts((allowed[lo[d] : hi[d]] - start).tolist(), base[d + 1] - start):
                    stop += base[d]
                    data = small[start * width : stop * width]
                    name = hashlib.sha256(data).digest()
                    if name not in known:
                        known.add(name)
                        chunks.append((name, stop - start, width, data))
                    hashes.append(name)
                    sizes.append(stop - start)
                    start = stop
                docs.append((doc_id, row_id, hashes, sizes))
                row_id += 1
            n, m = len(chunks), len(docs)
            columns = [*([*c, *[None] * m] for c in (zip(*chunks) if n else [[]] * 4)), *([*[None] * n, *c] for c in zip(*docs))]
            yield common.batch_of(CHUNKS, columns)
            if len(known) > KNOWN:
                known.clear()


def _leaf(doc_id: int | None, row_id: int, n_tokens: int, root: bytes) -> bytes:
    """What a document adds to the root of its recipe file."""
    return f"{doc_id},{row_id},{n_tokens},".encode() + root


def _recipes(batches: common.Batches) -> common.Batches:
    """From documents in order: recipes, and at the end the part's root in a row without document."""
    from pyspark import TaskContext

    part, start, top, rows = TaskContext.get().partitionId(), 0, hashlib.sha256(), []
    for batch in batches:
        for doc_id, row_id, hashes, sizes in zip(*(batch[c].to_pylist() for c in ("doc_id", "row_id", "hashes", "sizes"))):
            root, n = hashlib.sha256(b"".join(hashes)).digest(), sum(sizes)
            top.update(_leaf(doc_id, row_id, n, root))
            rows.append((doc_id, row_id, part, start, n, hashes, sizes, root, None))
            start += n
            if len(rows) >= 4096:
                yield common.batch_of(RECIPES, list(zip(*rows)))
                rows.clear()
    if start:
        rows.append((None, None, part, None, start, [], [], None, top.digest()))
        yield common.batch_of(RECIPES, list(zip(*rows)))


def _store_root(parts: list) -> str:
    """The root over the recipe files' (part, n_tokens, part_root), in ascending order."""
    return hashlib.sha256(b"".join(f"{part},{n},".encode() + bytes(r) for part, n, r in parts)).hexdigest()


def _manifest(spark: SparkSession, root: str) -> list:
    return [tuple(r) for r in spark.read.parquet(f"{root}/manifest").select("part", "n_tokens", "part_root").orderBy("part").collect()]  # a row for each recipe file


def write_store(docs: DataFrame, root: str, tokenizer_path: str) -> str:
    """Encode every text of ``docs`` (doc_id, text), write the store below ``root`` and give its root hash.

    A null or empty text is one end id. Null doc_ids come first; rows of one
    doc_id keep their input order and each has a recipe. Other columns are
    ignored; an empty table gives a store without rows. Chunks are dealt by
    address and documents by number; a task passes a chunk on once, so one that
    a third of the documents hold is a row for each input task, without a list
    of its documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(lambda batches: _cut(batches, tokenizer_path), CHUNKS_DDL)
    once = cut.repartition("hash", "row_id").groupBy("hash", "row_id").agg(*[F.first(c).alias(c) for c in CHUNKS.names if c not in ("hash", "row_id")])
    once.select(*CHUNKS.names).write.option("parquet.enable.dictionary", "false").parquet(f"{root}/chunks")  # all values differ
    each = spark.read.schema(CHUNKS_DDL).parquet(f"{root}/chunks").where("hash is null").select("doc_id", "row_id", "hashes", "sizes")
    ordered = each.repartitionByRange(F.col("doc_id"), F.col("row_id")).sortWithinPartitions("doc_id", "row_id")
    ordered.mapInArrow(_recipes, RECIPES_DDL).write.parquet(f"{root}/recipes")
    made = spark.read.schema(RECIPES_DDL).parquet(f"{root}/recipes").where("part_root is not null")
    made.select("part", "n_tokens", "part_root").coalesce(1).write.parquet(f"{root}/manifest")
    store_root = _store_root(_manifest(spark, root))
    spark.range(0, 1, 1, 1).select(F.lit(store_root).alias("store_root")).write.parquet(f"{root}/store")
    return store_root


PARTS = pa.schema([("part", pa.int32()), ("n_tokens", pa.int64()), ("part_root", pa.binary())])


def _part_roots(batches: common.Batches) -> common.Batches:
    """From recipes sorted by part and start: each part's tokens and root."""
    part, n, top, rows = None, 0, hashlib.sha256(), []
    for batch in batches:
        for p, start, doc_id, row_id, n_tokens, root in zip(*(batch[c].to_pylist() for c in ("part", "start_in_part", "doc_id", "row_id", "n_tokens", "root"))):
            if p != part:
                if part is not None:
                    rows.append((part, n, top.digest()))
                part, n, top = p, 0, hashlib.sha256()
            if start != n:
                raise ValueError(f"recipes of part {p} don't follow each other; its root can't match")
            top.update(_leaf(doc_id, row_id, n_tokens, root))
            n += n_tokens
    if part is not None:
        rows.append((part, n, top.digest()))
        yield common.batch_of(PARTS, list(zip(*rows)))


def verified_parts(spark: SparkSession, root: str, store_root: str | None = None) -> list:
    """The manifest, once it matches all recipes and the store's root (and ``store_root``, where the caller kept it)."""
    parts = _manifest(spark, root)
    kept = [r.store_root for r in spark.read.parquet(f"{root}/store").collect()]
    if kept != [_store_root(parts)] or store_root not in (None, kept[0]):
        raise ValueError("the manifest doesn't match the store's root")
    recipes = spark.read.schema(RECIPES_DDL).parquet(f"{root}/recipes").where("part_root is null")
    total = F.expr("if(aggregate(sizes, 0L, (a, x) -> a + x) = n_tokens, n_tokens, raise_error('a recipe does not match its root: sizes'))").alias("n_tokens")
    ordered = recipes.select("part", "start_in_part", "doc_id", "row_id", total, "root").repartitionByRange("part").sortWithinPartitions("part", "start_in_part")
    found = sorted(tuple(r) for r in ordered.mapInArrow(_part_roots, "part int, n_tokens long, part_root binary").collect())  # a row for each recipe file
    if found != parts:
        raise ValueError("the recipes don't match the manifest's roots")
    return parts


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, reflected bits."""
    out, b = np.zeros_like(b), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ _POLY, b >> np.uint32(1))
    return out


def _squares() -> list[np.ndarray]:
    x = np.array([1 << 30], np.uint32)
    out = []
    for _ in range(64):
        out.append(x)
        x = _times(x, x)
    return out


_POWERS = _squares()


def shifted(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 contributes to that of a whole in which so many bytes follow."""
    out, n, k = crcs.astype(np.uint32), n_bytes.astype(np.int64), 3
    while (n > 0).any():
        on = np.flatnonzero(n & 1)
        if len(on):
            out[on] = _times(np.broadcast_to(_POWERS[k % 32], on.shape).astype(np.uint32), out[on])
        n, k = n >> 1, k + 1
    return out


def _digest(batches: common.Batches) -> common.Batches:
    schema = pa.schema([("hash", pa.binary()), ("crc", pa.int64()), ("stored", pa.int32())])
    for batch in batches:
        out = []
        for h, width, data in zip(*(batch[c].to_pylist() for c in ("hash", "width", "ids"))):
            if hashlib.sha256(data).digest() != h:
                raise ValueError(f"chunk {h.hex()} doesn't match its address")
            out.append((h, zlib.crc32(data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()), len(data) // width))
        yield common.batch_of(schema, list(zip(*out)) or [[]] * 3)


def _shift(batches: common.Batches) -> common.Batches:
    for batch in batches:
        crc = shifted(batch["crc"].to_numpy(), batch["behind"].to_numpy() * 4).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "row_id", "part", "start_in_part", "n_tokens")), pa.array(crc)], names=["doc_id", "row_id", "part", "start_in_part", "n_tokens", "crc"])


def read_digests(spark: SparkSession, root: str, store_root: str | None = None) -> DataFrame:
    """Each document of the store: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    Reads every stored chunk once, checks it against its address and joins only
    its CRC-32 to the recipes, in which those of a document's chunks add up to
    the document's. A chunk that is missing or of another size fails the read,
    as does a recipe that doesn't match its document's root, and recipes that
    don't match the manifest, or a manifest that doesn't match the store's root.
    """
    chunks = spark.read.schema(CHUNKS_DDL).parquet(f"{root}/chunks").where("hash is not null").select("hash", "width", "ids").mapInArrow(_digest, "hash binary, crc long, stored int")
    recipes = spark.read.schema(RECIPES_DDL).parquet(f"{root}/recipes").where("part_root is null")
    ends = "transform(sequence(1, size(sizes)), k -> aggregate(slice(sizes, 1, k), 0L, (a, x) -> a + x))"
    checked = recipes.withColumn("root", F.expr("if(sha2(array_join(transform(hashes, h -> hex(h)), ''), 256) is null or unhex(sha2(unhex(array_join(transform(hashes, h -> hex(h)), '')), 256)) <> root, raise_error('a recipe does not match its root'), root)"))
    places = checked.where("root is not null").select("doc_id", "row_id", "part", "start_in_part", "n_tokens", F.explode(F.arrays_zip(F.col("hashes"), F.col("sizes"), F.expr(ends).alias("stop"))).alias("x"))
    places = places.select("doc_id", "row_id", "part", "start_in_part", "n_tokens", F.col("x.hashes").alias("hash"), F.col("x.sizes").alias("n_ids"), (F.col("n_tokens") - F.col("x.stop")).alias("behind"))
    met = places.join(chunks, "hash", "left").withColumn("crc", F.expr("if(stored = n_ids, crc, raise_error('a chunk is missing'))"))
    shifts = met.select("doc_id", "row_id", "part", "start_in_part", "n_tokens", "crc", "behind").mapInArrow(_shift, "doc_id long, row_id long, part int, start_in_part long, n_tokens long, crc long")
    whole = shifts.groupBy("doc_id", "row_id", "part", "start_in_part", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))
    base, starts = 0, []
    for part, n_tokens, _ in verified_parts(spark, root, store_root):
        starts.append((part, base))
        base += n_tokens
    offsets = spark.createDataFrame(starts, "part int, base long")
    return whole.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def _joined(batches: common.Batches) -> common.Batches:
    schema = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    for batch in batches:
        rows = []
        for doc_id, row_id, parts in zip(*(batch[c].to_pylist() for c in ("doc_id", "row_id", "parts"))):
            rows.append((doc_id, row_id, np.concatenate([np.frombuffer(p["ids"], f"<u{p['width']}").astype(np.int32) for p in parts])))
        yield common.batch_of(schema, list(zip(*rows)) or [[]] * 3)


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """Each document's ids: doc_id, row_id, ids, from its recipe and the chunks."""
    chunks = spark.read.schema(CHUNKS_DDL).parquet(f"{root}/chunks").where("hash is not null").select("hash", "width", "ids")
    recipes = spark.read.schema(RECIPES_DDL).parquet(f"{root}/recipes").where("part_root is null")
    places = recipes.select("doc_id", "row_id", F.posexplode("hashes").alias("place", "hash"))
    parts = places.join(chunks, "hash").groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("place", "width", "ids"))).alias("parts"))
    return parts.mapInArrow(_joined, "doc_id long, row_id long, ids array<int>")


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as read back from the store; nulls and repeats as in ``write_store``."""
    root = common.shared_dir(spark)
    store_root = write_store(common.table(spark, sf_dir, "documents"), root, tokens.public_path("byte_bpe_50k.json"))
    return read_digests(spark, root, store_root)
