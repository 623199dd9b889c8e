"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors first meet as the sides that they take of 256 fixed random directions,
32 bytes each: two collide on a direction if they lie on the same side, and a
pair that collides often enough is a candidate. All classes are dealt to at most
GROUPS blocks, and a task gets the sides of two blocks, so what is shipped grows
with the number of vectors only, while the work is that of all pairs, at some
two nanoseconds each.

Vectors themselves are shipped only where candidates connect them. Within such a
group they are compared by counting collisions of one-dimensional projections:
two collide if one lies in the window centred at the other; the window is a
multiple of the spread that projections of a pair at the similarity bound have.
A pair is verified by its cosine if it collides often enough. Both needed counts
are the largest that a pair at the bound reaches with the wanted recall.

A block of a group is sorted by its first projection; runs of equal length are
tiles with bounding boxes on every projection. Two tiles meet only if their
boxes allow enough collisions and no projection keeps them further apart than
any pair at the bound can be; within two tiles the windows of a strip of query
vectors are counted at once, in bytes.

Equal vectors are one representative with a weight. A pair of blocks yields a
spanning forest of candidates, or counts of links and a spanning forest, never
the pairs themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, forest
from .vectors import finite

COSINE, PROJECTIONS, RECALL, SPREAD = 0.9, 32, 0.9999, 2.5
TILE_ROWS = 4096
#: Directions whose sides are compared; those of the first word alone exclude most pairs.
SIDES, _WORD = 256, 64
#: Blocks that are dealt at most, of all vectors and of a group: a row is shipped so often, and a block grows beyond TILE_ROWS.
GROUPS = 8
#: Candidates that are held before they are reduced to a forest.
_HELD = 1 << 20
#: Query vectors whose windows are counted together: their counts fit in a core's cache.
_STRIP = 64
#: Steps of a rounded projection in a window; all projections lie within a byte.
_STEPS = 12


def needed(projections: int = PROJECTIONS, spread: float = SPREAD, recall: float = RECALL) -> int:
    """How many windows of ``spread`` deviations a pair at the bound hits with probability ``recall``."""
    return hits(projections, math.erf(spread / math.sqrt(2)), recall)


def hits(projections: int, p: float, recall: float) -> int:
    """How many of so many collisions, of a chance of p each, happen with probability ``recall``."""
    above = 0.0
    for n in range(projections, -1, -1):
        above += math.comb(projections, n) * p**n * (1 - p) ** (projections - n)
        if above >= recall:
            return n
    return 0


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    d = np.random.default_rng([8, dim]).standard_normal((dim, projections))
    return d / np.linalg.norm(d, axis=0)


def _unit(v: np.ndarray) -> np.ndarray | None:
    top = np.abs(v).max()
    if top == 0:
        return None
    unit = v / top + 0.0
    return unit / np.linalg.norm(unit)


def _keyed(batches: common.Batches) -> common.Batches:
    schema = pa.schema([("id", pa.int64()), ("vh", pa.int64()), ("dim", pa.int32()), ("key", pa.binary()), ("sides", pa.binary())])
    for batch in batches:
        by_dim: dict[int, list] = {}
        for i, h, v in zip(batch["id"].to_pylist(), batch["vh"].to_pylist(), batch["vec"]):
            if (unit := _unit(v.values.to_numpy(zero_copy_only=False).astype(np.float64))) is not None:
                by_dim.setdefault(len(unit), []).append((i, h, unit))
        for dim, rows in by_dim.items():
            ids, hashes, units = zip(*rows)
            sides = np.packbits(np.stack(units) @ sides_of(dim) > 0, axis=1)
            yield common.batch_of(schema, [ids, hashes, [dim] * len(ids), [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units], [x.tobytes() for x in sides]])


_KNOWN: dict[int, np.ndarray] = {}


def directions_of(dim: int) -> np.ndarray:
    if dim not in _KNOWN:
        _KNOWN[dim] = directions(dim)
    return _KNOWN[dim]


_ACROSS: dict[int, np.ndarray] = {}


def sides_of(dim: int) -> np.ndarray:
    if dim not in _ACROSS:
        _ACROSS[dim] = np.random.default_rng([8, dim, SIDES]).standard_normal((dim, SIDES))
    return _ACROSS[dim]


def apart_at_most(cosine: float, recall: float) -> tuple[int, int]:
    """On how many of the first word's directions and of all a pair may lie on different sides and be a candidate; either loses at most half of 1 - ``recall``."""
    p = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return tuple(n - hits(n, p, 1 - (1 - recall) / 2) for n in (_WORD, SIDES))


def candidates(a: np.ndarray, b: np.ndarray, most: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the sides ``a`` and ``b`` (a row of words each) that differ in few enough directions, part by part."""
    strip, wide = 16, 4096
    first = np.ascontiguousarray(b[:, 0])
    for t in range(0, len(b), wide):
        other = first[None, t : t + wide]
        differ = np.empty((strip, other.shape[1]), np.uint64)
        count, near = np.empty(differ.shape, np.uint8), np.empty(differ.shape, bool)
        for s in range(0, len(a), strip):
            mine = a[s : s + strip, :1]
            k = len(mine)
            np.bitwise_xor(mine, other, out=differ[:k])
            np.bitwise_count(differ[:k], out=count[:k])
            np.less_equal(count[:k], most[0], out=near[:k])
            i, j = np.divmod(np.flatnonzero(near[:k].ravel()), other.shape[1])
            if len(i):
                ok = np.bitwise_count(a[s + i] ^ b[t + j]).sum(1, dtype=np.int64) <= most[1]
                if ok.any():
                    yield s + i[ok], t + j[ok]


DEALT = pa.schema([("dim", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("own", pa.int32()), ("ids", pa.binary()), ("sides", pa.binary())])


def _dealt(batches: common.Batches) -> common.Batches:
    """A batch's rows by block, once for each pair of blocks that theirs belongs to."""
    for batch in batches:
        dims, blocks, own = (batch[c].to_numpy() for c in ("dim", "blocks", "block"))
        ids, sides = batch["rep"].to_numpy(), np.frombuffer(b"".join(batch["sides"].to_pylist()), np.uint8).reshape(-1, SIDES // 8)
        rows = []
        for dim, n, block in sorted(set(zip(dims.tolist(), blocks.tolist(), own.tolist()))):
            at = (dims == dim) & (own == block)
            packed = ids[at].tobytes(), sides[at].tobytes()
            rows += [(dim, min(block, k), max(block, k), block, *packed) for k in range(n)]
        yield common.batch_of(DEALT, list(zip(*rows)) or [[]] * 6)


def _groups(batches: common.Batches, keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, those of one key at a time."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch[k].to_numpy().astype(np.int64) for k in keys])
        edges = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            if (here := tuple(cols[:, i])) != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = here
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _near(batches: common.Batches, most: tuple[int, int]) -> common.Batches:
    """From rows of ``_dealt`` sorted by pair of blocks: a spanning forest of each pair's candidates."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for rows in _groups(batches, ["dim", "lo", "hi"]):
        lo, hi, own = rows["lo"][0].as_py(), rows["hi"][0].as_py(), rows["own"].to_numpy()
        side = {}
        for block in {lo, hi}:
            part = rows.filter(pa.array(own == block))
            side[block] = np.frombuffer(b"".join(part["ids"].to_pylist()), np.int64), np.frombuffer(b"".join(part["sides"].to_pylist()), np.uint64).reshape(-1, SIDES // 64)
        if len(side) == 2:
            ids, base = np.concatenate([side[lo][0], side[hi][0]]), len(side[lo][0])
        elif lo != hi:
            continue
        else:
            ids, base = side[lo][0], 0
        label, x, y, held = np.arange(len(ids)), [], [], 0
        for i, j in candidates(side[lo][1], side[hi][1], most):
            x.append(i)
            y.append(j + base)
            held += len(i)
            if held > _HELD:
                label = forest(len(ids), np.concatenate([np.arange(len(ids)), *x]), np.concatenate([label, *y]))
                x, y, held = [], [], 0
        label = forest(len(ids), np.concatenate([np.arange(len(ids)), *x]), np.concatenate([label, *y]))
        on = ids != ids[label]
        yield common.batch_of(schema, [ids[on], ids[label][on]])


FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def links_between(a: np.ndarray, b: np.ndarray, cosine: float, projections: np.ndarray, spread: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` that collide often enough and whose cosine reaches the bound."""
    both = a @ projections, b @ projections
    reach = 2 * max(np.abs(x).max(initial=0) for x in both)
    # projections are rounded to steps of a window and kept as bytes, which wrap beyond any gap that occurs
    window = max(spread * math.sqrt(2 * (1 - cosine) / a.shape[1]), reach * _STEPS / (250 - 2 * _STEPS))
    pa_, pb = (np.floor(x / (window / _STEPS)).astype(np.int64).astype(np.uint8).T.copy() for x in both)
    out_i, out_j = [], []
    for s in range(0, len(a), _STRIP):
        part = pa_[:, s : s + _STRIP]
        count = np.zeros((part.shape[1], len(b)), np.uint8)
        gap = np.empty_like(count)
        hit = np.empty(count.shape, bool)
        for mine, theirs in zip(part, pb):
            np.subtract((mine + np.uint8(_STEPS + 1))[:, None], theirs[None, :], out=gap)
            np.less_equal(gap, np.uint8(2 * _STEPS + 2), out=hit)
            np.add(count, hit.view(np.uint8), out=count)
        flat = np.flatnonzero(count.ravel() >= least)
        for k in range(0, len(flat), 1 << 16):
            x, y = np.divmod(flat[k : k + (1 << 16)], len(b))
            ok = np.einsum("nd,nd->n", a[s + x], b[y]) >= cosine
            out_i.append(s + x[ok])
            out_j.append(y[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _tiles(units: np.ndarray, rows: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of so many rows in the order of the first projection, and their boxes."""
    p = units @ directions_of(units.shape[1])
    order = np.argsort(p[:, 0], kind="stable")
    return [(at, p[at].min(0), p[at].max(0)) for at in (order[k : k + rows] for k in range(0, len(order), rows))]


def _meet(batches: common.Batches, cosine: float, spread: float, least: int, tile_rows: int) -> common.Batches:
    """From rows sorted by group and pair of blocks: counts of links and a spanning forest of them."""
    apart = math.sqrt(2 * (1 - cosine)) + 1e-6
    for rows in _groups(batches, ["component", "dim", "lo", "hi"]):
        dim, lo, hi = (rows[c][0].as_py() for c in ("dim", "lo", "hi"))
        ids, hashes, own = (rows[c].to_numpy() for c in ("id", "vh", "own"))
        once = np.sort(np.unique(np.stack([ids, hashes], axis=1), axis=0, return_index=True)[1])  # repeated rows
        ids, own, weights = ids[once], own[once], rows["weight"].to_numpy()[once]
        units = np.stack([_unit(v.values.to_numpy(zero_copy_only=False).astype(np.float64)) for v in rows["vec"].take(pa.array(once))])
        same, window = lo == hi, spread * math.sqrt(2 * (1 - cosine) / dim) * (1 + 2 / _STEPS)
        places = [np.flatnonzero(own == k) for k in (lo, hi)]
        sides = [[(at[t], low, high) for t, low, high in _tiles(units[at], tile_rows)] for at in places]
        counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for k, (a, a_low, a_high) in enumerate(sides[0]):
            for b, b_low, b_high in sides[1][k:] if same else sides[1]:
                gaps = np.maximum(a_low - b_high, b_low - a_high)
                if (gaps <= window).sum() < least or (gaps > apart).any():
                    continue
                i, j = links_between(units[a], units[b], cosine, directions_of(dim), spread, least)
                i, j = a[i], b[j]
                if one := len(a) == len(b) and a[0] == b[0]:
                    i, j = i[i != j], j[i != j]  # both ways round
                counts += np.bincount(i, weights[j], len(ids)).astype(np.int64)
                if not one:
                    counts += np.bincount(j, weights[i], len(ids)).astype(np.int64)
                label = forest(len(ids), np.concatenate([np.arange(len(ids)), i]), np.concatenate([label, j]))
        on = counts > 0
        yield common.batch_of(FOUND, [ids[on], counts[on], ids[label][on]])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int = TILE_ROWS, spread: float = SPREAD, recall: float = RECALL) -> DataFrame:
    """Each row's id with n_links (other vectors of a cosine of at least ``cosine``), component_id and kept.

    Columns: ``id_col``, n_links, component_id, kept. Links are exact as far as
    they are found; each is missed with a probability below 1 - ``recall`` (a
    pair at the bound itself; nearer pairs less often). Vectors that are null,
    zero, or hold null or non-finite components have no link and are their own
    component, as are rows without id (component_id null, kept false). Repeated
    rows count as one vector and each gets its result. A vector meets only
    those of its length. Other columns are ignored.
    """
    spark = vectors.sparkSession
    root = common.shared_dir(spark)
    # either way of counting loses at most half of what may be lost
    half = 1 - (1 - recall) / 2
    least, most = needed(PROJECTIONS, spread, half), apart_at_most(cosine, half)
    rows = finite(vectors, id_col, vec_col).withColumn("vh", F.xxhash64("vec"))
    keyed = rows.mapInArrow(_keyed, "id long, vh long, dim int, key binary, sides binary").dropDuplicates(["id", "vh", "key", "dim"])
    keyed = common.materialize(keyed, root, "keyed")
    classes = keyed.groupBy("key", "dim").agg(F.min(F.struct("id", "vh")).alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("sides").alias("sides"))
    classes = common.materialize(classes.select("key", "dim", F.col("rep.id").alias("rep"), F.col("rep.vh").alias("vh"), "weight", "sides"), root, "reps")
    blocks = lambda n: F.least(F.lit(GROUPS), F.ceil(F.col(n) / tile_rows)).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    per = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", blocks("n").alias("blocks"))
    n_pairs = per.agg(F.sum(F.expr("blocks * (blocks + 1) / 2"))).first()[0] or 1
    dealt = classes.join(F.broadcast(per), "dim").select("dim", "blocks", block.alias("block"), "rep", "sides")
    dealt = dealt.mapInArrow(_dealt, "dim int, lo int, hi int, own int, ids binary, sides binary")
    dealt = dealt.repartition(max(1, min(int(n_pairs), 10_000)), "dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi")
    near = common.materialize(dealt.mapInArrow(lambda x: _near(x, most), "a long, b long"), root, "near")
    near = components(near, root, "group")
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component", "n", blocks("n").alias("blocks"))
    n_rows = sizes.agg(F.sum(F.expr("n * blocks"))).first()[0] or 1
    members = near.join(sizes, "component").join(classes.select("dim", "rep", "vh", "weight"), F.col("node") == F.col("rep"))
    members = members.select(F.col("rep").alias("id"), "vh", "dim", "component", "weight", "blocks", block.alias("own"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("lo"), F.greatest("own", k).alias("hi"))))
    met = rows.join(members, ["id", "vh"]).withColumn("pair", pair).select("component", "dim", "pair.lo", "pair.hi", "own", "id", "vh", "weight", "vec")
    met = met.repartition(max(12, min(int(n_rows) // 2048, 10_000)), "component", "dim", "lo", "hi").sortWithinPartitions("component", "dim", "lo", "hi")
    found = common.materialize(met.mapInArrow(lambda x: _meet(x, cosine, spread, least, tile_rows), "id long, links long, to long"), root, "found")
    group = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), root, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    each = classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    each = common.materialize(each.select("key", "dim", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), root, "classes")
    members = keyed.select("id", "key", "dim").join(each, ["key", "dim"]).select(F.col("id").alias("_id"), "n_links", "component_id")
    ids = vectors.select(F.col(id_col).cast("long").alias(id_col))
    out = ids.join(members, ids[id_col] == members["_id"], "left")
    component = F.coalesce("component_id", id_col)
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(False)).alias("kept"))


def op8_vector_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links; those that link with nothing, and repeats, as in ``near_duplicates``."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
