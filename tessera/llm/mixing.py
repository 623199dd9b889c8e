"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt to blocks by a keyed hash, to more blocks the
larger it is. From the sizes of the blocks follow exact quotas: how often each
block of a source is drawn. What a whole block would overshoot is one more draw
of its own, the rest: documents of the next block up to a hash, and up to two
single ones that bring the source nearest to its target. A binary tree over the
output shards splits the quotas: at each node the left half of the shards gets
a multivariate-hypergeometric share of every source's draws. A shard then takes
the next draws of each source's permuted blocks, disjoint from all other
shards', and orders its documents by hash.

Planning reads a table of hashes and sizes. A row for each source and for each
block reaches the driver: sources have a target there anyway, and blocks number
``BLOCKS`` in all and a few for each source. Documents aren't shuffled to be
chosen, and only drawn ones go to their shard.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0
#: Blocks of all sources, by their share of the words, and the fewest of a source.
BLOCKS, FEWEST = 4096, 8
SHARDS, SEED = 32, 9
#: Rows of the plan's tables up to which they are broadcast (some 100 bytes each); larger ones are joined, where Spark splits hot sources.
BROADCAST_ROWS = 200_000

def words(text: F.Column) -> F.Column:
    """The number of words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict:
    """Each source's target: its part of ``share`` times all sizes by weight, at most ``limit`` times its size.

    Weights go to the sources by code point, null last, and repeat. What is
    above a limit is shared out again by weight until nothing is.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        if not (over := {s for s in free if unit * weight[s] > limit * sizes[s]}):
            out |= {s: unit * weight[s] for s in free}
            break
        out |= {s: limit * sizes[s] for s in over}
        left -= sum(limit * sizes[s] for s in over)
        free -= over
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows): the splitting tree's leaves."""
    if shards == 1:
        return quotas[None, :]
    total, half = int(quotas.sum()), shards // 2
    left = rng.multivariate_hypergeometric(quotas, total * half // shards, method="marginals") if total else quotas * 0
    return np.concatenate([split(left, half, rng), split(quotas - left, shards - half, rng)])


def _keys(seed: int) -> list[F.Column]:
    """Of a document: its source as a key that is never null, and two hashes, for its block and its place in it."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return [source.alias("_k"), F.xxhash64(F.lit(seed), "doc_id").alias("_b"), F.xxhash64(F.lit(seed + 1), "doc_id").alias("_at")]


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Plan:
    """What is drawn: tables of sources (_k, source_size, target, and the rest draw's documents) and of blocks (their draws)."""

    def __init__(self, units: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED):
        """``units``: _k, _b, _at and size, the words of the rows that are drawn together; a table, as it is read several times."""
        self.spark, self.shards = units.sparkSession, shards
        sizes = {r["_k"]: r["size"] for r in units.groupBy("_k").agg(F.sum("size").alias("size")).collect()}  # a row a source
        goal = {("s" + s if s is not None else "n"): g for s, g in targets({k[1:] if k[0] == "s" else None: n for k, n in sizes.items()}, weights, share, limit).items()}
        names, whole = sorted(sizes), max(1, sum(sizes.values()))
        self.sources = [(k, sizes[k], float(goal[k]), max(FEWEST, blocks * sizes[k] // whole)) for k in names]
        placed = units.join(_near(self.spark.createDataFrame(self.sources, "_k string, source_size long, target double, _n long"), len(names)), "_k").withColumn("_block", F.pmod("_b", "_n"))
        by: dict = {}
        for r in placed.groupBy("_k", "_block").agg(F.sum("size").alias("size")).collect():  # a row a block
            by.setdefault(r["_k"], {})[r["_block"]] = r["size"]
        order, quota, left, next_ = {}, {}, {}, {}
        for k in names:
            rng = np.random.default_rng([seed, zlib.crc32(k.encode())])
            order[k] = rng.permutation(sorted(by[k])).tolist()
            times = int(goal[k] // sizes[k]) if sizes[k] else 1
            left[k], n = goal[k] - times * sizes[k] if sizes[k] else 0.0, 0
            while n < len(order[k]) and by[k][order[k][n]] <= left[k]:
                left[k] -= by[k][order[k][n]]
                n += 1
            quota[k], next_[k] = times * len(order[k]) + n, order[k][n] if n < len(order[k]) else -1
        # which of a source's blocks are drawn once more than the others
        more = {(k, order[k][d % len(order[k])]) for k in names for d in range(quota[k] // len(order[k]) * len(order[k]), quota[k])}
        rest = self._rest(placed, [(k, left[k], next_[k]) for k in names if left[k] >= 1], more)
        quotas = np.array([quota[k] + (k in rest) for k in names], np.int64)
        shares = split(quotas, shards, np.random.default_rng(seed)) if names else np.zeros((0, 0), np.int64)
        drawn: dict = {(k, b): [] for k in names for b in by[k]}
        self.rests = []
        for i, k in enumerate(names):
            shard = np.repeat(np.arange(len(shares)), shares[:, i]).tolist()
            for d in range(quota[k]):
                drawn[k, order[k][d % len(order[k])]].append((d, shard[d]))
            if k in rest:
                self.rests.append((k, next_[k], *rest[k], (quota[k], shard[quota[k]])))
        self.blocks = [(k, b, v) for (k, b), v in drawn.items()]

    def _rest(self, placed: DataFrame, open_: list, more: set) -> dict:
        """Of each source what fills up its target: the hash up to which the next block is drawn (null: none of it), and single documents."""
        if not open_:
            return {}
        found = {k: [None, []] for k, _, _ in open_}
        left = {k: x for k, x, _ in open_}
        want = self.spark.createDataFrame([(k, float(x), b) for k, x, b in open_], "_k string, _left double, _next long")
        upto = F.sum("size").over(Window.partitionBy("_k").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
        first = placed.join(_near(want, len(open_)), "_k").where("_block = _next").withColumn("upto", upto).where("upto <= _left")
        for r in first.groupBy("_k").agg(F.max(F.struct("upto", "_at")).alias("m")).collect():  # a row a source
            found[r["_k"]][0] = r["m"]["_at"]
            left[r["_k"]] -= r["m"]["upto"]
        taken = self.spark.createDataFrame(sorted(more), "_k string, _block long") if more else None
        free = placed.join(_near(taken, len(more)), ["_k", "_block"], "left_anti") if more else placed
        for _ in range(2):
            rows = [(k, float(left[k]), b, found[k][0], found[k][1]) for k, _, b in open_ if left[k] >= 1]
            if not rows:
                break
            want = self.spark.createDataFrame(rows, "_k string, _left double, _next long, _upto long, _gone array<long>")
            one = free.join(_near(want, len(rows)), "_k").where("size > 0 and not array_contains(_gone, _at) and not (_block = _next and _upto is not null and _at <= _upto)")
            one = one.withColumn("miss", F.abs(F.col("size") - F.col("_left"))).where("miss < _left")
            for r in one.groupBy("_k").agg(F.min(F.struct("miss", "_at", "size")).alias("m")).collect():  # a row a source
                found[r["_k"]][1].append(r["m"]["_at"])
                left[r["_k"]] -= r["m"]["size"]
        return {k: v for k, v in found.items() if v[0] is not None or v[1]}

    def draws(self, rows: DataFrame) -> DataFrame:
        """``rows`` (_k, _b, _at and any others) with source_size, target and draws, a list of (draw, shard)."""
        spark = self.spark
        sources = spark.createDataFrame(self.sources, "_k string, source_size long, target double, _n long")
        rests = spark.createDataFrame(self.rests, "_k string, _next long, _upto long, _single array<long>, _last struct<draw:int,shard:int>")
        blocks = spark.createDataFrame(self.blocks, "_k string, _block long, _draws array<struct<draw:int,shard:int>>")
        met = rows.join(_near(sources.join(rests, "_k", "left"), len(self.sources)), "_k").withColumn("_block", F.pmod("_b", "_n"))
        met = met.join(_near(blocks, len(self.blocks)), ["_k", "_block"])
        last = F.expr("_last is not null and (array_contains(_single, _at) or (_upto is not null and _block = _next and _at <= _upto))")
        draws = F.when(F.coalesce(last, F.lit(False)), F.concat("_draws", F.array("_last"))).otherwise(F.col("_draws"))
        return met.withColumn("draws", draws).drop("_block", "_draws", "_n", "_next", "_upto", "_single", "_last")


def plan(docs: DataFrame, root: str, seed: int = SEED, **how) -> Plan:
    """The plan for ``docs`` (doc_id, source, text); a table of hashes and sizes is written below ``root`` and removed."""
    units = docs.select(*_keys(seed), words(F.col("text")).alias("size")).groupBy("_k", "_b", "_at").agg(F.sum("size").alias("size"))
    units = common.materialize(units, root, "units")
    made = Plan(units, seed=seed, **how)
    common.discard(docs.sparkSession, root, "units")
    return made


def mix(docs: DataFrame, seed: int = SEED, made: Plan | None = None, root: str | None = None, **how) -> DataFrame:
    """The mix: ``docs``' rows as often as drawn, each shard a partition, shuffled within.

    Sources by code point, null last, have ``weights``, repeating, and share
    ``share`` times all words; a target is at most ``limit`` times its source's
    words. The choice depends on doc_id, source, the sizes and ``seed`` only:
    rows of one doc_id and source are drawn together, as are rows without doc_id
    of a source; a null or empty text has no words and goes where its block
    goes; a source without words is taken once; an empty table gives no row.
    Columns stay as they are, whatever their names.
    """
    made = made or plan(docs, root or common.shared_dir(docs.sparkSession), seed, **how)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_keys(seed))
    each = made.draws(rows).select("row", "_at", F.explode("draws").alias("d"))
    placed = each.select("row", F.col("d.shard").alias("shard"), F.xxhash64(F.lit(seed + 2), "_at", "d.draw").alias("order"))
    return placed.repartitionById(made.shards, F.col("shard")).sortWithinPartitions("order").select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document adds to the mix, counted in the written mix. Nulls and repeats: see ``mix``; each of a doc_id's rows has its own count."""
    docs, root = common.table(spark, sf_dir, "documents"), common.shared_dir(spark)
    sized = docs.select("doc_id", "source", "text", words(F.col("text")).alias("size"))
    sized = common.materialize(sized.select("doc_id", "source", "size", F.monotonically_increasing_id().alias("row")), root, "sized")
    units = sized.select(*_keys(SEED), "size").groupBy("_k", "_b", "_at").agg(F.sum("size").alias("size"))
    made = Plan(common.materialize(units, root, "units"))
    mixed = common.materialize(mix(sized, made=made), root, "mix")
    taken = mixed.groupBy("row").agg(F.sum("size").alias("taken"))
    sources = spark.createDataFrame(made.sources, "_k string, source_size long, target double, _n long").drop("_n")
    out = sized.withColumn("_k", _keys(SEED)[0]).join(_near(sources, len(made.sources)), "_k").join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
