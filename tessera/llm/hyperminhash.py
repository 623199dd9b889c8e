"""Near-duplicate documents by HyperMinHash.

A text's shingles are dealt to 128 buckets by the top bits of their hash; a
bucket's register keeps the least hash in it as the number of its leading zeros
and 26 bits behind them. Bands of four registers propose pairs; in them an empty
register stands for the first used one in an order of its own, so that a band
of a short text is no single shingle, which a frequent passage would give to
any number of texts. The share of equal registers, less what chance collisions
of compressed registers add, estimates their Jaccard similarity; what isn't
clearly below the bound is verified on the full shingle sets.

Texts of equal sets are one node. A band's bucket proposes its members to its
smallest node first, so a group of copies costs as many pairs as it has
members. What that leaves apart within a bucket is proposed in further rounds
along maximum spanning forests of the estimates, and at last all pairs between
components that still share a bucket are compared in place, by samples of their
shingles, and proposed if these allow it: no proposed link between components
is lost, and pairs within a component are never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .textwords import exact_shingles, mixed, named_sets, shingle_sets

WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5
REGISTERS, BAND, MANTISSA = 128, 4, 26
#: Standard deviations of the estimate (and 0.01 for chance collisions) that a pair may be below the bound and still be verified.
MARGIN = 4.5
#: Members of a bucket, and of those outside its largest component, that one task compares: a square, as it ships least for its pairs.
BLOCK, ASKS = 4096, 4096
#: Shingles of a set that are compared where all pairs of a bucket's components are; of larger sets a sample.
PRINTS = 512
FOREST_ROUNDS = 3

_BITS = REGISTERS.bit_length() - 1
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bucket, of sorted shingles."""
    out = np.full(REGISTERS, _EMPTY)
    if len(shingles):
        bucket = shingles >> np.uint64(64 - _BITS)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out[bucket[at].astype(np.int64)] = shingles[at]
    return out


def compressed(least: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Registers: leading zeros + 1 in the upper six bits, MANTISSA bits below; 0 where a bucket is empty."""
    rest = least << np.uint64(_BITS)
    top = (rest >> np.uint64(11)).astype(np.float64)  # 53 bits: exact
    zeros = 53 - np.frexp(top)[1]
    zeros = np.minimum(np.where(top == 0, 53, zeros), 62 - _BITS).astype(np.uint64)
    tail = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(empty, 0, (zeros + np.uint64(1)) << np.uint64(MANTISSA) | tail).astype(np.uint32)


#: Whom each register asks while it is empty: a row an attempt.
_ORDERS = np.ascontiguousarray(np.random.default_rng(66).permuted(np.broadcast_to(np.arange(REGISTERS), (REGISTERS, REGISTERS)), axis=1).T)


def filled(regs: np.ndarray) -> np.ndarray:
    """Rows of registers, an empty one as the first used one that it meets in its order."""
    out = regs.copy()
    left = np.flatnonzero((regs == 0).any(1) & regs.any(1))
    for order in _ORDERS:
        if not len(left):
            break
        part, own = out[left], regs[left]
        part = np.where(part == 0, own[:, order], part)
        out[left] = part
        left = left[(part == 0).any(1)]
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many registers of sets without a common shingle are equal, for sets of n and m shingles.

    Two minima of a bucket agree by chance if they have the same leading zeros
    and the same bits behind: the sum, over the cells of hashes that share a
    register, of the chance that both minima fall in it.
    """
    return (_density(n) * _density(m) * _CELLS).sum(1)


_LOW = 0.5 ** np.arange(1, 59 - _BITS)
#: What two densities are weighed by in each cell.
_CELLS = REGISTERS * _LOW * _LOW * 0.5**MANTISSA


def _density(n: np.ndarray) -> np.ndarray:
    """Of a bucket's least hash of sets of n shingles, in the middle of the cells."""
    x = np.asarray(n, float)[:, None] / REGISTERS
    return x * np.exp(-x * _LOW * 1.4)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of rows of registers, corrected for chance collisions."""
    used = ((a | b) != 0).sum(1)
    equal = ((a == b) & (a != 0)).sum(1)
    by_chance = chance(n, m)
    return np.where(used > 0, np.maximum(equal - by_chance, 0) / np.maximum(used - by_chance, 1e-9), 0.0)


def margin(used: np.ndarray, n: np.ndarray, m: np.ndarray, bound: float = NUMERATOR / DENOMINATOR, deviations: float = MARGIN) -> np.ndarray:
    """The least estimate that is verified, of sets of n and m shingles and so many registers that either uses.

    The used registers hold as many shingles of the union, drawn without
    repetition: the more of it they hold, the surer is the estimate.
    """
    union = (n + m) / (1 + bound)
    left = np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
    return bound - deviations * np.sqrt(bound * (1 - bound) * left / np.maximum(used, 1)) - 0.01


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("registers", pa.binary()), ("th", pa.int64())])


def _sketch(batches: common.Batches, width: int) -> common.Batches:
    for batch in batches:
        n, s1, s2, least = [], [], [], []
        for s, x, y in named_sets(batch["text"], width):
            n.append(len(s))
            s1.append(x)
            s2.append(y)
            least.append(minima(s))
        least = np.array(least, np.uint64).reshape(-1, REGISTERS)
        regs = compressed(least, least == _EMPTY)
        yield common.batch_of(SKETCH, [batch["doc_id"], n, s1, s2, [r.tobytes() for r in regs], batch["th"]])


_MULT = np.random.default_rng(6).integers(0, 1 << 63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(batches: common.Batches) -> common.Batches:
    schema = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("node", pa.int64())])
    n_bands = REGISTERS // BAND
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            regs = filled(_registers(part["registers"])).reshape(-1, n_bands, BAND)
            keys = mixed((regs.astype(np.uint64) * _MULT).sum(-1, dtype=np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            on = regs.any(-1)
            nodes = np.broadcast_to(part["node"].to_numpy()[:, None], on.shape)
            band = np.broadcast_to(np.arange(n_bands, dtype=np.int32), on.shape)
            yield common.batch_of(schema, [keys[on].view(np.int64), band[on], nodes[on]])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, REGISTERS)


def _plausible(batches: common.Batches, num: int, den: int) -> common.Batches:
    """Pairs whose sizes and estimate allow the bound."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            a, b, n, m = _registers(part["a_registers"]), _registers(part["b_registers"]), part["a_n"].to_numpy(), part["b_n"].to_numpy()
            ok = (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (estimate(a, b, n, m) >= margin(((a | b) != 0).sum(1), n, m, num / den))
            yield common.batch_of(schema, [part["a"].to_numpy()[ok], part["b"].to_numpy()[ok]])


def _verified(batches: common.Batches, width: int, num: int, den: int) -> common.Batches:
    """Whether pairs of texts reach the bound, by their words themselves."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            linked = []
            for a, b in zip(part["a_text"].to_pylist(), part["b_text"].to_pylist()):
                x, y = exact_shingles(a, b, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield common.batch_of(schema, [part["a"], part["b"], linked])


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that the filled registers ``a`` share with each row of ``b``, which proposes the pair; -1: none."""
    same = (a == b).reshape(len(b), REGISTERS // BAND, BAND).all(-1) & b.any(-1)[:, None]
    return np.where(same.any(1), same.argmax(1), -1)


def level(n: int) -> int:
    """How often a set of n shingles is halved until at most PRINTS are expected."""
    return max(0, (n - 1).bit_length() - (PRINTS.bit_length() - 1))


def _prints(batches: common.Batches, width: int) -> common.Batches:
    """The shingles whose lowest ``level`` bits are 0, cut to 32 bits: a sample that fits any other's of a similar size."""
    schema = pa.schema([("node", pa.int64()), ("prints", pa.binary())])
    for batch in batches:
        out = []
        for s in shingle_sets(batch["text"], width):
            low = np.unique(s.astype(np.uint32))
            out.append(low[low & np.uint32((1 << level(len(s))) - 1) == 0].tobytes())
        yield common.batch_of(schema, [batch["node"], out])


class _Sets:
    """Samples of the sets of a bucket's members, to compare one set with many of them at once."""

    def __init__(self, prints: np.ndarray, n: np.ndarray):
        self.parts = [np.frombuffer(p, np.uint32) for p in prints]
        self.levels = np.array([level(int(k)) for k in n])
        self.names = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.uint32)
        self.at: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _cut(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of members of up to that level what it leaves of their samples, as places in ``names``; each one's start; their lengths."""
        if top not in self.at:
            cut = [p[p & np.uint32((1 << top) - 1) == 0] if k <= top else p[:0] for p, k in zip(self.parts, self.levels)]
            sizes = np.array([len(c) for c in cut])
            self.at[top] = np.searchsorted(self.names, np.concatenate(cut)), np.concatenate([[0], np.cumsum(sizes)]), sizes
        return self.at[top]

    def near(self, mine: bytes, n: int, j: np.ndarray, bound: float) -> np.ndarray:
        """Whether the samples of the members ``j`` and that of a set of n shingles leave the bound possible; up to PRINTS shingles they are the sets."""
        own, tops, out = np.frombuffer(mine, np.uint32), np.maximum(level(n), self.levels[j]), np.zeros(len(j), bool)
        for top in np.unique(tops).tolist():
            places, starts, sizes = self._cut(top)
            x, at = own[own & np.uint32((1 << top) - 1) == 0], np.flatnonzero(tops == top)
            mark = np.zeros(len(self.names), bool)
            mark[np.searchsorted(self.names, x[np.isin(x, self.names)])] = True
            if 8 * len(at) > len(self.parts):
                both = np.diff(np.concatenate([[0], np.cumsum(mark[places])])[starts])[j[at]]
            else:
                both = np.array([np.count_nonzero(mark[places[starts[k] : starts[k + 1]]]) for k in j[at]])
            union = np.maximum(1, len(x) + sizes[j[at]] - both)
            out[at] = both / union >= bound - (MARGIN * np.sqrt(bound * (1 - bound) / union) if top else 0) - 0.01
        return out


def _near(a: bytes, b: bytes, n: int, m: int, bound: float) -> bool:
    """Whether two samples leave the bound possible."""
    return bool(_Sets(np.array([b], object), np.array([m])).near(a, n, np.zeros(1, np.int64), bound)[0])


def _forest(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which links between the nodes x and y make a spanning forest of the largest e."""
    names, places = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, root = places[: len(x)], places[len(x) :], np.arange(len(names))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    kept, order = [], np.argsort(-e, kind="stable")
    for s in range(0, len(order), 1 << 14):
        while (root[root] != root).any():
            root = root[root]
        part = order[s : s + (1 << 14)]
        for k in part[root[x[part]] != root[y[part]]].tolist():
            if (a := top(x[k])) != (b := top(y[k])):
                root[a] = b
                kept.append(k)
    return np.array(kept, np.int64)


def _count(x: np.ndarray) -> np.ndarray:
    """How many of each row's flags are set."""
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint64)).sum(1, dtype=np.int64)


def _between(batches: common.Batches, num: int, den: int, forest: bool) -> common.Batches:
    """From rows sorted by (key, block): plausible pairs between components; ``forest``: only a spanning forest of the best.

    A pair that shares several bands is found in the first of them only. Where
    rows have prints, these must leave the bound possible, too.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[dict] = []
    at = None

    def close() -> pa.RecordBatch | None:
        rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]} if len(held) > 1 else held[0]
        asks, has = rows["ask"].astype(bool), ~rows["ask"].astype(bool)
        if not asks.any() or not has.any():
            return None
        q, c = {k: v[asks] for k, v in rows.items()}, {k: v[has] for k, v in rows.items()}
        regs, used_c, weighed = c["registers"], c["registers"] != 0, (_density(c["n"]) * _CELLS).T
        sets: _Sets | None = None
        found = []
        for i, density in enumerate(_density(q["n"])):
            ok = (q["component"][i] != c["component"]) & (q["node"][i] != c["node"])
            ok &= den * np.minimum(q["n"][i], c["n"]) >= num * np.maximum(q["n"][i], c["n"])
            if not len(j := np.flatnonzero(ok)):
                continue
            used_q = q["registers"][i] != 0
            equal = _count((regs[j] == q["registers"][i]) & used_q)
            used, by_chance = _count(used_c[j] | used_q), (density @ weighed)[j]
            e = np.maximum(equal - by_chance, 0) / np.maximum(used - by_chance, 1e-9)
            near = e >= margin(used, np.full(len(j), q["n"][i]), c["n"][j], num / den)
            j, e = j[near], e[near]
            if not len(j):
                continue
            first = _first_shared(q["filled"][i], c["filled"][j]) == q["band"][i]
            j, e = j[first], e[first]
            if "prints" in c and len(j):
                sets = sets or _Sets(c["prints"], c["n"])
                near = sets.near(q["prints"][i], int(q["n"][i]), j, num / den)
                j, e = j[near], e[near]
            if len(j):
                found.append((e, np.full(len(j), i), j))
        if not found:
            return None
        e, i, j = (np.concatenate(x) for x in zip(*found))
        if forest:
            kept = _forest(e, q["component"][i], c["component"][j])
            i, j = i[kept], j[kept]
        kept = np.sort(np.stack([q["node"][i], c["node"][j]], axis=1), axis=1)
        return common.batch_of(schema, [kept[:, 0], kept[:, 1]])

    for batch in batches:
        cols = {k: batch[k].to_numpy(zero_copy_only=False) for k in ("node", "component", "n", "ask", "band")} | {"registers": _registers(batch["registers"])}
        cols["filled"] = filled(cols["registers"])
        if "prints" in batch.schema.names:
            cols["prints"] = batch["prints"].to_numpy(zero_copy_only=False)
        keys = np.stack([batch["key"].to_numpy(), batch["block"].to_numpy().astype(np.int64)])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if (here := tuple(keys[:, i])) != at and held:
                if out := close():
                    yield out
                held.clear()
            at = here
            held.append({k: v[i:j] for k, v in cols.items()})
    if held and (out := close()):
        yield out


def near_duplicates(docs: DataFrame, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """Each row's doc_id with n_shingles, component_id and kept.

    Words are those between ASCII white space, A-Z as a-z; a text's set are its
    distinct shingles of ``width`` words, or all its words as one if it has
    fewer. Texts of similarity num/den or more are linked; component_id is the
    smallest doc_id that links reach. Texts without words have an empty set, no
    link and are their own component, as is a null text. Rows of one doc_id with
    different texts each have their own set, and what their sets link to; for
    links with others the document stands by the one whose text has the smallest
    hash, so runs agree. A row without doc_id belongs to the component of its
    equals (null if it has none) and is not kept. Other columns are ignored.

    A pair at the bound shares a band with a probability above 1 - 5e-8 if all
    registers are used; of fewer shingles, by simulation, half the bands miss up
    to 4 in 10,000 such pairs. Equal sets are known by 128 bits of sums of two
    independent hashes; all other links are confirmed on the words themselves.
    """
    spark = docs.sparkSession
    root = common.shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sketches = common.materialize(rows.mapInArrow(lambda b: _sketch(b, width), "doc_id long, n_shingles long, set1 long, set2 long, registers binary, th long"), root, "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("node"))
    classes = common.materialize(classes, root, "classes")
    nodes = sketches.join(classes.select(F.col("node").alias("doc_id"), "set1", "set2", "n_shingles"), ["doc_id", "set1", "set2", "n_shingles"])
    nodes = nodes.groupBy(F.col("doc_id").alias("node")).agg(F.min(F.struct("th", F.col("n_shingles").alias("n"), "registers")).alias("s")).select("node", "s.*")
    nodes = common.materialize(nodes, root, "nodes")

    # a set of n links with others only if n / (n + 1) reaches the bound
    bands = nodes.where(F.col("n") * (den - num) >= num).select("node", "registers").mapInArrow(_bands, "key long, band int, node long")
    shared = bands.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("other"), F.count(F.lit(1)).alias("members")).where("center <> other").select("key", "center", "members")
    shared = common.materialize(shared, root, "shared")
    held = common.materialize(bands.join(shared, "key").select("key", "band", "node", "center", "members"), root, "held")

    wanted = held.select("node").distinct()
    wanted = wanted.join(nodes.select("node", "th"), "node")
    texts = rows.join(wanted, (rows["doc_id"] == wanted["node"]) & (rows["th"] == wanted["th"])).select("node", "text").dropDuplicates(["node"])
    texts = common.materialize(texts, root, "texts")
    side = lambda df, p: df.select(F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "node"))

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        met = pairs.join(side(texts, "b"), "b").join(side(texts, "a"), "a").select("a", "b", "a_text", "b_text")
        return common.materialize(met.mapInArrow(lambda x: _verified(x, width, num, den), "a long, b long, linked boolean"), root, name)

    stars = held.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    met = stars.join(side(nodes.drop("th"), "b"), "b").join(side(nodes.drop("th"), "a"), "a").select("a", "b", "a_n", "b_n", "a_registers", "b_registers")
    pairs = common.materialize(met.mapInArrow(lambda x: _plausible(x, num, den), "a long, b long"), root, "stars")
    tried = checked(pairs, "tried-0")
    k, forests = 0, FOREST_ROUNDS
    while True:
        k += 1
        group = components(tried.where("linked").select("a", "b"), root, f"group-{k}")
        member = held.join(group, "node", "left").select("key", "band", "node", "members", F.coalesce("component", "node").alias("component"))
        sizes = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        apart = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), (F.sum("n") - F.max("n")).alias("asks")).where("parts > 1").select("key", "main", F.ceil(F.col("asks") / ASKS).cast("int").alias("ask_blocks"))
        open_ = common.materialize(member.join(apart, "key").withColumn("ask", F.col("component") != F.col("main")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), root, f"open-{k}")
        if open_.isEmpty():
            break
        # each block of a bucket's members meets each block of those that ask
        at, of = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("ask_blocks"))
        has = open_.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("ask_blocks") - 1), lambda j: (at * F.col("ask_blocks") + j).cast("long")))).withColumn("ask", F.lit(False))
        asks = open_.where("ask").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: (i * F.col("ask_blocks") + of).cast("long"))))
        cols = ["key", "block", "band", "node", "component", "ask"]
        met, more = has.select(*cols).union(asks.select(*cols)).join(nodes.drop("th"), "node"), []
        if not forests:
            prints = texts.join(open_.select("node").distinct(), "node").select("node", "text").mapInArrow(lambda x: _prints(x, width), "node long, prints binary")
            met, more = met.join(common.materialize(prints, root, "prints"), "node"), ["prints"]
        both = met.repartition("key", "block").sortWithinPartitions("key", "block")
        found = both.select(*cols, "n", "registers", *more).mapInArrow(lambda x, f=forests > 0: _between(x, num, den, f), "a long, b long").distinct()
        new = common.materialize(found.join(tried.select("a", "b"), ["a", "b"], "left_anti"), root, f"new-{k}")
        common.discard(spark, root, f"open-{k}")
        if some := not new.isEmpty():
            tried = tried.union(checked(new, f"tried-{k}"))
        if not forests:
            break
        forests = forests - 1 if some else 0
    group = components(tried.where("linked").select("a", "b"), root, "group")
    ends = classes.join(group, "node", "left").select("set1", "set2", "n_shingles", F.coalesce("component", "node").alias("component"))
    ends = common.materialize(ends, root, "ends")
    out = sketches.select("doc_id", "n_shingles", "set1", "set2").join(ends, ["set1", "set2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their components; nulls, empty texts and repeats as in ``near_duplicates``."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=4)
