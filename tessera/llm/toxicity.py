"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled documents, give each word's
probability. The history is within the word: a word is predicted from its first
7 bytes, these from its first 5, these from its first 4, and these from a
distribution that both classes share. The highest order counts the documents that hold the word; a
lower one counts the distinct longer forms that begin so, as Kneser-Ney's
continuation counts do. From each count a discount is taken, which is estimated
from how many counts are 1, 2, 3 and 4 (modified Kneser-Ney: one discount for
counts of 1, of 2 and of more), and the mass so freed backs off to the next
order. How often a form is among those of its beginning is counted over both
classes together, so a rare expression is as likely in either, and a new one of
a toxic family is not. Word pairs were tried as a higher order and left out:
they lowered recall.

A text's evidence are two differences of log-likelihoods, toxic less ordinary,
normalised by length: the mean over all its words, and what single words have
above ``EXCESS``, summed and divided by the square root of the number of words
(what chance adds to such a sum grows as that root). A logistic curve, fitted
on labelled documents that the models have not counted, makes the score of it.

The counts come from all labelled documents of their folds and are kept in
tables of fixed size, so what is broadcast has a proven bound however large the
corpus is; only the curve has a bounded sample. Every document is scored whole,
in one pass and without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textwords import SLICE, Hasher

#: Labelled documents of each class that the curve is fitted on at most.
CURVE_SAMPLE = 5_000
FOLDS, CURVE_FOLD = 5, 1
#: The orders, highest first: bytes of a word that are looked at, and the slots of their tables as powers of two.
ORDERS = ((1 << 40, 22), (7, 21), (5, 20), (4, 20))
#: A word's difference above this is evidence by itself.
EXCESS = 2.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of words (runs of letters and digits, A-Z as a-z) the slots in each order; each text's first word (one more at the end)."""
    solid = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[at] = edge[0] = edge[-1] = True
    bounds = np.flatnonzero(edge)
    on = solid[bounds[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = bounds[:-1][on], bounds[1:][on]
    hasher = Hasher(data)
    return [_slot(hasher.of(starts, np.minimum(ends, starts + most)), bits) for most, bits in ORDERS], np.searchsorted(starts, at)


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int32)


#: The columns of slots, highest order first.
SLOTS = [f"slot{k}" for k in range(len(ORDERS))]
COUNTED = pa.schema([("toxic", pa.int32()), *((c, pa.int32()) for c in SLOTS), ("n", pa.int64())])
COUNTED_DDL = f"toxic int, {', '.join(f'{c} int' for c in SLOTS)}, n long"


def _counted(batches: common.Batches) -> common.Batches:
    """In how many of these documents each word is."""
    bits = ORDERS[0][1]
    for batch in batches:
        data, at = common.utf8(batch["text"])
        toxic = batch["toxic"].to_numpy()
        for i, j in common.slices(at, SLICE):
            slots, first = words_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
            doc = np.repeat(np.arange(i, j), np.diff(first))
            _, once = np.unique(doc << bits | slots[0], return_index=True)
            key, place, n = np.unique(toxic[doc[once]].astype(np.int64) << bits | slots[0][once], return_index=True, return_counts=True)
            yield common.batch_of(COUNTED, [(key >> bits).astype(np.int32), *(s[once][place] for s in slots), n])


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more: modified Kneser-Ney's estimates, kept within (0, count)."""
    n = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    return np.array([0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1 * k), 0.95 * k) if n[k] else 0.75 * k for k in (1, 2, 3)], np.float32)


def _first(key: np.ndarray, size: int) -> np.ndarray:
    """Of each key that occurs, in their order, its first row; keys are below ``size``. A table of fixed size takes less memory than to sort."""
    at = np.full(size, -1, np.int32)
    at[key[::-1]] = np.arange(len(key) - 1, -1, -1, dtype=np.int32)  # of equal keys the last to be assigned stays
    return at[at >= 0]


class Order:
    """One order's tables: of each slot and class the discounted share, and over both classes how much it was counted."""

    def __init__(self, key: np.ndarray, n: np.ndarray | None, bits: int):
        """``key``: twice the slot and the class; ``n``: the counts of distinct keys; without, each row counts once."""
        if n is None:
            counts = np.bincount(key, minlength=2 << bits).astype(np.float32)
        else:
            counts = np.zeros(2 << bits, np.float32)
            counts[key] = n
        counts = counts.reshape(-1, 2)
        self.freed = np.ones(2)
        self.both = counts.sum(1) + np.float32(0.5)  # a form that was never seen has half a count
        for c in (0, 1):
            at = np.flatnonzero(counts[:, c])
            seen = counts[at, c]
            if total := float(seen.sum(dtype=np.float64)):
                off = discounts(seen)[np.minimum(seen, 3).astype(np.int64)]
                self.freed[c] = float(off.sum(dtype=np.float64)) / total
                counts[at, c] = (seen - off) / total
        self.share = counts


def _of_parent(child: np.ndarray, parent: np.ndarray, both: np.ndarray, bits: int) -> np.ndarray:
    """Of each parent slot what its children were counted, one unseen child included."""
    first = _first(child, len(both))
    return (np.bincount(parent[first], both[child[first]], 1 << bits) + 0.5).astype(np.float32)


class Model:
    """The tables of both classes' models, and the curve. Tables are built where they are first used: the driver only sends the counts."""

    def __init__(self, rows: dict[str, np.ndarray]):
        """rows: toxic, the slots of each order, and n, the number of documents of that class with the word."""
        self.rows, self.curve, self.given = rows, np.zeros(3), None

    def __getattr__(self, name: str):
        if name not in ("orders", "of", "low"):
            raise AttributeError(name)
        self._build()
        return self.__dict__[name]

    def _build(self) -> None:
        klass, n, slots = self.rows["toxic"].astype(np.int32), self.rows["n"], [self.rows[c].astype(np.int32, copy=False) for c in SLOTS]
        self.orders, self.of = [], []
        for k, (_, bits) in enumerate(ORDERS):
            child, *slots = slots
            key = child * 2 + klass
            self.orders.append(Order(key, n, bits))
            if slots:
                self.of.append(_of_parent(child, slots[0], self.orders[k].both, ORDERS[k + 1][1]))
                once = _first(key, 2 << bits)  # each form of a class counts once for its beginning
                klass, n, slots = klass[once], None, [s[once] for s in slots]
        last = self.orders[-1]
        shared = last.both / last.both.sum(dtype=np.float64)
        self.low = (last.share + last.freed * shared[:, None]).astype(np.float32)

    def __reduce__(self):
        return _rebuilt, (self.rows, self.curve)  # the counts are a fraction of the tables

    def probabilities(self, slots: list[np.ndarray]) -> np.ndarray:
        """Of each word (rows) its probability by each class (columns)."""
        p = self.low[slots[-1]]
        for k in range(len(ORDERS) - 2, -1, -1):
            order, slot = self.orders[k], slots[k]
            p = order.share[slot] + (order.both[slot] / self.of[k][slots[k + 1]])[:, None] * order.freed.astype(np.float32) * p
        return p

    def evidence(self, column: pa.Array) -> np.ndarray:
        """For each text the mean difference of all its words, and what single words have above EXCESS."""
        data, at = common.utf8(column)
        out = []
        for i, j in common.slices(at, SLICE):
            slots, first = words_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
            p = np.log(self.probabilities(slots))
            n, d = np.diff(first), p[:, 1] - p[:, 0]
            for each, by in ((d, n), (np.maximum(d - EXCESS, 0), np.sqrt(n))):
                sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
                out.append((sums[first[1:]] - sums[first[:-1]]) / np.maximum(by, 1))
        return np.stack([np.concatenate(out[k::2]) for k in (0, 1)], 1) if out else np.zeros((0, 2))

    def scores(self, column: pa.Array) -> np.ndarray:
        return curved(self.evidence(column), self.curve)

    def sent(self, spark: SparkSession):
        """The broadcast of the counts: one for the curve's evidence and all scores, so a Python worker builds and keeps the tables once."""
        if self.given is None:
            self.given = spark.sparkContext.broadcast(self)
            _SENT.append(self)
        return self.given


def curved(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The scores of evidence."""
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30)))


def _rebuilt(rows: dict[str, np.ndarray], curve: np.ndarray) -> Model:
    common.used_by("toxicity")
    model = Model(rows)
    model._build()
    model.curve, model.rows = curve, {}  # a worker needs the tables only
    common.trim()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Intercept and slopes by Newton steps, each row counting ``weight`` times (once without). More evidence never lowers a score: a slope below 0 is 0; the ridge keeps separable rows' finite."""
    out = np.zeros(1 + x.shape[1])
    if not len(y) or y.min() == y.max():
        return out
    weight = np.ones(len(y)) if weight is None else weight
    on = np.ones(len(out), bool)
    while True:
        z = np.concatenate([np.ones((len(x), 1)), x], 1)[:, on]
        b, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
        keep[0, 0] = 1e-9
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + keep, z.T @ (weight * (y - p)) - keep @ b)
            b = b + step
            if np.abs(step).max() < 1e-8:
                break
        out[:] = 0
        out[on] = b
        if (out[1:] >= 0).all():
            return out
        on &= (out >= 0) | (np.arange(len(out)) == 0)


def sampled(labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, toxic): of each class up to ``per_class`` documents, by a hash of doc_id."""
    of = [labels.where(F.col("toxic") == c).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(per_class) for c in (0, 1)]
    return of[0].union(of[1])


def fit(docs: DataFrame, labels: DataFrame, curve_sample: int = CURVE_SAMPLE) -> Model:
    """The models, from labelled documents whose crc32(doc_id) leaves a remainder other than 0 by 5.

    ``labels`` has doc_id and toxic; rows with a null are ignored, a doc_id
    with several labels is toxic if one says so. Of the rows used, those of
    remainder 1 fit the curve, in a sample bounded by ``curve_sample``
    documents a class, and all others are counted. A row of the curve counts
    for as many labelled documents of its class as it was
    drawn from, so the classes' shares are those of all labels at every size.
    Without labels of both classes the score is a half for every text. The
    counts stay on the executors for ``score``, until ``release``.
    """
    root = common.shared_dir(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold("doc_id")).where("fold <> 0")
    known = common.materialize(known, root, "labels")
    curve = common.materialize(sampled(known.where(f"fold = {CURVE_FOLD}"), curve_sample).coalesce(1), root, "curve")  # at most 2 * curve_sample rows of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    counted = texts.where(~fold("doc_id").isin(0, CURVE_FOLD)).join(known.where(f"fold <> {CURVE_FOLD}").select("doc_id", "toxic").hint("merge"), "doc_id")
    words = counted.select("text", "toxic").mapInArrow(_counted, COUNTED_DDL)
    # where words share a slot, the beginnings of one of them; a row in two numbers, as all rows go to the driver
    low = [F.col(c).cast("long") for c in SLOTS[1:]]
    sums = words.groupBy("toxic", SLOTS[0]).agg(F.min(_packed(low)).alias("low"), F.sum("n").alias("n"))
    rows = sums.select((F.col(SLOTS[0]) * 2 + F.col("toxic")).alias("key"), "low", F.col("n").cast("int").alias("n")).toArrow()  # at most a row for each slot and class
    model = Model(_unpacked(*(rows[c].to_numpy() for c in ("key", "low", "n"))))
    held = _evidence(texts.join(F.broadcast(curve), "doc_id").select("text", "toxic"), model)
    x = np.array([e for _, e in held], float).reshape(-1, 2)
    of_class = {r["toxic"]: r["count"] for r in known.where(f"fold = {CURVE_FOLD}").groupBy("toxic").count().collect()}
    weight = np.array([of_class[y] / min(of_class[y], curve_sample) for y, _ in held], float)
    if rows.num_rows and np.ptp(model.rows["toxic"]):
        model.curve = logistic(x, np.array([y for y, _ in held], float), weight=weight)
    common.discard(docs.sparkSession, root, "labels", "curve")
    return model


def _packed(slots: list[F.Column]) -> F.Column:
    """The slots of the lower orders in one number."""
    out = slots[0]
    for c, (_, bits) in zip(slots[1:], ORDERS[2:]):
        out = F.shiftleft(out, bits) + c
    return out


def _unpacked(key: np.ndarray, low: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    out = {"toxic": (key & 1).astype(np.int8), SLOTS[0]: (key >> 1).astype(np.int32), "n": n.astype(np.int32)}
    for c, (_, bits) in zip(SLOTS[:0:-1], ORDERS[:0:-1]):
        out[c], low = (low & ((1 << bits) - 1)).astype(np.int32), low >> bits
    return out


def _evidence(texts: DataFrame, model: Model) -> list[tuple[int, list[float]]]:
    """Label and evidence of each of the curve's documents."""
    given = model.sent(texts.sparkSession)

    def run(batches: common.Batches) -> common.Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(list(given.value.evidence(batch["text"])), pa.list_(pa.float64()))], names=["toxic", "evidence"])

    return [(r.toxic, r.evidence) for r in texts.mapInArrow(run, "toxic int, evidence array<double>").collect()]


def fold(column: str) -> F.Column:
    return (F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS).cast("int")


#: Rows of a batch that goes back to Spark; texts are long.
_BACK = 1024


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity_score, from 0 to 1.

    Only ``text`` counts. A null text is as an empty one, whose evidence is
    none: it gets the curve's value at zero. Other columns stay; one called
    toxicity_score is replaced. Repeated rows get equal scores; an empty table
    gives no row. ``release`` gives the model's memory back when the result has
    been written.
    """
    given, curve = model.sent(docs.sparkSession), model.curve  # what was sent may be older than the curve
    kept = [c for c in docs.columns if c != "toxicity_score"]
    at = kept.index("text")

    def run(batches: common.Batches) -> common.Batches:
        for batch in batches:
            for i in range(0, batch.num_rows, _BACK):
                part = batch.slice(i, _BACK)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(curved(given.value.evidence(part.column(at).cast(pa.string())), curve), pa.float64())], names=[*part.schema.names, "toxicity_score"])

    schema = docs.select(*kept).schema.add("toxicity_score", "double")
    return docs.select(*kept).mapInArrow(run, schema)


_SENT: list[Model] = []


def release() -> None:
    """Drop the models that ``fit`` and ``score`` have sent to the executors; results that haven't been computed yet can't be any more.

    A Python worker lets go of its copy when it gets its next task or ends.
    """
    while _SENT:
        model = _SENT.pop()
        model.given.destroy()
        model.given = None


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; nulls, empty texts and repeats as in ``score``, a row without doc_id isn't held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
