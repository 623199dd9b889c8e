"""Collections: a table, its key and its relations to other collections."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """``many``: the other side's rows whose ``theirs`` equals this side's ``ours``; otherwise the one such row."""

    to: str
    ours: str
    theirs: str
    many: bool = False


@dataclass(frozen=True)
class Index:
    """``kind``: ordered, unique, vector, fulltext or encrypted. A unique one is a constraint on writes; the others say how a field may be searched."""

    name: str
    fields: tuple[str, ...]
    kind: str = "ordered"
    options: dict = field(default_factory=dict, hash=False)


@dataclass
class Collection:
    """``rules`` constrain writes by field: default, immutable, size (of an array), counter (pn, or p: it never falls)."""

    name: str
    load: Callable[[], DataFrame]
    key: str | None
    relations: dict[str, Relation] = field(default_factory=dict)
    indexes: list[Index] = field(default_factory=list)
    rules: dict[str, dict] = field(default_factory=dict)
    log: Callable[[], DataFrame] | None = None
    table: object | None = None
    #: Who may read which documents (_docID, identity); documents that it doesn't name are everyone's.
    grants: Callable[[], DataFrame] | None = None

    @property
    def ordered(self) -> bool:
        """Whether _docID is cheap to sort by: a key, not a hash of the whole row."""
        return self.key is not None or self.table is not None

    def frame(self) -> DataFrame:
        """The rows with _docID (the key as text, or a hash of the whole row) and _deleted."""
        df = self.load()
        if "_docID" not in df.columns:
            whole = F.sha2(F.to_json(F.struct(*df.columns)), 256)
            df = df.withColumn("_docID", F.col(self.key).cast("string") if self.key else whole)
        return df if "_deleted" in df.columns else df.withColumn("_deleted", F.lit(False))


def shared(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); on one machine, where it is unset, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/tessera-checkpoints"
    return top.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so an iteration's plan doesn't grow."""
    path = f"{shared(df.sparkSession)}/step-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        """``root``: where collections that are made by SQL are stored; without it, the folder of checkpoints."""
        self.spark, self.collections, self.own_root = spark, {}, root
        #: Who asks.
        self.identity: str | None = None

    @property
    def root(self) -> str:
        return self.own_root or f"{shared(self.spark)}/collections"

    def add(self, name: str, load: Callable[[], DataFrame] | DataFrame, key: str | None = None, **relations: Relation) -> Collection:
        rows = load
        self.collections[name] = Collection(name, rows if callable(rows) and not isinstance(rows, DataFrame) else lambda: rows, key, relations)
        return self.collections[name]

    def __getitem__(self, name: str) -> Collection:
        if name not in self.collections:
            raise KeyError(f"no such collection: {name}")
        return self.collections[name]

    def views(self) -> None:
        """Each collection as a temporary view, for SQL."""
        for name, c in self.collections.items():
            c.load().createOrReplaceTempView(name)


def tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """The driver's tables as collections."""
    at = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    one, many = Relation, lambda to, ours, theirs: Relation(to, ours, theirs, True)
    c = Catalog(spark)
    c.add("Region", at("region"), "r_regionkey", nations=many("Nation", "r_regionkey", "n_regionkey"))
    c.add("Nation", at("nation"), "n_nationkey", region=one("Region", "n_regionkey", "r_regionkey"), customers=many("Customer", "n_nationkey", "c_nationkey"), suppliers=many("Supplier", "n_nationkey", "s_nationkey"))
    c.add("Customer", at("customer"), "c_custkey", nation=one("Nation", "c_nationkey", "n_nationkey"), orders=many("Orders", "c_custkey", "o_custkey"))
    c.add("Supplier", at("supplier"), "s_suppkey", nation=one("Nation", "s_nationkey", "n_nationkey"), lineitems=many("Lineitem", "s_suppkey", "l_suppkey"))
    c.add("Part", at("part"), "p_partkey", lineitems=many("Lineitem", "p_partkey", "l_partkey"))
    c.add("Orders", at("orders"), "o_orderkey", customer=one("Customer", "o_custkey", "c_custkey"), lineitems=many("Lineitem", "o_orderkey", "l_orderkey"))
    c.add("Lineitem", at("lineitem"), None, order=one("Orders", "l_orderkey", "o_orderkey"), part=one("Part", "l_partkey", "p_partkey"), supplier=one("Supplier", "l_suppkey", "s_suppkey"))
    c.add("Event", at("events"), "event_id")
    c.add("Document", at("documents"), "doc_id", labels=many("Label", "doc_id", "doc_id"))
    c.add("Label", at("labels"), "doc_id", document=one("Document", "doc_id", "doc_id"))
    c.add("Embedding", at("embeddings"), "vec_id")
    c.add("Page", at("pages"), "page_id")
    return c
