"""Ranking: vector similarity, BM25 and their fusion."""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

K1, B, RRF_K = 1.2, 0.75, 60
#: Most bytes of rows that are handed to Python at once.
BATCH_BYTES, _BATCH = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
TERM = r"[^\p{L}\p{N}]+"


def similarity(c: Column, vector: list[float], metric: str = "cosine") -> Column:
    """Larger is nearer: cosine (0 for a zero vector), the negative square of the distance, or the inner product; null vectors have none."""
    q, c = F.array(*[F.lit(float(x)) for x in vector]), c.cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    sized = F.when(c.isNull(), None).when(F.size(c) != len(vector), F.raise_error(F.lit("vectors of different lengths"))).otherwise(c)
    dot = total(F.zip_with(sized, q, lambda x, y: x * y))
    metric = metric.lower()
    if metric == "dot":
        return dot
    if metric in ("euclidean", "l2"):
        return -total(F.zip_with(sized, q, lambda x, y: (x - y) * (x - y)))
    norm = F.sqrt(total(F.transform(sized, lambda x: x * x))) * math.sqrt(sum(float(x) ** 2 for x in vector))
    return F.when(norm > 0, dot / norm).otherwise(F.when(norm.isNotNull(), 0.0))


def tag(value: Column, field: str, key: str) -> Column:
    """HMAC-SHA-256 of a value under a key of the field's own."""
    own = hmac.new(key.encode(), field.encode(), hashlib.sha256).digest()
    inner, outer = (bytes(b ^ x for b in own.ljust(64, b"\0")) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("string").cast("binary")), 256))), 256)


def terms(text: Column, language: str | None = None) -> Column:
    """Runs of letters and digits in lower case; with a language, without its stop words."""
    words = F.filter(F.split(F.lower(text), TERM), lambda w: w != "")
    if language is None:
        return words
    stop = stop_words(language)
    return F.filter(words, lambda w: ~w.isin(stop))


def stop_words(language: str) -> list[str]:
    """Those that Spark has for the language; English for one that it doesn't know."""
    from pyspark.ml.feature import StopWordsRemover

    try:
        return list(StopWordsRemover.loadDefaultStopWords(language.lower()))
    except Exception:  # the JVM's complaint about an unknown language
        return list(StopWordsRemover.loadDefaultStopWords("english"))


def wanted(query: str, language: str | None = None) -> list[str]:
    stop = set(stop_words(language)) if language else set()
    return [w for w in re.split(r"[^\w]+|_", query.lower()) if w and w not in stop]


def _times(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def _weight(tf: Column, dl: Column, mean: Column, rows: Column, holding: Column) -> Column:
    """A term's part of a row's score."""
    idf = F.log((rows - holding + 0.5) / (holding + 0.5) + 1)
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))).otherwise(0.0)


def bm25(df: DataFrame, fields: list[str], query: str, alias: str, by: str | None = None, language: str | None = None) -> DataFrame:
    """``df`` with the sum over fields of BM25; rows without a term of the query get 0. A term that is repeated counts again.

    One aggregate over the rows gives the statistics of every term; they meet
    the rows again as a single row, so nothing is shuffled but sums. With
    ``by`` the statistics are those of the rows that share its value.
    """
    asked = wanted(query, language)
    if isinstance(fields, str):
        fields = [fields]
    distinct = sorted(set(asked))
    if not distinct:
        return df.withColumn(alias, F.lit(0.0))
    stats, score = [], F.lit(0.0)
    for i, f in enumerate(fields):
        text = F.coalesce(F.col(f).cast("string"), F.lit(""))
        if language is None:  # counted in place: no array of words is made
            df = df.withColumn("__low", F.lower(text))
            counts = [F.regexp_count("__low", F.lit(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])")) for w in distinct]
            df = df.withColumn(f"__bm{i}", F.struct(F.regexp_count("__low", F.lit(r"[\p{L}\p{N}]++")).alias("dl"), *[c.alias(f"t{j}") for j, c in enumerate(counts)])).drop("__low")
        else:
            words = terms(text, language)
            df = df.withColumn(f"__bm{i}", F.struct(F.size(words).alias("dl"), *[_times(words, w).alias(f"t{j}") for j, w in enumerate(distinct)]))
        held = F.col(f).isNotNull()
        stats += [F.sum(F.when(held, 1)).alias(f"n{i}"), F.avg(F.when(held, F.col(f"__bm{i}.dl"))).alias(f"avg{i}")]
        stats += [F.sum(F.when(F.col(f"__bm{i}.t{j}") > 0, 1).otherwise(0)).alias(f"df{i}_{j}") for j in range(len(distinct))]
    if by is None:
        df = df.crossJoin(F.broadcast(df.agg(F.struct(*stats).alias("__stats"))))  # one row
    else:
        sums = df.groupBy(F.col(by).alias("__by")).agg(F.struct(*stats).alias("__stats"))
        df = df.join(sums, df[by].eqNullSafe(sums["__by"])).drop("__by")
    for i in range(len(fields)):
        s, own = (lambda n: F.col(f"__stats.{n}")), F.col(f"__bm{i}")
        for w in asked:
            j = distinct.index(w)
            score = score + _weight(own[f"t{j}"].cast("double"), own["dl"], s(f"avg{i}"), s(f"n{i}"), s(f"df{i}_{j}"))
    return df.withColumn(alias, score).drop("__stats", *[f"__bm{i}" for i in range(len(fields))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a row (key, words), and one of the empty term, which no query asks for, that holds its length."""
    for b in batches:
        words, size = b["words"], pc.list_value_length(b["words"])
        of = pa.table({"row": pc.list_parent_indices(words), "term": pc.list_flatten(words)}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        every = pa.array(range(len(b)), of["row"].type)
        rows = pa.chunked_array([*of["row"].chunks, every])
        term = pa.chunked_array([*of["term"].chunks, pa.repeat("", len(b)).cast(of["term"].type)])
        tf = pa.chunked_array([*of["count_all"].cast(pa.int32()).chunks, pa.repeat(pa.scalar(0, pa.int32()), len(b))])
        yield from pa.table({"term": term.cast(pa.string()), "key": b["key"].take(rows), "tf": tf, "dl": size.take(rows).cast(pa.int32())}).combine_chunks().to_batches()


def postings(df: DataFrame, key: str, field: str, language: str | None = None, parts: int = 64) -> DataFrame:
    """The rows of ``build_postings`` as they are written: placed by their part, in the order of their terms."""
    words = df.where(F.col(field).isNotNull()).select(F.col(key).alias("key"), terms(F.col(field).cast("string"), language).alias("words"))
    each = words.mapInArrow(_counted, StructType([StructField("term", StringType()), StructField("key", words.schema["key"].dataType), StructField("tf", IntegerType()), StructField("dl", IntegerType())]))
    return each.withColumn("part", _part(F.col("term"), parts)).repartition(parts, "part", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("part", "term")


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def build_postings(df: DataFrame, key: str, field: str, path: str, language: str | None = None, parts: int = 64) -> None:
    """A full-text index below ``path``: a row for each term of a row (term, key, tf, dl), in ``parts`` folders by the term's hash, and the totals.

    A query reads the folders of its terms only, and in them, as rows are
    sorted by term, the row groups that hold them. A row's terms are counted
    where the row is, so its words are split once and its counts shuffled once;
    the totals are those of the empty term's rows.
    """
    spark = df.sparkSession
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    postings(df, key, field, language, parts).write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    rows = spark.read.schema("term string, dl int, part int").parquet(f"{path}/postings").where((F.col("part") == _part(F.lit(""), parts)) & (F.col("term") == ""))
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg("dl").alias("mean"))
    totals.select("*", F.lit(language).cast("string").alias("language"), F.lit(parts).alias("parts")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def bm25_indexed(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(key, score) of rows that hold a term of the query, by an index of ``build_postings``."""
    totals = spark.read.parquet(f"{path}/totals").first()
    asked = wanted(query, totals["language"])
    distinct = sorted(set(asked))
    rows = spark.read.parquet(f"{path}/postings")
    parts = spark.createDataFrame([(w,) for w in distinct] or [("",)], "w string").select(F.pmod(F.xxhash64("w"), F.lit(totals["parts"])).cast("int")).distinct().collect()  # a row a term
    rows = rows.where(F.col("part").isin([r[0] for r in parts]) & F.col("term").isin(distinct))
    holding = rows.groupBy("term").agg(F.count(F.lit(1)).alias("holding"))
    times = spark.createDataFrame([(w, asked.count(w)) for w in distinct], "term string, times int")
    met = rows.join(F.broadcast(holding.join(times, "term")), "term")  # a row a term
    one = _weight(F.col("tf").cast("double"), F.col("dl"), F.lit(totals["mean"]), F.lit(totals["rows"]), F.col("holding")) * F.col("times")
    return met.groupBy("key").agg(F.sum(one).alias("score"))


def reciprocal_ranks(dense: DataFrame, sparse: DataFrame, key: str, depth: int, k: int = RRF_K) -> DataFrame:
    """Fusion of two rankings (key, score) by the ``depth`` best of each: key, rrf."""
    ranked = []
    for df, name in ((dense, "dense"), (sparse, "sparse")):
        best = df.orderBy(F.desc("score"), key).limit(depth)  # so the window below sees ``depth`` rows
        ranked.append(best.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias(name)))
    both = ranked[0].join(ranked[1], key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.select(key, (part("dense") + part("sparse")).alias("rrf"), F.least("dense", "sparse").alias("best_rank"), F.col("dense").alias("dense_rank"), F.col("sparse").alias("sparse_rank"))


def hybrid(df: DataFrame, key: str, vector: tuple[str, list[float]], text: tuple[list[str], str], k: int, depth: int = 100, metric: str = "cosine") -> DataFrame:
    """The ``k`` best rows (key, rrf) by both rankings; ties go by the better rank, then the vector's, the text's, the key."""
    dense = df.select(key, similarity(F.col(vector[0]), vector[1], metric).alias("score")).where("score is not null")
    sparse = bm25(df, text[0], text[1], "score").where("score > 0").select(key, "score")
    order = [F.desc("rrf"), F.asc("best_rank"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc(key)]
    return reciprocal_ranks(dense, sparse, key, depth).orderBy(*order).limit(k).select(key, "rrf")
