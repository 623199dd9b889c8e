"""From documents to training windows in five stages.

Toxic documents go, later copies of long line runs are cut out, one document of
each group of near-duplicates stays, sources are mixed to target weights and
what was drawn is packed into token windows. Each stage works on all that the
one before it kept, and its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, hyperminhash, linededup, mixing, packing, tokens, toxicity

#: The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like_documents(df: DataFrame) -> DataFrame:
    """The columns of documents that ``df`` has; n_chars follows the text where a stage changed it."""
    return df.select(*[c for c in COLUMNS if c in df.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below a half. Null and empty texts stay; the models learn from ``labels`` and these documents."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return _like_documents(toxicity.score(docs, model).where((F.col("toxicity_score") < 0.5) | (F.length(F.trim("text")) == 0) | F.col("text").isNull()))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of runs of lines; one of which nothing is left goes, one that was empty stays."""
    toxicity.release()  # the stage before has been written
    cut = linededup.dedup_lines(docs).where("deleted_lines = 0 or length(trim(text)) > 0")
    return _like_documents(cut.withColumn("n_chars", F.when(F.col("deleted_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles, that of the smallest doc_id.

    Documents without doc_id stay, as do those without words; of rows that share
    a doc_id all stay or go.
    """
    gone = hyperminhash.near_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return _like_documents(docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is drawn. Null and empty texts go with their block, repeated rows are drawn together."""
    return _like_documents(mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a drawn document in a window; a null or empty text is one end id."""
    return packing.pack(docs, tokens.public_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Scores and token ids are beyond SQL; a test holds run() and every stage against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = common.table(spark, sf_dir, "documents"), common.shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.materialize(stage(spark, docs, sf_dir), root, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
