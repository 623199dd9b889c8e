"""Deletion of repeated line runs, by the names of prefix doubling over line-ID sequences.

No suffix is sorted and no longest common prefix computed: equal runs are found
by grouping equal names, which are hashes of 128 bits.

A document is the sequence of IDs of its lines. Prefix doubling names every
suffix's first 1, 2, 4, ... lines: a name of twice the length is made of the
names of its two halves, so equal names are equal runs, wherever they stand.
Two suffixes are neighbours in an interval of the suffix array with a longest
common prefix of m lines if the names of their first m lines are equal; a run
of any length m is named by the two powers of two that cover it. As a run must
have ``min_words`` words to count, the array needs no more depth than that many
lines, however long a run is: a maximal repeated run is the union of the
smallest runs of that many words in it, and an interval's first suffix is the
copy that stays.

Lines that occur once end every repeated run, so only stretches of repeated
lines with enough words are kept for the array. All steps are DataFrame and SQL
functions. A line or run that a third of all documents share is summed up
before it is dealt, and the joins that bring sums back read tables, so Spark
can split them where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
WORDS = "[^\\\\x20\\\\x09-\\\\x0D]+"


def repeated_runs(docs: DataFrame, root: str, min_words: int = MIN_WORDS) -> DataFrame:
    """The later copies: doc_id, th (hash of the text), from_line, to_line, first_doc, first_from, first_to."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = rows.selectExpr("doc_id", "xxhash64(text) th", f"posexplode(filter(transform(split(text, '\\n', -1), (s, i) -> named_struct('line', i, 'words', regexp_count(s, '{WORDS}'), 'x', xxhash64(s), 'y', xxhash64(17, s))), s -> s.words > 0)) as (pos, s)")
    lines = common.materialize(lines.select("doc_id", "th", "pos", "s.line", "s.words", "s.x", "s.y"), root, "lines")
    twice = lines.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
    twice = common.materialize(twice, root, "twice")
    again = lines.join(twice, ["x", "y"]).repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "pos"])
    levels = range(min_words.bit_length())
    doc, seg = "partition by doc_id, th", "partition by doc_id, th, seg order by"
    stretch = again.selectExpr("*", f"pos - row_number() over ({doc} order by pos) seg")
    stretch = stretch.selectExpr("*", f"sum(words) over ({seg} pos) upto", "sum(words) over (partition by doc_id, th, seg) total").where(f"total >= {min_words}")
    stretch = stretch.selectExpr("*", "upto - words before", "named_struct('x', x, 'y', y) name0")
    for k in levels[:-1]:
        half = f"lead(name{k}, {1 << k}) over ({seg} pos)"
        stretch = stretch.selectExpr("*", f"{half} half").selectExpr("*", f"if(half is null, null, named_struct('x', xxhash64(name{k}.x, name{k}.y, half.x, half.y), 'y', xxhash64({k + 1}, half.y, half.x, name{k}.y, name{k}.x))) name{k + 1}").drop("half")
    # the fewest lines from here on, and up to here, that have enough words
    stretch = stretch.selectExpr("*", f"if(before + {min_words} <= total, count(1) over ({seg} before range between current row and {min_words - 1} following), null) ahead", f"if(upto >= {min_words}, count(1) over ({seg} upto range between {min_words - 1} preceding and current row), null) back")
    names = ", ".join(f"'name{k}', name{k}" for k in levels)
    packed = stretch.groupBy("doc_id", "th", "seg").agg(F.expr(f"array_sort(collect_list(named_struct('pos', pos, 'line', line, 'ahead', cast(ahead as int), 'back', cast(back as int), {names}))) as a"))
    starts = packed.selectExpr("doc_id", "th", "a", "array_distinct(concat(filter(transform(a, (s, i) -> named_struct('i', i + 1, 'm', s.ahead)), s -> s.m is not null), filter(transform(a, (s, i) -> named_struct('i', i + 2 - s.back, 'm', s.back)), s -> s.m is not null))) w")
    name = lambda at: "case " + " ".join(f"when m >= {1 << k} then element_at(a, {at(k)}).name{k}" for k in reversed(levels)) + " end"
    runs = starts.selectExpr("doc_id", "th", "a", "inline(w) as (i, m)").selectExpr("doc_id", "th", "m", "element_at(a, i).line from_line", "element_at(a, i + m - 1).line to_line", f"{name(lambda k: 'i')} n1", f"{name(lambda k: f'i + m - {1 << k}')} n2")
    runs = runs.selectExpr("doc_id", "th", "from_line", "to_line", "xxhash64(m, n1.x, n2.x) k1", "xxhash64(m, n1.y, n2.y) k2")
    runs = common.materialize(runs, root, "runs")
    common.discard(docs.sparkSession, root, "lines", "twice")
    firsts = runs.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "from_line", "to_line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", "first")
    firsts = common.materialize(firsts, root, "firsts")
    later = runs.join(firsts, ["k1", "k2"]).where("named_struct('d', doc_id, 'l', from_line) > named_struct('d', first.doc_id, 'l', first.from_line)")
    return later.selectExpr("doc_id", "th", "from_line", "to_line", "first.doc_id first_doc", "first.from_line first_from", "first.to_line first_to")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, root: str | None = None) -> DataFrame:
    """``docs`` without the later copies of line runs, and n_lines, deleted_lines and copied_from.

    A run is consecutive lines of a document, blank ones left out, with
    ``min_words`` words or more, that occurs elsewhere line by line; the copy
    of the smallest doc_id, and in it the smallest line, stays. Where copies
    within one document overlap, the first one's lines stay. copied_from is the
    smallest doc_id whose run a document repeats (null: none). A text of which
    nothing is left is empty. Null and empty texts, and rows without doc_id,
    stay as they are and repeat nothing. Repeated rows are one document and
    each loses the same lines. Other columns stay; columns called as the three
    added ones are replaced. An empty table gives no row.
    """
    root = root or common.shared_dir(docs.sparkSession)
    later = repeated_runs(docs, root, min_words)
    cut = later.selectExpr("doc_id", "th", "if(first_doc = doc_id, greatest(from_line, first_to + 1), from_line) a", "to_line b", "first_doc").where("a <= b")
    doc = "partition by doc_id, th order by a, b"
    island = cut.selectExpr("*", f"max(b) over ({doc} rows between unbounded preceding and 1 preceding) reach").selectExpr("*", f"sum(if(reach is null or a > reach + 1, 1, 0)) over ({doc} rows between unbounded preceding and current row) island")
    ranges = island.groupBy("doc_id", "th", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("first_doc").alias("first_doc"))
    cuts = ranges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("_cuts"), F.min("first_doc").alias("copied_from"))
    cuts = common.materialize(cuts.withColumnsRenamed({"doc_id": "_doc", "th": "_th"}), root, "cuts")
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "deleted_lines", "copied_from")]
    # the columns travel in a struct, so none can clash with those of the join
    others = [docs[c] for c in kept_columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("row"), docs["doc_id"].cast("long").alias("doc"), docs["text"].cast("string").alias("text"))
    met = packed.withColumn("hash", F.xxhash64("text")).join(cuts.hint("merge"), (F.col("doc") == F.col("_doc")) & (F.col("hash") == F.col("_th")), "left")
    split = met.withColumn("lines", F.expr("split(text, '\n', -1)"))
    left = split.withColumn("left", F.expr("if(_cuts is null, lines, filter(lines, (s, i) -> not exists(_cuts, c -> i between c.a and c.b)))"))
    out = left.withColumn("n_lines", F.expr("if(text is null, 0L, cast(size(lines) as bigint))")).withColumn("deleted_lines", F.expr("if(text is null, 0L, cast(size(lines) - size(left) as bigint))"))
    text = F.expr("if(_cuts is null, text, array_join(left, '\n'))")
    return out.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept_columns], "n_lines", "deleted_lines", "copied_from")


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of runs; nulls, empty texts and repeats as in ``dedup_lines``."""
    return dedup_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "deleted_lines", "copied_from")


#: What dedup_lines gives for ``documents`` (or the view ``{docs}``), in DuckDB's SQL.
SQL_OF = """
WITH l AS (SELECT doc_id, i - 1 AS line, string_split(text, chr(10))[i] AS s FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {docs} WHERE text IS NOT NULL)),
w AS (SELECT *, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
p AS (SELECT *, row_number() OVER d AS pos, CAST(sum(words) OVER d AS BIGINT) AS upto FROM w WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
ends AS (
  SELECT a.doc_id, a.pos AS p1, min(b.pos) AS p2 FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {w} WHERE b.upto - a.upto + a.words >= {w} GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.pos) AS p1, b.pos AS p2 FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.pos BETWEEN b.pos - {w} AND b.pos WHERE b.upto - a.upto + a.words >= {w} GROUP BY b.doc_id, b.pos),
runs AS (SELECT e.doc_id, p1, p2, min(line) AS a, max(line) AS b, string_agg(s, chr(10) ORDER BY pos) AS t FROM ends e JOIN p ON p.doc_id = e.doc_id AND pos BETWEEN p1 AND p2 GROUP BY 1, 2, 3),
first_run AS (SELECT t, min(doc_id) AS first_doc, arg_min(a, (doc_id, a)) AS first_a, arg_min(b, (doc_id, a)) AS first_b FROM runs GROUP BY t HAVING count(*) > 1),
cut AS (
  SELECT doc_id, CASE WHEN first_doc = doc_id THEN greatest(a, first_b + 1) ELSE a END AS a, b, first_doc FROM runs JOIN first_run USING (t) WHERE (doc_id, a) > (first_doc, first_a)),
gone AS (SELECT DISTINCT w.doc_id, w.line FROM w JOIN cut ON w.doc_id = cut.doc_id AND line BETWEEN cut.a AND cut.b),
stay AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, line) GROUP BY 1),
origin AS (SELECT doc_id, min(first_doc) AS copied_from FROM cut WHERE a <= b GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(stay.t, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE CAST(len(string_split(d.text, chr(10))) AS BIGINT) END AS n_lines,
       CASE WHEN d.text IS NULL THEN 0 ELSE CAST(len(string_split(d.text, chr(10))) - coalesce(stay.n, 0) AS BIGINT) END AS deleted_lines, copied_from
FROM {docs} d LEFT JOIN stay USING (doc_id) LEFT JOIN origin USING (doc_id)
"""
OP7_SQL = SQL_OF.format(docs="documents", w=MIN_WORDS)
