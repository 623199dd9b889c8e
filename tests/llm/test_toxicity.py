import collections
import functools
import pickle
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import tokens, toxicity

ORDINARY = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta", "wo", "zi") for b in ("bar", "den", "fil", "gor", "hum", "jet", "pol", "sin")]
TOXIC = ["grubface", "grubnose", "grubfoot", "grubhead"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(ORDINARY) for _ in range(rng.randint(8, 120))]
        toxic = i % 6 == 0
        for _ in range(max(1, len(words) // 40) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    labels += [(5, 0), (None, 1), (7, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs.where(toxicity.fold("doc_id") == 0), model).join(labels.where("toxic is not null").distinct(), "doc_id").collect()
    assert len(held) > 150
    assert np.mean([(r.toxicity_score >= 0.5) == bool(r.toxic) for r in held]) > 0.97


def test_learns_only_from_other_folds_and_never_from_labels_columns(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert np.array_equal(model.orders[0].share, again.orders[0].share) and np.array_equal(model.curve, again.curve)
    assert spark.range(20).select(toxicity.fold("id").alias("f"), "id").where("f = 0").count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(20))


def test_new_members_of_a_toxic_family_are_likelier_toxic(corpus):
    model = toxicity.fit(*corpus)
    new, plain = model.evidence(pa.array(["grubworm", "kawonder"]))
    assert new[0] > plain[0]


def test_words_and_their_beginnings():
    data = np.frombuffer(b"Ab,cd ab grubworms grubworm", np.uint8)
    (word, long, *short), first = toxicity.words_of(data, np.array([0, 3, 8, 27]))
    assert first.tolist() == [0, 1, 3, 5] and word[0] == word[2] != word[1]
    assert word[3] != word[4] and long[3] == long[4] and all(x[3] == x[4] for x in short)


def brute_force(texts, toxic):
    """Modified Kneser-Ney over a word and its first 7, 5 and 4 bytes in dictionaries: the probability of a word by class."""
    words = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode().lower())
    cut = [lambda w: w, lambda w: w[:7], lambda w: w[:5], lambda w: w[:4]]
    tables = [[collections.Counter(), collections.Counter()] for _ in cut]
    for t, c in zip(texts, toxic):
        tables[0][c].update(set(words(t)))
    for k in (1, 2, 3):
        for c in (0, 1):
            tables[k][c].update(cut[k](x) for x in tables[k - 1][c])
    both = [collections.defaultdict(lambda: 0.5, {x: t[0][x] + t[1][x] + 0.5 for x in t[0] | t[1]}) for t in tables]

    def p(word, c):
        slots = 1 << toxicity.ORDERS[-1][1]
        out = both[3][cut[3](word)] / (sum(both[3].values()) + 0.5 * (slots - len(tables[3][0] | tables[3][1])))
        for k in (3, 2, 1, 0):
            counts, x = tables[k][c], cut[k](word)
            n = [sum(v == i for v in counts.values()) for i in range(6)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            d = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1 * i), 0.95 * i) if n[i] else 0.75 * i for i in (1, 2, 3)]
            freed = sum(d[min(v, 3)] for v in counts.values()) / sum(counts.values())
            if k < 3:
                out *= both[k][x] / (0.5 + sum(v for z, v in list(both[k].items()) if (tables[k][0] | tables[k][1])[z] and cut[k + 1](z) == cut[k + 1](x)))
            out = max(counts[x] - d[min(counts[x], 3)], 0) / sum(counts.values()) + freed * out
        return out

    return functools.cache(p)


def test_probabilities_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["grubface", "grubfaces", "plain", "other", "Éther", "éthers"]) + rng.choice(["", "", "x", "yy"]) for _ in range(12)) for _ in range(60)]
    toxic = [int("grubfacey" in t) for t in texts]
    p = brute_force(texts, toxic)
    counted = pa.Table.from_batches(toxicity._counted([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(toxic, pa.int32())], names=["text", "toxic"])]))
    model = toxicity.Model({k: counted[k].to_numpy() for k in counted.column_names})
    for word in ("grubface", "grubfaceyy", "plain", "grubfacezz", "grubxx", "never", "éthersx"):
        data = np.frombuffer(word.encode(), np.uint8)
        got = model.probabilities(toxicity.words_of(data, np.array([0, len(data)]))[0])[0]
        assert got == pytest.approx([p(word.encode(), 0), p(word.encode(), 1)], rel=1e-4)
    whole = model.low.sum(0, dtype=np.float64)
    assert whole == pytest.approx([1, 1], abs=1e-3)


def test_hard_documents(spark, hard_docs, no_docs, corpus):
    model = toxicity.fit(*corpus)
    rows = toxicity.score(hard_docs.withColumn("toxicity_score", F.lit("mine")).withColumn("score", F.lit(3)), model).collect()
    assert len(rows) == hard_docs.count() and {r.score for r in rows} == {3} and all(0 <= r.toxicity_score <= 1 for r in rows)
    assert len({r.toxicity_score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score(no_docs, model).count() == 0
    empty = toxicity.fit(hard_docs.limit(0), corpus[1].limit(0))
    assert {r.toxicity_score for r in toxicity.score(hard_docs, empty).collect()} == {0.5}


def test_the_curve_never_falls():
    x = np.random.default_rng(0).standard_normal((200, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    assert (toxicity.logistic(x, y)[1:] >= 0).all() and toxicity.logistic(x, y * 0).tolist() == [0, 0, 0]


def test_a_bounded_sample_of_the_curve_keeps_the_classes_shares(spark, corpus):
    docs, labels = corpus
    # evidence of blanks is zero, so the curve's value there is the share of toxic labels
    blank = docs.withColumn("text", F.when(toxicity.fold("doc_id") == toxicity.CURVE_FOLD, "").otherwise(F.col("text")))
    held = labels.where("doc_id is not null and toxic is not null").where(toxicity.fold("doc_id") == toxicity.CURVE_FOLD).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = held.agg(F.avg("toxic")).first()[0]
    for most in (20, 100_000):
        assert 1 / (1 + np.exp(-toxicity.fit(blank, labels, curve_sample=most).curve[0])) == pytest.approx(share, abs=1e-3)


def test_all_eligible_labelled_documents_are_counted(spark):
    docs = spark.range(36_000).selectExpr("id as doc_id", "'plain words' as text")
    labels = spark.range(36_000).selectExpr("id as doc_id", "int(id % 50 = 0) as toxic")
    word = toxicity.words_of(np.frombuffer(b"plain", np.uint8), np.array([0, 5]))[0][0][0]
    rows = toxicity.fit(docs, labels).rows
    n = {int(t): int(n) for t, w, n in zip(rows["toxic"], rows["slot0"], rows["n"]) if w == word}
    eligible = [i for i in range(36_000) if zlib.crc32(str(i).encode()) % 5 not in (0, toxicity.CURVE_FOLD)]
    assert n == {1: sum(i % 50 == 0 for i in eligible), 0: sum(i % 50 != 0 for i in eligible)} and n[0] > 20_000


def test_a_worker_builds_the_model_in_little_memory_and_drops_what_others_kept():
    n, bits = 1_000_000, toxicity.ORDERS[0][1]
    rng = np.random.default_rng(1)
    key = rng.choice(2 << bits, n, replace=False)
    slots = [key >> 1, *(rng.integers(0, 1 << b, 1 << bits)[key >> 1] for _, b in toxicity.ORDERS[1:])]
    model = toxicity.Model({"toxic": (key & 1).astype(np.int8), "n": rng.integers(1, 9, n).astype(np.int32)} | {c: s.astype(np.int32) for c, s in zip(toxicity.SLOTS, slots)})
    sent = pickle.dumps(model)
    assert len(sent) < 25 * n  # counts without tables
    tokens.encoder(tokens.public_path("word_bpe_49k.json")).encode(["some words"])
    tracemalloc.start()
    try:
        got = pickle.loads(sent)
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert not tokens._ENCODERS and not got.rows
    tables = sum(x.nbytes for o in got.orders for x in (o.share, o.both)) + sum(x.nbytes for x in got.of) + got.low.nbytes
    assert now < tables + (1 << 20) and most < tables + 66 * n


def test_the_model_is_sent_once_until_it_is_released(spark, corpus):
    toxicity.release()
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    given = model.given
    first = toxicity.score(docs, model).collect()
    assert model.given is given and toxicity._SENT == [model] and "orders" not in vars(model)
    toxicity.release()
    assert model.given is None and not toxicity._SENT
    assert toxicity.score(docs, model).collect() == first
    assert [r.toxicity_score for r in first] == model.scores(pa.array([r.text for r in first])).tolist()
    toxicity.release()
