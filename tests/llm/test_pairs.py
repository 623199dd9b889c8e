import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tessera.llm import common, components, hyperminhash, linededup, textwords, topk, vecdedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORDS.findall((text or "").translate(ASCII))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def joined(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 440)] + [(None, 3)]
    want = joined({x for l in links for x in l if x is not None}, [l for l in links if None not in l])
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(3), common.shared_dir(spark), "g", local).collect()
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {n: c for n, c in want.items() if n in linked} and len(got) == len(linked)


def test_shingle_sets_are_whole_texts_and_ascii_case_only():
    import pyarrow as pa

    texts = ["a b c d e", "A B c D e", None, "", "one", "é É x y z", "É é x y z", "x" * 2_000_000 + " b c d e", "a\tb\x0bc d e"]
    sets = [s.tolist() for s in textwords.shingle_sets(pa.array(texts), 4)]
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for t in texts]
    assert sets[0] == sets[1] == sets[8] and sets[5] != sets[6]


def test_shingles_that_a_polynomial_hash_takes_for_equal():
    import pyarrow as pa

    odd = [bin(k).count("1") % 2 for k in range(1 << 12)]
    texts = ["".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)]
    for which in (0, 1):
        x, y = textwords.shingle_sets(pa.array(texts), 4, which)
        assert x[0] != y[0]
    x, y = textwords.exact_shingles(*texts, 4)
    assert len(x) == len(y) == 1 and x[0] != y[0]


@given(st.lists(st.sampled_from(["a", "A", "b", "\x1c", "é", "É", "cc"]), max_size=14), st.lists(st.sampled_from(["a", "b", "é", "cc"]), max_size=14), st.integers(1, 5))
@settings(deadline=None, max_examples=300)
def test_exact_shingles(a, b, width):
    a, b = " ".join(a), "\t".join(b)
    x, y = textwords.exact_shingles(a, b, width)
    p, q = shingles(a, width), shingles(b, width)
    assert (len(x), len(y), len(np.intersect1d(x, y))) == (len(p), len(q), len(p & q))


def test_registers_order_and_estimate():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    sets = [np.sort(x[:3000]), np.sort(x[600:3600])]
    least = np.array([hyperminhash.minima(s) for s in sets])
    regs = hyperminhash.compressed(least, least == hyperminhash._EMPTY)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    n = np.array([3000])
    assert abs(hyperminhash.estimate(regs[:1], regs[1:], n, n)[0] - true) < 0.15
    lone = hyperminhash.compressed(np.full((1, 128), hyperminhash._EMPTY), np.ones((1, 128), bool))
    assert hyperminhash.estimate(lone, lone, n, n)[0] == 0


@pytest.mark.parametrize("block", [hyperminhash.BLOCK, 2])
def test_hyperminhash_against_brute_force(spark, hard_docs, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    monkeypatch.setattr(hyperminhash, "ASKS", 2 * block)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):  # a chain of near copies, each with a word of the one before it changed
        base[rng.randrange(60)] = f"x{i}"
        rows.append(Row(doc_id=1000 + i, text=" ".join(base)))
    docs = hard_docs.select("doc_id", "text", "hash", "n", "key").unionByName(spark.createDataFrame(rows), allowMissingColumns=True)
    sets = {d.doc_id: shingles(d.text, 4) for d in docs.select("doc_id", "text").collect() if d.doc_id is not None}
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = joined(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and linked(sets[a], sets[b])])
    got = hyperminhash.near_duplicates(docs, width=4).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
        else:
            assert not r.kept
    assert len({want[d] for d in range(1000, 1060)}) < 60


def sketched(texts, width=4):
    import pyarrow as pa

    n = len(texts)
    rows = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array([0] * n, pa.int64())], names=["doc_id", "text", "th"])
    return next(hyperminhash._sketch(iter([rows]), width))


def buckets(texts):
    import pyarrow as pa

    batch = sketched(texts)
    rows = pa.RecordBatch.from_arrays([batch["doc_id"], batch["registers"]], names=["node", "registers"])
    keys = np.concatenate([b["key"].to_numpy() for b in hyperminhash._bands(iter([rows]))])
    return np.unique(keys, return_counts=True)[1]


def test_a_frequent_passage_of_short_texts_makes_no_bucket_of_all_of_them():
    rng = random.Random(7)
    texts = [" ".join(["some", "words", "that", "many", "texts", "share"] + [f"w{rng.randrange(10**6)}" for _ in range(20)]) for _ in range(1500)]
    assert buckets(texts).max() < 30


def test_short_texts_at_the_bound_share_a_band():
    rng = random.Random(8)
    for n in (4, 8, 12, 20, 40, 90):  # one of n shingles, one of as many and some more
        both = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(n + 3)) for _ in range(200)]
        more = [t + "".join(f" x{rng.randrange(10**9)}" for _ in range(n // 4)) for t in both]
        regs = [hyperminhash.filled(hyperminhash._registers(sketched(t)["registers"])) for t in (both, more)]
        assert all(hyperminhash._first_shared(a, b[None])[0] >= 0 for a, b in zip(*regs))


@pytest.mark.parametrize("top", [0, 2])
def test_samples_compared_at_once(top):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, 500 << top, dtype=np.uint32)
    sets = [np.unique(np.concatenate([rng.choice(base, k << top, False), rng.integers(0, 1 << 32, (500 - k) << top, dtype=np.uint32)])) for k in range(380, 500, 3)]
    sets += [s[: len(s) * 9 // 10] for s in sets[::5]]
    n = np.array([len(s) for s in sets])
    cut = np.array([s[s & np.uint32((1 << hyperminhash.level(len(s))) - 1) == 0].tobytes() for s in sets], object)
    for some in (np.arange(len(sets)), np.array([3, 1])):
        got = hyperminhash._Sets(cut, n).near(cut[0], int(n[0]), some, 0.8)
        for j, ok in zip(some, got):
            level = max(hyperminhash.level(int(n[0])), hyperminhash.level(int(n[j])))
            x, y = ({int(v) for v in sets[k] if int(v) % (1 << level) == 0} for k in (0, j))
            slack = hyperminhash.MARGIN * math.sqrt(0.16 / len(x | y)) if level else 0
            assert ok == (len(x & y) / len(x | y) >= 0.8 - slack - 0.01)


def test_forest_takes_the_best_links():
    rng = np.random.default_rng(5)
    e, x, y = rng.random(3000), rng.integers(0, 200, 3000), rng.integers(0, 200, 3000)
    kept = hyperminhash._forest(e, x, y)
    top, want = {k: k for k in range(200)}, []
    for k in np.argsort(-e):
        a, b = x[k], y[k]
        while top[a] != a:
            a = top[a]
        while top[b] != b:
            b = top[b]
        if a != b:
            top[a] = b
            want.append(k)
    assert sorted(kept.tolist()) == sorted(want)


def test_near_copies_of_long_texts_are_not_lost(spark):
    rng = random.Random(6)
    rows, want = [], []
    for i in range(30):  # some 3000 shingles, similarity between 0.8 and 0.85
        words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        copy = list(words)
        while True:
            trial = list(copy)
            for k in rng.sample(range(3000), 10):
                trial[k] = f"x{rng.randrange(10**6)}"
            a, b = shingles(" ".join(words), 4), shingles(" ".join(trial), 4)
            if 100 * len(a & b) < 80 * len(a | b):
                break
            copy = trial
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        want += [2 * i, 2 * i]
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert [got[i] for i in range(60)] == want


def test_samples_of_sets_leave_links_possible():
    rng = np.random.default_rng(3)
    for _ in range(400):
        both = rng.integers(0, 1 << 32, 5000, dtype=np.uint32)
        x, y = np.unique(both[:4500]), np.unique(np.concatenate([both[:4000], both[4500:]]))  # a similarity of 0.8
        n, m = len(x), len(y)
        cut = lambda v, k: v[v & np.uint32((1 << hyperminhash.level(k)) - 1) == 0].tobytes()
        assert hyperminhash._near(cut(x, n), cut(y, m), n, m, 0.8)


def test_rows_of_one_doc_id_with_different_texts(spark):
    base, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, base + " z"), (2, base), (2, other), (3, other + " z"), (4, base), (None, other)]
    runs = [sorted(map(repr, hyperminhash.near_duplicates(spark.createDataFrame(rows[::way], "doc_id long, text string").repartition(n), width=4).collect())) for way, n in ((1, 1), (-1, 3))]
    assert runs[0] == runs[1] and len(runs[0]) == 6


def test_near_duplicates_of_nothing(no_docs):
    assert hyperminhash.near_duplicates(no_docs).count() == 0
    assert linededup.dedup_lines(no_docs).count() == 0


def test_line_runs(spark, hard_docs):
    run = "\n".join(f"line {k} of a passage that repeats" for k in range(9))  # 7 words each
    short = "\n".join(f"line {k} too short" for k in range(5))
    twice = "\n".join(f"in one text {k} " + "w " * 20 for k in range(4))
    texts = [f"start\n{run}\nend", f"{short}\nother\n\n{run}", f"{run[:-3]}\n{short}", f"{twice}\nmid\n{twice}", "\n".join(["same line"] * 80), run, "a\n\n\nb", None, ""]
    docs = spark.createDataFrame([(i + 1, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs.union(docs.where("doc_id = 6"))).distinct().collect()}
    assert got[1].text == texts[0] and got[1].copied_from is None
    assert got[2].text == f"{short}\nother\n" and got[2].copied_from == 1 and got[2].deleted_lines == 9
    assert got[3].text == f"line 8 of a passage that repe\n{short}".replace("repe", texts[2].split("\n")[8][-4:]) and got[3].deleted_lines == 8
    assert got[4].text == f"{twice}\nmid"
    assert got[5].text == "\n".join(["same line"] * 25)
    assert (got[6].text, got[6].deleted_lines) == ("", 9)
    assert got[7].text == texts[6] and got[8].text is None and got[9].text == ""
    odd = docs.selectExpr("*", "1 as _hash", "2 as _doc", "3 as _th", "4 as _cuts", "5 as _lines", "6 as _left", "7 as lines", "8 as doc")
    assert {(r._hash, r._doc, r._th, r._cuts, r._lines, r._left, r.lines, r.doc) for r in linededup.dedup_lines(odd).collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}
    hard = linededup.dedup_lines(hard_docs.withColumn("n_lines", hard_docs["n"]))
    assert hard.count() == hard_docs.count() and hard.where("doc_id is null and deleted_lines > 0").count() == 0


HARD_VECTORS = [
    (0, [1.0, 0.0, 0.5]), (50, [0.9, 0.1, 0.5]), (100, None), (150, [None, 1.0, 2.0]), (200, [float("nan"), 0.0, 1.0]), (250, [float("inf"), 0.0, 1.0]),
    (300, [0.0, 0.0, 0.0]), (350, [1.0, 2.0]), (351, [2.0, 4.0]), (None, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (400, []), (2, [-1.0, 0.0, 0.5]),
]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    many = rng.standard_normal((400, 3))
    rows = HARD_VECTORS + [(1000 + i, [float(x) for x in v]) for i, v in enumerate(many)]
    return spark.createDataFrame([(i, v, "k", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, rank int").repartition(3)


def usable_of(vectors):
    rows = {r.vec_id: r.embedding for r in vectors.select("vec_id", "embedding").collect() if r.vec_id is not None}
    return {i: np.array(v, float) for i, v in rows.items() if v and None not in v and np.isfinite(np.array(v, float)).all()}


def test_top_k(spark, vectors):
    ok = {i: np.floor(256 * v) for i, v in usable_of(vectors).items()}
    want = set()
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for rows in (topk.SHARD_ROWS, 60):
        got = [tuple(r) for r in topk.top_k(vectors, shard_rows=rows, query_rows=4).collect()]
        assert len(got) == len(want) and set(got) == want
    assert topk.top_k(vectors.where("false")).count() == 0


def test_shards_of_far_groups_are_left_out(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((8, 16)) * 4
    x = np.concatenate([centers[i % 8] + rng.standard_normal((1, 16)) * 0.2 for i in range(1600)])
    nodes = topk.splits(np.floor(256 * x), 16)
    leaves = topk.leaf_of(np.floor(256 * x), nodes)
    assert np.bincount(leaves).max() < 250 and len(set(leaves)) == 16
    assert topk.splits(np.ones((50, 3)), 4) == [] and set(topk.leaf_of(np.ones((5, 3)), [])) == {0}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, shard_rows=100).collect()}
    m = np.floor(256 * x)
    for q in range(0, 1600, 50):
        best = sorted((-int(m[q] @ m[i]), i) for i in range(1600) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_vector_near_duplicates(spark, vectors):
    ok = {i: v / np.linalg.norm(v) for i, v in usable_of(vectors).items() if np.linalg.norm(v)}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9]
    ids = {r.vec_id for r in vectors.collect() if r.vec_id is not None}
    top = joined(ids, links)
    for rows in (vecdedup.TILE_ROWS, 100):
        got = vecdedup.near_duplicates(vectors, tile_rows=rows).collect()
        assert len(got) == vectors.count()
        n = {i: sum(i in l for l in links) for i in ids}
        found = sum(r.n_links for r in got if r.vec_id is not None) / max(1, sum(n[r.vec_id] for r in got if r.vec_id is not None))
        assert 0.99 <= found <= 1
        assert all(r.n_links <= n[r.vec_id] and r.kept == (r.component_id == r.vec_id) for r in got if r.vec_id is not None)
        assert np.mean([r.component_id == top[r.vec_id] for r in got if r.vec_id is not None]) > 0.99
    assert vecdedup.near_duplicates(vectors.where("false")).count() == 0


@pytest.mark.parametrize("dim", [64, 384])
def test_planted_pairs_at_the_bound_in_many_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.standard_normal((900, dim)))
    t, z = rng.uniform(0.9, 0.92, 300), rng.standard_normal((300, dim))
    z = unit(z - (z * x[:300]).sum(1)[:, None] * x[:300])
    near = t[:, None] * x[:300] + np.sqrt(1 - t * t)[:, None] * z
    group = unit(x[899] + rng.standard_normal((300, dim)) * 0.1 / np.sqrt(dim))  # near copies of one another
    rows = np.concatenate([x, near, group])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    exact = unit(rows) @ unit(rows).T >= 0.9
    want = exact.sum(1) - 1
    got = {r.vec_id: r for r in vecdedup.near_duplicates(df, tile_rows=400).collect()}
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all() and found.sum() / want.sum() >= 0.99 and found[:300].sum() / want[:300].sum() >= 0.99
    assert {got[i].component_id for i in range(1200, 1500)} == {899} and sum(got[i].component_id == i - 900 for i in range(900, 1200)) >= 297


def test_vectors_are_not_shipped_for_each_pair_of_tiles(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4000, 64))
    x[3900:] = x[:100] + rng.standard_normal((100, 64)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in (context.statusStore().executorList(False).apply(k) for k in range(context.statusStore().executorList(False).size())))

    before = shuffled()
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdedup.near_duplicates(df, tile_rows=100).collect()}
    assert shuffled() - before < 3 * x.nbytes
    assert got == {i: (int(i < 100 or i >= 3900), i - 3900 if i >= 3900 else i) for i in range(4000)}


def test_sides_of_pairs_at_the_bound():
    rng = np.random.default_rng(12)
    x, z = rng.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
    words = [np.packbits(v @ vecdedup.sides_of(64) > 0, axis=1).view(np.uint64) for v in (x, y)]
    found = [np.concatenate(part) for part in zip(*vecdedup.candidates(*words, vecdedup.apart_at_most(0.9, 0.9999)))]
    assert (found[0] == found[1]).sum() >= 3998 and len(found[0]) < 4010


def test_needed_collisions_keep_the_recall():
    least = vecdedup.needed(16, 2.5, 0.9999)
    p = math.erf(2.5 / math.sqrt(2))
    assert sum(math.comb(16, k) * p**k * (1 - p) ** (16 - k) for k in range(least, 17)) >= 0.9999
