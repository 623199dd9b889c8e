import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import common, idstore, packing, tokens

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def ids_of(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_path(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_kept_words_give_the_same_ids(name):
    texts = ["", "  a  b\n\n c's 'S x", "Σας x　y z", "a\x1cb\x85c <|endoftext|> d<|endoftext|>", "I'LL don't  \t\n x", "a   b", "x" * 500, "日本語 テキスト 123"]
    texts += ["a. b\nc, d\n\ne", "\nx", "x\n", "x \ny", "ünï é's Ñandú,, ß!", "A\u00a0B x\u0301 y", "w" * 100 + " w?! w?! 1a a1,b", "\x1f", " ", "\n"]
    for kept in (3, 10**6):
        e = tokens.Encoder(tokens.public_path(name), kept_words=kept)
        assert e.encode(texts) == e._direct(texts) == e.encode(texts)


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_words_that_a_polynomial_hash_takes_for_equal(name):
    texts = []
    for n in (10, 11, 12):
        odd = [bin(k).count("1") % 2 for k in range(1 << n)]
        texts += ["".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)]
    e = tokens.Encoder(tokens.public_path(name))
    assert e.encode(texts) == e._direct(texts) and len(set(e.encode(texts))) == 6
    assert e.encode([" ".join(texts)]) == e._direct([" ".join(texts)])


def test_differencing_deals_each_item_once_and_evenly():
    sizes = np.random.default_rng(1).integers(1, 900, 400)
    bins = packing.differencing(sizes, 50)
    sums = np.bincount(bins, sizes, 50)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 60
    assert packing.deal(np.array([4000, 4000, 200]), 4096)[1] == 3  # two windows can't hold them


def test_packing(hard_docs, no_docs):
    rows = packing.pack(hard_docs, tokens.public_path(WORD)).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    copies = defaultdict(int)
    for d in hard_docs.select("doc_id", "text").collect():
        copies[d.doc_id] += 1
        ids = ids_of(WORD, d.text)
        mine = [r for r in pieces[d.doc_id] if r.doc_tokens == len(ids)]
        for r in mine:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        held = np.zeros(len(ids), int)
        for r in mine:
            held[r.start : r.start + r.length] += 1
        assert held.min() == held.max() > 0
    assert sum(r.length for r in rows) == sum(len(ids_of(WORD, d.text)) for d in hard_docs.select("text").collect())
    for ps in windows.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert packing.pack(no_docs, tokens.public_path(WORD)).count() == 0


def test_cuts_cover_and_depend_on_content_only():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50000, 20000).astype("<u4")
    cut = lambda x: idstore.cuts(idstore.boundaries(x)[: np.searchsorted(idstore.boundaries(x), len(x))].tolist(), len(x))
    ends = cut(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= idstore.MOST + idstore.LEAST and sizes.sum() == len(ids)
    moved = cut(np.concatenate([rng.integers(0, 50000, 333).astype("<u4"), ids]))
    assert len({e - 333 for e in moved} & set(ends)) > len(ends) // 2


def test_crc_parts_add_up():
    data = np.random.default_rng(4).integers(0, 255, 5000, dtype=np.uint8).tobytes()
    parts = [data[:7], data[7:1000], data[1000:]]
    behind = np.array([len(data) - 7, len(data) - 1000, 0])
    assert np.bitwise_xor.reduce(idstore.shifted(np.array([zlib.crc32(p) for p in parts]), behind)) == zlib.crc32(data)


def test_store_round_trip(spark, hard_docs, no_docs):
    root = common.shared_dir(spark)
    idstore.write_store(hard_docs, root, tokens.public_path(BYTE))
    docs = hard_docs.select("doc_id", "text").collect()
    want = sorted((d.doc_id is not None, d.doc_id or 0, len(ids_of(BYTE, d.text)), crc(ids_of(BYTE, d.text))) for d in docs)
    rows = idstore.read_digests(spark, root).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))
    whole = idstore.read_ids(spark, root).collect()
    assert sorted(crc(r.ids) for r in whole) == sorted(w[3] for w in want)
    chunks = spark.read.parquet(f"{root}/chunks").where("hash is not null")
    assert chunks.count() == chunks.select("hash").distinct().count()
    empty = common.shared_dir(spark)
    idstore.write_store(no_docs, empty, tokens.public_path(BYTE))
    assert idstore.read_digests(spark, empty).count() == 0


def test_a_changed_recipe_is_noticed(spark, hard_docs):
    root = common.shared_dir(spark)
    idstore.write_store(hard_docs.limit(5), root, tokens.public_path(BYTE))
    recipes = spark.read.schema(idstore.RECIPES_DDL).parquet(f"{root}/recipes")
    bad = recipes.selectExpr("doc_id", "row_id", "part", "start_in_part", "n_tokens", "reverse(array_append(hashes, unhex('00'))) hashes", "array_append(sizes, 0) sizes", "root", "part_root").collect()
    spark.createDataFrame(bad, idstore.RECIPES_DDL).write.mode("overwrite").parquet(f"{root}/recipes")
    with pytest.raises(Exception, match="root|missing"):
        idstore.read_digests(spark, root).collect()


def test_lost_or_replaced_recipes_and_manifests_are_noticed(spark, hard_docs):
    root = common.shared_dir(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # more recipe files than one
    try:
        store_root = idstore.write_store(hard_docs, root, tokens.public_path(BYTE))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.schema(idstore.RECIPES_DDL).parquet(f"{root}/recipes").collect()
    parts = sorted({r.part for r in rows})
    assert len(parts) > 1 and [p for p, _, _ in idstore.verified_parts(spark, root, store_root)] == parts
    lost = [r for r in rows if r.part != parts[-1]]
    other = [r if r.doc_id != 20 else (21, *r[1:]) for r in rows]
    for bad in (lost, other):
        spark.createDataFrame(bad, idstore.RECIPES_DDL).write.mode("overwrite").parquet(f"{root}/recipes")
        with pytest.raises(Exception, match="root"):
            idstore.read_digests(spark, root).collect()
    spark.createDataFrame(rows, idstore.RECIPES_DDL).write.mode("overwrite").parquet(f"{root}/recipes")
    assert idstore.read_digests(spark, root, store_root).count() == hard_docs.count()
    with pytest.raises(ValueError, match="root"):
        idstore.read_digests(spark, root, "0" * 64)
    manifest = spark.read.parquet(f"{root}/manifest").where(f"part <> {parts[-1]}").collect()
    spark.createDataFrame(manifest, "part int, n_tokens long, part_root binary").write.mode("overwrite").parquet(f"{root}/manifest")
    with pytest.raises(ValueError, match="root"):
        idstore.read_digests(spark, root)
