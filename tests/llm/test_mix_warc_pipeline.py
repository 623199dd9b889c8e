import collections
import gzip
import hashlib
import io
import itertools
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, linededup, mixing, toxicity, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_stop_at_twice_a_source_and_share_out_the_rest():
    goal = mixing.targets({"a": 100, "b": 1000, None: 300})
    assert goal["a"] == 200 and sum(goal.values()) == pytest.approx(2100) and goal[None] == 600 and goal["b"] == pytest.approx(1300)
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_splitting_tree_keeps_every_quota():
    quotas = np.array([7, 0, 1000, 33])
    leaves = mixing.split(quotas, 13, np.random.default_rng(1))
    assert leaves.shape == (13, 4) and (leaves.sum(0) == quotas).all() and (leaves >= 0).all() and np.ptp(leaves.sum(1)) <= 1


def recount(docs, mixed):
    """Words by source of the documents and of what was drawn of them, from the texts themselves."""
    size = lambda t: len(WORDS.findall(t or ""))
    out = []
    for df in (docs, mixed):
        n = collections.Counter()
        for r in df.select("source", "text").collect():
            n[r.source] += size(r.text)
        out.append(n)
    return out


def test_mixing_hard_documents(spark, hard_docs, no_docs):
    odd = hard_docs.selectExpr("*", "7 as target", "8 as size", "9 as _k", "'x' as draws", "1 as _at", "2 as _s", "3 as row")
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.where("target = 7 and size = 8 and _k = 9 and draws = 'x'").count() == mixed.count()
    sizes, taken = recount(odd, mixed)
    goal = mixing.targets(dict(sizes))
    largest = max(len(WORDS.findall(r.text or "")) for r in odd.collect())
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest / 2
    times = collections.Counter((r.doc_id, r.source, r.text) for r in odd.collect())
    drawn = collections.Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    assert all(n <= 2 * times[k] for k, n in drawn.items())
    assert drawn == collections.Counter((r.doc_id, r.source, r.text) for r in mixing.mix(odd.repartition(5)).collect())
    assert mixing.mix(no_docs).count() == 0


def test_mixing_is_near_its_targets_and_a_shard_is_a_partition(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{i % 3}", " ".join(["w"] * int(rng.integers(1, 60) if i % 50 else 900))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op9_mix_sources(spark, str(tmp_path)).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        assert r.size == len(rows[r.doc_id][2].split()) and r.taken in (0, r.size, 2 * r.size)
        sizes[rows[r.doc_id][1]] += r.size
        taken[rows[r.doc_id][1]] += r.taken
    goal = mixing.targets(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= 3 for s in sizes) and {r.target for r in out} == set(goal.values())
    mixed = mixing.mix(docs, shards=6)
    assert recount(docs, mixed)[1] == taken  # the tree deals draws; it doesn't change them
    per = [sum(len(r.text.split()) for r in p) for p in mixed.rdd.glom().collect()]
    assert len(per) == 6 and min(per) > 0.5 * max(per)  # few documents, some of them long
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert recount(docs, mixing.mix(docs, shards=6))[1] == taken


def pages(spark):
    html = ["<p>" + "é" * 60, None, "", "short", "short", "x" * 200000]
    rows = [(i, f"http://a/{i} %b", html[i % 6]) for i in range(40)] + [(3, None, "<p>" + "é" * 60), (None, "u", "y" * 100), (7, "u", "y" * 100)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' digest", "1 refers_to").repartition(3)


def test_warc_round_trip(spark):
    src = pages(spark)
    root = common.shared_dir(spark)
    got = warc.read_archives(warc.write_archives(src, root, segment_bytes=5000)).collect()
    first = {}
    for r in src.where("page_id is not null and octet_length(html) >= 100").collect():
        first[r.html] = min(first.get(r.html, 1 << 60), r.page_id)
    want = collections.Counter()
    for r in src.collect():
        raw = (r.html or "").encode()
        to = first.get(r.html) if r.page_id is not None and r.page_id > first.get(r.html, 1 << 60) else None
        want[r.page_id, r.url, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to, raw if to is None else None] += 1
    assert collections.Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.read_archives(warc.write_archives(src.limit(0), common.shared_dir(spark))).count() == 0


def test_zip_directories_of_both_kinds(monkeypatch):
    def archive(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for i in range(n):
                z.writestr(f"m{i}", bytes([i % 256]) * (i % 7))
            z.comment = b"a note PK\5\6 inside"
        return pa.BufferReader(out.getvalue())

    assert [(m.name, m.size) for m in warc.members(archive(5))] == [(f"m{i}", i % 7) for i in range(5)]
    assert len(warc.members(archive(70000))) == 70000  # more than a plain directory can count
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    f = archive(60)
    found = warc.members(f)
    assert f.read_at(found[9].size, warc.data_at(f, found[9])) == bytes([9]) * 2
    with pytest.raises(ValueError):
        warc.members(pa.BufferReader(b"no archive at all"))


def test_broken_payloads_are_found():
    good = warc.record(1, "u", b"x" * 150, hashlib.sha256(b"x" * 150).hexdigest(), None)
    assert warc.parsed(good)[6] == b"x" * 150
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"xxx", b"xyx", 1))
    assert zlib.decompress(zlib.compress(good)) == good


def test_archives_are_named_indexed_and_described(spark):
    root = common.shared_dir(spark)
    made = warc.write_archives(pages(spark).coalesce(1), root, segment_bytes=5000, date="2020-02-03T04:05:06Z").collect()
    assert warc.url_key("HTTP://Www.Example.com:80/a b?q=1#x") == "com,example,www)/a%20b?q=1" and warc.url_key(None) == "-"
    with zipfile.ZipFile(made[0].path.removeprefix("file://")) as z:
        names = z.namelist()
        segments = [n for n in names if n.endswith(".warc.gz")]
        ids, lines = [], 0
        for n in segments:
            index = z.read(n.replace("archive/", "indexes/").replace(".warc.gz", ".cdxj")).decode().splitlines()
            assert index == sorted(index) and all(line.split(" ")[1] == "20200203040506" for line in index)
            lines += len(index)
            data = gzip.decompress(z.read(n))
            assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.count(b"WARC-Type: warcinfo") == 1
            ids += re.findall(rb"WARC-Record-ID: (\S+)", data)
        whole = b"".join(gzip.decompress(z.read(n)) for n in segments)
    assert lines == pages(spark).count() and len(ids) == len(set(ids)) == lines + len(segments)
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", whole)) <= set(ids)


def test_pipeline_stages(spark, hard_docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    filler = [(1000 + i, " ".join(f"w{(i * 37 + j) % 900}" for j in range(80)), "en", f"s{i % 3}", 1) for i in range(60)]
    copy = [(2000, filler[0][1], "en", "s0", 1), (2001, filler[1][1].replace("w40 ", "v40 "), "en", "s1", 1)]
    toxic = [(3000 + i, " ".join([*filler[i][1].split()[:40], "grubface grubnose grubfoot"]), "en", "s2", 1) for i in range(60)]
    docs = spark.createDataFrame(filler + copy + toxic, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 0) for r in filler] + [(r[0], 1) for r in toxic], "doc_id long, toxic int")
    docs.union(hard_docs.select(docs.columns)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = common.materialize(stage(spark, step, str(tmp_path)), f"file://{tmp_path}", f"s{len(kept)}")
        assert step.columns == docs.columns
        kept.append({r.doc_id for r in step.collect()})
    clean = {r[0] for r in filler}
    assert clean <= kept[0] and not {r[0] for r in toxic} & kept[0]
    assert clean <= kept[1] and 2000 not in kept[1] and clean <= kept[2] and 2001 not in kept[2] and kept[3] <= kept[2]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == kept[3]
    filled = collections.Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 4096


def pipeline_corpus(rng):
    """Documents with toxic ones, shared passages, near copies, empty texts, and sources of different sizes."""
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("bar", "den", "fil") for c in ("", "us", "or", "et")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = "\n".join(line(14) for _ in range(5))
    docs, labels = [], []
    for i in range(240):
        lines = [line(rng.randint(4, 16)) for _ in range(rng.randint(1, 9))]
        if i % 12 == 3:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        if toxic := i % 6 == 0:
            at = rng.randrange(len(lines))
            lines[at] = lines[at] + " " + " ".join(rng.choice(["grubface", "grubnose", "grubfoot"]) for _ in range(3))
        text = "\n".join(lines)
        if i % 17 == 5:
            text = docs[-1][1].replace(docs[-1][1].split()[0], "other", 1)  # a near copy of the one before
        docs.append((i, text, "en", f"s{min(i % 5, 2)}", len(text)))
        labels.append((i, int(toxic)))
    docs += [(500, "", "en", "s0", 0), (501, None, None, None, None), (502, " \n ", "en", "s1", 3)]
    return docs, labels


def test_pipeline_against_plain_versions_of_its_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    duckdb = pytest.importorskip("duckdb")
    from test_pairs import joined, shingles
    from test_tokens import WORD, crc, ids_of
    from test_toxicity import brute_force

    docs, labels = pipeline_corpus(random.Random(4))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        step = common.materialize(stage(spark, step, str(tmp_path)), f"file://{tmp_path}", f"stage-{k}")
        kept.append([(r.doc_id, r.text, r.source) for r in step.collect()])

    # toxicity: dictionaries instead of tables, a loop instead of Arrow
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    text = {d[0]: d[1] or "" for d in docs}
    counted = [(text[i], c) for i, c in labels if fold(i) not in (0, toxicity.CURVE_FOLD)]
    p = brute_force(*zip(*counted))

    def evidence(t):
        d = [math.log(p(w, 1) / p(w, 0)) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode().lower())]
        return [sum(d) / max(1, len(d)), sum(max(0, x - toxicity.EXCESS) for x in d) / max(1, math.sqrt(len(d)))]

    curve = [(evidence(text[i]), c) for i, c in labels if fold(i) == toxicity.CURVE_FOLD]
    b = toxicity.logistic(np.array([e for e, _ in curve]), np.array([c for _, c in curve], float))
    clean = [d[0] for d in docs if not text[d[0]].strip() or b[0] + np.dot(b[1:], evidence(text[d[0]])) < 0]
    assert sorted(r[0] for r in kept[0]) == sorted(clean) and len(clean) < 230

    # lines: SQL over what the first stage kept
    con = duckdb.connect()
    con.execute(f"CREATE VIEW kept AS SELECT * FROM '{tmp_path}/stage-0/*.parquet'")
    cut = con.execute("SELECT doc_id, text, deleted_lines FROM (" + linededup.SQL_OF.format(docs="kept", w=linededup.MIN_WORDS) + ")").fetchall()
    want = [(i, t) for i, t, n in cut if not n or t.strip(" ")]
    assert sorted((r[0], r[1] or "") for r in kept[1]) == sorted((i, t or "") for i, t in want) and any(n for _, _, n in cut)

    # near copies: all pairs
    sets = {i: shingles(t, 5) for i, t, _ in kept[1]}
    links = [(x, y) for x, y in itertools.combinations(sets, 2) if sets[x] and sets[y] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]
    top = joined(sets, links)
    assert sorted(r[0] for r in kept[2]) == sorted(i for i in sets if top[i] == i) and links

    # the mix: whole documents, at most twice, each source at its target
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t, s in kept[2]:
        sizes[s] += len(WORDS.findall(t or ""))
    for i, t, s in kept[3]:
        taken[s] += len(WORDS.findall(t or ""))
    goal = mixing.targets(dict(sizes))
    drawn = collections.Counter((r[0], r[1], r[2]) for r in kept[3])
    assert set(drawn) <= {(i, t, s) for i, t, s in kept[2]} and max(drawn.values()) <= 2
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 1 for s in sizes)

    # packing: every id of every drawn document once, in windows without gaps
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    parts = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)
    for (i, t, _), n in drawn.items():
        ids = ids_of(WORD, t)
        held = np.zeros(len(ids), int)
        for (d, start, length, c), m in parts.items():
            if d == i:
                held[start : start + length] += m
                assert c == crc(ids[start : start + length])
        assert (held == n).all()
    windows = collections.defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
