"""Passage removal, SimHash groups and embedding groups against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from spendlens.llm import bwt, bwt_dedup, gray_simhash, rp_forest
from spendlens.llm.common import connected_components


def least_of(strings, values, depth):
    seen = {}
    for s, v in zip(strings, values, strict=True):
        for i in range(len(s) - depth + 1):
            seen[s[i:i + depth]] = min(seen.get(s[i:i + depth], 1 << 62), v)
    return [[seen[s[i:i + depth]] for i in range(max(0, len(s) - depth + 1))] for s in strings]


def test_merged_transforms_find_equal_strings(monkeypatch):
    rng = random.Random(3)
    for _ in range(120):
        depth = rng.choice([3, 5, 10, 12, 17])
        monkeypatch.setattr(bwt, "SHARD", rng.choice([20, 60, 200, 100000]))
        base = bytes(rng.choice(b"ab\x00\xfe") for _ in range(60))
        strings = set()
        for _ in range(rng.randint(1, 25)):
            a, n = rng.randint(0, 50), rng.randint(0, 25)
            s = bytearray(base[a:a + n])
            if s and rng.random() < 0.5:
                s[rng.randrange(len(s))] = rng.choice(b"abc")
            strings.add(bytes(s))
        strings = sorted(strings, key=lambda s: rng.random())
        values = np.array([rng.randint(0, 50) for _ in strings])
        assert [x.tolist() for x in bwt.least_value(strings, values, depth)] == least_of(strings, values, depth)


def passages_by_hand(rows, depth=50):
    rows = [(1 << 62 if i is None else i, (t or "").encode()) for i, t in rows]
    first, out = {}, []
    for i, t in sorted(rows):
        for p in range(len(t) - depth + 1):
            first.setdefault(t[p:p + depth], i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - depth + 1):
            if first[t[p:p + depth]] < i:
                gone[p:p + depth] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall("1+", "".join("1" if g else "0" for g in gone)))
        out.append((None if i == 1 << 62 else i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 2048])
def test_passages_of_documents(spark, sf, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(90)
    got = sorted(map(tuple, bwt_dedup.dedup_passages(docs, hot=hot).collect()), key=str)
    assert got == passages_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_passages_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    got = bwt_dedup.dedup_passages(odd_docs, texts=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == passages_by_hand([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
    assert bwt_dedup.dedup_passages(no_docs).count() == 0


def test_work_of_a_block_does_not_grow_with_the_buckets(spark, odd_docs, monkeypatch):
    """More buckets than bytes: still only those that occur are visited, with the same rows."""
    monkeypatch.setattr(bwt_dedup, "_bucket", lambda values, buckets: ((values >> np.uint64(40)) % np.uint64(200_000)).astype(np.int64))
    docs = odd_docs.where("doc_id is null or doc_id not in (5, 6)")
    got = sorted((tuple(r) for r in bwt_dedup.dedup_passages(docs).collect()), key=str)
    assert got == passages_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    rng = np.random.default_rng(1)
    bucket = rng.integers(0, 50_000_000, 5000)
    order, spans = bwt_dedup._by_bucket(bucket)
    assert len(spans) == len(set(bucket.tolist()))
    assert all((bucket[order[a:z]] == b).all() and z > a for b, (a, z) in spans.items()) and sum(z - a for a, z in spans.values()) == 5000
    assert bwt_dedup._by_bucket(bucket[:0])[1] == {}


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash_components(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select(
        (odd_docs.doc_id + 100000).alias("doc_id"), "text"))
    rows = sorted(((r.doc_id, simhash(r.text)) for r in docs.collect() if r.doc_id is not None))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3]
    label = groups(len(rows), near)
    expected = sorted((d, f"{fp:016x}", rows[label[k]][0]) for k, (d, fp) in enumerate(rows))
    got = [tuple(r) for r in gray_simhash.simhash_components(docs).collect()]
    assert sorted(r for r in got if r[0] is not None) == expected
    known = {fp: c for _, fp, c in expected}
    assert all(c == known.get(fp) for d, fp, c in got if d is None) and len(got) == docs.count()
    assert gray_simhash.simhash_components(no_docs).count() == 0


def test_index_finds_what_all_pairs_do(spark):
    rng = np.random.default_rng(0)
    bit = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ bit(60) for _ in range(8)], base[:8].repeat(60) ^ bit(480) ^ bit(480)]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    expected = gray_simhash.smallest_reachable(len(fps), *np.nonzero(np.triu(near, 1)))
    nodes = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long")
    for most in (4096, 64):  # 64: top nodes are split again and again
        found = gray_simhash.near_links(nodes, 3, most).toPandas()
        assert np.array_equal(gray_simhash.smallest_reachable(len(fps), found.a.to_numpy(), found.b.to_numpy()), expected)


def test_a_node_of_many_near_copies_is_split_until_it_is_small(spark, monkeypatch):
    """2^14 fingerprints that vary in 14 bits only, some others alone, and neighbours of some at a distance of 3 and of 9."""
    written, store = [], gray_simhash.stored

    def counted(df, name):
        written.append(name)
        assert len(written) < 40, "the splits do not end"
        return store(df, name)

    monkeypatch.setattr(gray_simhash, "stored", counted)
    rng = np.random.default_rng(5)
    one = np.uint64(1)
    places = np.arange(64, dtype=np.uint64)
    free = places[[25, 26, 27, 29, 30, 31, 37, 38, 39, 41, 42, 43, 45, 46]]  # a cut by position alone leaves them free at any level
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    fps = np.bitwise_or.reduce((np.arange(1 << 14, dtype=np.uint64)[:, None] >> np.arange(14, dtype=np.uint64) & one) << free, axis=1) ^ base
    outside = np.setdiff1d(places, free)
    flip = lambda n: np.bitwise_or.reduce(one << rng.choice(outside, n, replace=False))
    near, far = fps[:30] ^ np.array([flip(3) for _ in range(30)], np.uint64), fps[100:130] ^ np.array([flip(9) for _ in range(30)], np.uint64)
    alone = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, near, far, alone]))
    a, b = [], []
    for at in range(0, len(fps), 512):
        i, j = np.nonzero(np.bitwise_count(fps[at:at + 512, None] ^ fps) <= 3)
        a.append(i + at)
        b.append(j)
    expected = gray_simhash.smallest_reachable(len(fps), np.concatenate(a), np.concatenate(b))
    nodes = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long")
    for most in (4096, 256):
        written.clear()
        sizes = gray_simhash.top_nodes(nodes, 3, most).groupBy("mask", "shared").count().agg({"count": "max"}).first()[0]
        assert sizes <= most
        found = gray_simhash.near_links(nodes, 3, most).toPandas()
        assert np.array_equal(gray_simhash.smallest_reachable(len(fps), found.a.to_numpy(), found.b.to_numpy()), expected)


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(90)]
    frame = spark.createDataFrame([*links, (None, 3), (4, None), (7, 7)], "a long, b long")
    label = groups(6000, links)
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {n: label[n] for pair in links if pair[0] != pair[1] for n in pair}
    assert connected_components(frame.where("false")).count() == 0


def test_embedding_components(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(25, 16))
    rows = [(i, (base[i % 25] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.05])).tolist(), i % 2) for i in range(400)]
    rows += [(1000 + i, base[0].tolist(), 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, base[0].tolist(), None),
             (2005, [None, *base[0].tolist()[1:]], 0), (None, base[0].tolist(), 0), (2006, base[0].tolist()[:8], 0), (5, rows[5][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "label as rep", "vec_id as x", "label as leaf")
    good = [(i, np.array(v), l) for i, v, l in rows if i is not None and l is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([g[1] / np.linalg.norm(g[1]) for g in good])
    lab = np.array([g[2] for g in good])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    order = sorted(range(len(good)), key=lambda k: good[k][0])
    back = {k: n for n, k in enumerate(order)}
    label = groups(len(good), [(back[i], back[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    expected = sorted((g[0], int(near[k].sum()), good[order[label[back[k]]]][0]) for k, g in enumerate(good))
    got = [tuple(r) for r in rp_forest.embedding_components(frame, leaf=16).collect()]
    alone = {2000, 2001, 2002, 2003, 2004, 2005, 2006, None}
    assert sorted(r[:3] for r in got if r[0] not in alone) == expected
    assert all(r[1] == 0 and r[2] == r[0] and r[3] for r in got if r[0] in alone) and len(got) == len(rows)
    assert rp_forest.embedding_components(frame.where("false")).count() == 0
    assert rp_forest.embedding_components(frame.where("vec_id = 2000")).count() == 1
