"""URL rules, quality, decontamination, archives and the pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from spendlens.llm import decontam, pu_quality, queries, url_filters, warc


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, default)


def test_url_rules(spark, monkeypatch):
    rng = random.Random(4)
    labels = ["a", "b", "org", "com", "x-y", "\x01", "\x02c", ""]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    path = lambda: "".join(rng.choice(["/", "/a", "/b", "c", "\xff", "é", "漢"]) for _ in range(rng.randint(0, 3)))
    rules = {(host(3), "/" + path() if rng.random() < 0.8 else ""): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [rng.choice(["http://", "HTTPS://", "://"]) + host(4).upper() + path() + rng.choice(["", "?q=/a", "#f", "/a?x#y"]) for _ in range(600)]
    urls += [None, "", "no scheme/a", "http://", "http:///a", "x://a://b/c"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls[:5]])], "page_id long, url string") \
        .selectExpr("*", "url as host", "page_id as rule", "url as path", "1 as part", "2 as salt", "url as page")
    monkeypatch.setattr(url_filters, "WIDTH", 8)
    extra = [(None, "/", "block"), ("org", "/", None), ("org", "/", "other")]
    table = url_filters.rules_frame(spark, [*rules, *extra])
    got = {r.page.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(frame, table).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate([*urls, *urls[:5]])}
    assert url_filters.url_verdicts(frame.where("false"), table).count() == 0
    nothing = url_filters.url_verdicts(frame, table.where("false"), default="block").collect()
    assert {(r.rule, r.verdict) for r in nothing} == {(None, "block")} and len(nothing) == len(urls) + 5


def test_url_plan_is_native(spark, sf):
    plan = queries.op3_url_filters(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = pu_quality.quality_scores(docs, pu_quality.trusted_rows(labels)).join(labels, "doc_id").where(pu_quality.held_out(F.col("doc_id"))).toPandas()
    right = (scored.score >= queries.GOOD) == (scored.quality == 1)
    assert right.mean() > 0.95 and abs(scored.prior[0] - 0.855) < 0.06


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    some = odd_docs.where("doc_id in (1, 2)").select("doc_id")
    got = pu_quality.quality_scores(odd_docs, some).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    nothing_known = pu_quality.quality_scores(odd_docs, some.where("false")).collect()
    assert all(r.score == 1 for r in nothing_known)
    assert pu_quality.quality_scores(no_docs, some).count() == 0
    labels = spark.createDataFrame([(i, 1 if i % 3 else None) for i in range(200)], "doc_id long, quality int")
    import zlib
    kept = {r.doc_id for r in pu_quality.trusted_rows(labels).collect()}
    assert kept == {i for i in range(200) if i % 3 and zlib.crc32(str(i).encode()) % 4 != 2}


def test_statistics_are_of_the_whole_text():
    rng = random.Random(3)
    clean = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10 ** 6)}" for _ in range(150_000))
    assert len(clean) > 1 << 20
    ratio = lambda t: len(zlib.compress(t.encode(), 1)) / len(t.encode())
    for text in (clean[:5000], clean[:1 << 20], clean, clean + "\nthe same line again" * 200_000):
        assert abs(pu_quality.statistics(text)[20] - ratio(text)) < 1e-12


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64) for _ in range(80)]
    passages = [rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64) for _ in range(80)]
    for (score, _), a, b in zip(decontam.align(items, passages), items, passages, strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                step = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
        assert score == h.max()


def test_copies_of_items(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(8, 50))) for i in range(40)] + [(40, ""), (41, None), (42, "two words"), (None, say(20)), (7, say(20))]
    docs, expected = [], set()
    for d in range(300):
        text = say(rng.randint(0, 300))
        if d % 3 == 0:
            k, t = items[rng.randrange(40)]
            w = t.upper().split()
            for _ in range(len(w) // 9):  # edited copies
                p = rng.randrange(len(w))
                w[p:p + 1] = rng.choice([[], ["other"], [w[p], "more"]])
            text = f"{text}. {', '.join(w)}! {say(20)}"
            expected.add((d, k))
        docs.append((d, text))
    frame = spark.createDataFrame([*docs, (None, ""), (900, None), (901, " "), (902, "x" * 3_000_000)], "doc_id long, text string").selectExpr("*", "doc_id as key", "doc_id as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "item_id as doc_id")
    for words_of_block in (2_000_000, 200):  # one block of items, and many
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words_of_block)
        found = decontam.contaminated(frame, bench).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected
    clean = {r.doc_id for r in frame.where(decontam.clean_column(frame, bench)).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in expected} | {None, 900, 901, 902}
    assert decontam.contaminated(frame, bench.where("false")).count() == 0
    assert decontam.contaminated(no_docs, bench).count() == 0


def test_sole_copies_with_changed_words_are_found(spark):
    """Every 4th, 5th or 6th word replaced or dropped, no other copy of the item: what plain alignment finds."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))) for i in range(60)]
    docs = []
    for i, text in items:
        w, step, start = text.split(), 4 + i % 3, rng.randrange(4)
        w[start::step] = [f"new{i}x{k}" for k in range(len(w[start::step]))]
        if i % 2:
            del w[start::step]
        docs.append((i, " ".join([*(rng.choice(words) for _ in range(20)), *w, *(rng.choice(words) for _ in range(20))])))
    expected = {}
    for d, text in docs:
        for i, item in items:
            a, b = decontam.word_hashes(item), decontam.word_hashes(text)
            score = decontam.align([a], [b])[0][0]
            if score >= decontam.SCORE * decontam.MATCH * len(a) and score >= decontam.MATCH * min(decontam.AGREE, len(a)):
                expected[d, i] = score / (decontam.MATCH * len(a))
    assert len(expected) > 45
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame, bench).collect()} == expected
    assert {r.doc_id for r in frame.where(decontam.clean_column(frame, bench)).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def pages_of(spark):
    rows = [(i, f"http://a/{i % 7}\r\nX: y", "<p>" + "é" * (i % 11)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "u", "<p>"), (None, "u", "only here"), (102, "u", "z" * 500_000), (59, "u", rows[59][2])]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html as payload", "url as sha", "page_id as target")


@pytest.mark.parametrize("least", [0, 8])
def test_archives(spark, least):
    rows, pages = pages_of(spark)
    manifest = warc.write_warc(pages, least=least, file_bytes=2000)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = largest.get(h or "")
        to = None if len(data) < least or to == i else to
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to,
                         data if to is None else None, None))
    got = warc.read_warc(manifest, payloads=True).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error")
    key = lambda r: (str(r[0]), r[1], r[3])
    assert sorted([tuple(None if r[n] is None and n == "payload" else bytes(r[n]) if n == "payload" else r[n] for n in names)[:5] for r in got], key=key) \
        == sorted([(*e[:5],) for e in expected], key=key)
    assert all((r.payload is None) == (r.record_type == "revisit") or r.payload == b"" for r in got) and not any(r.error for r in got)
    assert manifest.count() > 1
    assert warc.read_warc(warc.write_warc(pages.where("false"))).count() == 0


def test_long_urls_can_be_read_back(spark):
    pages = [(1, "http://a/" + "x" * (2 << 20), "one"), (2, "http://b/" + "é/" * (3 << 20), "two" * 40_000), (3, "http://c/", "one"), (4, "http://d/", None)]
    manifest = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    got = warc.read_warc(manifest, payloads=True).collect()
    assert sorted((r.page_id, r.url, r.error) for r in got) == [(i, u, None) for i, u, _ in pages]
    assert {r.page_id: r.payload for r in got if r.record_type == "response"} == {2: b"two" * 40_000, 3: b"one", 4: b""}


def test_broken_archives(spark, tmp_path):
    whole = [warc.record(i, "http://a", f"<p>{i}".encode(), None) for i in range(3)]
    bad = bytearray(warc.record(9, "u", b"payload", None))
    bad[-20] ^= 1
    files = {"cut": b"".join(whole)[:-9], "flipped": whole[0] + bytes(bad) + whole[1], "empty": b"", "junk": b"not an archive", "fine": b"".join(whole)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files], "path string")
    got = warc.read_warc(manifest).collect()
    fine = [r for r in got if r.error is None]
    assert len(fine) == 2 + 1 + 3 and sum(r.error is not None for r in got) == 3


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    """The stages' decisions on a small table, against brute force on each stage's own input."""
    import corpus_pipeline
    from test_dedup import passages_by_hand, simhash

    source = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id < 120")
    docs = docs.unionByName(docs.where("doc_id in (3, 7)")).unionByName(spark.sql("select 5000L doc_id, cast(null as string) text, 'en' lang, cast(null as string) source, 0L n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, now, str(tmp_path)), name)
        seen.append((name, now.collect(), after.collect()))
        assert name == "encode" or after.schema.names == now.schema.names
        now = after
    by = {name: (a, b) for name, a, b in seen}
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    before, after = by["simhash"]
    fps = {r.doc_id: simhash(r.text) for r in before}
    reach = {d: d for d in fps}
    for _ in fps:
        reach = {d: min(reach[e] for e in fps if (fps[d] ^ fps[e]).bit_count() <= 3) for d in fps}
    assert key(after) == key({r.doc_id: r for r in before if reach[r.doc_id] == r.doc_id}.values())
    before, after = by["passages"]
    hand = {r[0]: r for r in passages_by_hand([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if hand[r.doc_id][2] == 0 or hand[r.doc_id][1] > hand[r.doc_id][2]}
    assert all(len((r.text or "").encode()) <= hand[r.doc_id][1] - hand[r.doc_id][2] and r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()}
    before, after = by["decontamination"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not any(t[:-1] in (r.text or "") for t in items.values())}
    final = key(corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert final == key(by["encode"][1]) and len(final) == len(by["encode"][0])
