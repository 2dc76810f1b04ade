"""Token counts, tree BPE and grammar files against the tokenizers library."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from spendlens.llm import chunks, repair_ids, token_counts, tree_bpe

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(seed, n=300):
    rng = random.Random(seed)
    signs = "ab c\n\t'sſéÉßΣς漢字🙂́  \x1c\x85\xa0².,!12 THEtheingion"
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    made += ["".join(rng.choice(["the", "ing", "a", "é", "Q", "1", "!!", "漢", "th"]) for _ in range(rng.randint(100, 700))) for _ in range(60)]
    made += ["".join(rng.choice("ab") for _ in range(rng.randint(130, 800))) for _ in range(60)]
    return made + ["", "x <|endoftext|> y<|endoftext|>z  ", "<|startoftext|>a", "a" * 1000, "漢字" * 400, "İ" * 300]


def test_counts_equal_the_library():
    some = texts(1)
    expected = [len(e) for e in chunks.tokenizer(BYTE).encode_batch(some, add_special_tokens=False)]
    assert token_counts.counts(some, BYTE) == expected
    assert all("".join(token_counts.safe_pieces(t)) == t for t in some)


def test_tree_encoding_and_decoding_equal_the_library():
    some, tok = texts(2), chunks.tokenizer(WORD)
    expected = [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]
    assert tree_bpe.encode_texts(some, WORD) == expected
    coder = tree_bpe.Coder(WORD)
    for text, ids in zip(some, expected, strict=True):
        told = [t for t in coder.told(tree_bpe.runs_of(text)) if t[0]]
        assert " ".join(t[2] for t in told) == tok.decode(ids, skip_special_tokens=False)
        lines = "\n".join(filter(None, coder.lines(tree_bpe.runs_of(text)))).split("\n")
        assert " ".join(lines[::2]) == " ".join(map(str, ids)) and " ".join(lines[1::2]) == tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [2, 3, 7, 32])
def test_joins_agree_whatever_the_leaves(leaf):
    coder, rng = tree_bpe.Coder(WORD), random.Random(leaf)
    for _ in range(150):
        piece = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 90)))
        assert tree_bpe.encode_long(piece, coder.symbols, leaf) == coder.symbols(piece)


def test_queries_over_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    count = sorted((str(r[0]), r[1], r[2]) for r in token_counts.token_counts(odd_docs, BYTE).collect())
    tok = chunks.tokenizer(BYTE)
    assert count == sorted((str(i), len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    coded = tree_bpe.encode_decode(odd_docs, WORD, texts=True).collect()
    tok = chunks.tokenizer(WORD)
    expected = []
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        expected.append((str(i), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.ids, r.ids_sha256, r.decoded_sha256) for r in coded) == sorted(expected)
    assert token_counts.token_counts(no_docs, BYTE).count() == 0
    assert tree_bpe.encode_decode(no_docs, WORD).count() == 0


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 1000, 20000):
        for kinds in (1, 2, 10, 1000):
            ids = rng.integers(0, kinds, n)
            seq, rules, lengths = repair_ids.repair(ids)
            assert np.array_equal(repair_ids.expand(seq, rules), ids)
            assert [len(repair_ids.expand(np.array([repair_ids.BASE + i]), rules)) for i in range(len(rules))] == lengths.tolist()
    docs = [np.append(rng.integers(0, 5, rng.integers(0, 40)), 2) for _ in range(300)]
    shard = repair_ids.Shard.of([None, *range(299)], docs, 7)
    again = repair_ids.Shard.read(io.BytesIO(shard.bytes()))
    assert len(again.seq) < sum(map(len, docs)) and again.before == 7 and again.nulls == 1
    assert all(np.array_equal(again.document(i), d) for i, d in enumerate(docs))


def test_files_of_ids(spark, odd_docs, no_docs):
    got = repair_ids.read_ids(repair_ids.write_ids(odd_docs, WORD), ids=True).collect()
    tok = chunks.tokenizer(WORD)
    expected = {}
    for r in odd_docs.collect():
        expected.setdefault(r.doc_id, []).append(tok.encode(r.text or "", add_special_tokens=False).ids + [2])
    at = 0
    for row in sorted(got, key=lambda r: r.start):
        assert row.start == at and row.n_tokens == len(row.ids) and row.ids in expected[row.doc_id]
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        expected[row.doc_id].remove(row.ids)
        at += row.n_tokens
    assert not any(expected.values())
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert repair_ids.read_ids(repair_ids.write_ids(no_docs, WORD)).count() == 0


def test_repair_numbers_its_rules_by_pair():
    """The rules of a round in the order of their pairs, whatever the order of equal keys in the sort."""
    import numpy as np

    from spendlens.llm import repair_ids
    ids = np.random.default_rng(5).integers(0, 6, 30_000)
    seq, rules, lengths = repair_ids.repair(ids, rounds=1)
    assert (np.diff(rules[:, 0] << 32 | rules[:, 1]) > 0).all() and (lengths == 2).all()
    assert (np.bincount(seq[seq >= repair_ids.BASE] - repair_ids.BASE, minlength=len(rules)) > 2).all()
    assert (repair_ids.expand(seq, rules) == ids).all()


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_words_in_columns_equal_the_library(most):
    import pyarrow as pa

    words, some = tree_bpe.Words(tree_bpe.Coder(WORD), most), [*texts(6), None, "a\x0bb\x0cc　d\x85e f", "x" * 300, "I'll IT'S o''d 'Re!'s 1½² <a|b> <|x ÀÿªºµÞ×"]
    tok = chunks.tokenizer(WORD)
    expected = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in some]
    for _ in range(2):
        for i in range(0, len(some), 60):
            ids, ends = words.encode(pa.array(some[i:i + 60]), 2)
            assert [d.tolist() for d in np.split(ids, ends[:-1])] == expected[i:i + 60]
            assert all(len(m.words) <= most and len(m.ids) == m.wide.sum() for m in (words.runs, words.pieces))
    assert max(map(len, words.runs.words.to_pylist())) <= chunks.LONGEST


def test_known_words_and_whole_pieces_reach_no_library_call():
    """New pieces go to the library many in a text, known runs not at all."""
    import pyarrow as pa

    coder, asked = tree_bpe.Coder(WORD), []

    class Counting:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, some, **more):
            asked.extend(some)
            return self.tok.encode_batch_fast(some, **more)

    coder.merger, coder.tok = Counting(coder.merger), Counting(coder.tok)
    words = tree_bpe.Words(coder)
    text = pa.array([" ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiouéß" for c in "xyz,.")])
    first, _ = words.encode(text, 2)
    assert 0 < len(asked) <= 3
    again, _ = words.encode(text, 2)
    assert len(asked) <= 3 and np.array_equal(first, again)


def test_repair_looks_only_where_a_pair_can_be_frequent(monkeypatch):
    rng, looked, own = np.random.default_rng(3), [], repair_ids.frequent
    ids = rng.integers(0, 3000, (200, 12))[rng.integers(0, 200, 5000)].ravel()
    monkeypatch.setattr(repair_ids, "frequent", lambda seq, at, least: (looked.append(len(at)), own(seq, at, least))[1])
    few = repair_ids.repair(ids)
    monkeypatch.setattr(repair_ids, "frequent", lambda seq, at, least: own(seq, np.arange(len(seq) - 1), least))
    assert all(np.array_equal(a, b) for a, b in zip(few, repair_ids.repair(ids), strict=True))
    assert len(looked) > 3 and looked[-1] < looked[0] / 10
