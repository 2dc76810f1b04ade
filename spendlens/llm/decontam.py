"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One pass finds which word n-grams of the test items any document holds; each of them is a seed, so
that whatever n-gram an edit leaves whole leads to the copy. A second pass joins the texts to the
seeds; each hit gives the passage around it where the item would lie. Passages with too few of the
item's words to reach the score are passed over (a bound, so no copy is lost), and a local alignment
of words (match, mismatch, gap) scores the others, so that edited copies are found as well as exact
ones. A copy of which no n-gram is whole has no seed and is not found.

The items are the query set: they go to the tasks in blocks of bounded size, each block in a pass
over all documents. Texts are never shuffled, and a passage that many documents share costs each
document its own alignment only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import stored

#: Words in a seed.
GRAM = 3
#: Alignment scores.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of the item's full score, and words in agreement, from which a passage is a copy of the item (all its words if it has fewer).
SCORE, AGREE = 0.5, 6
#: Words of all items in one block: a bound of about 64 MB for what goes to each task.
BLOCK_WORDS = 2_000_000
#: Words beside the place where the item would lie that insertions may need, as a part of its length.
SLACK = 0.5
#: Bytes whose words are hashed at a time.
SLICE = 1 << 20

_rng = np.random.default_rng(20200101)
_TABLE = _rng.integers(0, 1 << 63, (256, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _hash_slice(raw: np.ndarray) -> np.ndarray:
    is_word = _WORD[raw]
    at = np.flatnonzero(is_word)
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return np.add.reduceat(_TABLE[raw[at], place & 63], first)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit value for each word (letters and digits, in lower case) of a text, in order."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if len(raw) <= SLICE:
        return _hash_slice(raw)
    parts, at = [], 0
    breaks = np.flatnonzero(~_WORD[raw])
    while at < len(raw):
        k = np.searchsorted(breaks, at + SLICE)
        end = int(breaks[k]) if k < len(breaks) else len(raw)
        parts.append(_hash_slice(raw[at:end]))
        at = end
    return np.concatenate(parts)


def many_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts, and where each text's words begin (one more entry at the end)."""
    each, small = [None] * len(texts), []
    for i, text in enumerate(texts):
        if len(text) > SLICE // 4:
            each[i] = word_hashes(text)
        else:
            small.append(i)
    # short texts in one go, a byte 0 between them
    if small:
        raw = np.frombuffer("\x00".join([texts[i].lower().replace("\x00", " ") for i in small]).encode("utf-8", "replace"), np.uint8)
        got = _hash_slice(raw)
        begin = np.flatnonzero(np.diff(np.concatenate(([0], _WORD[raw].astype(np.int8)))) == 1)
        borders = np.flatnonzero(raw == 0)
        cut = np.searchsorted(begin, borders)
        for i, own in zip(small, np.split(got, cut), strict=True):
            each[i] = own
    starts = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
    return (np.concatenate(each) if each else np.empty(0, np.uint64)), starts


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit value for each n-gram."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(GRAM):
        w = words[i:i + n]
        g += (w ^ (w >> np.uint64(29))) * _MIX[i]
        g ^= g >> np.uint64(32)
    return g * _MIX[7]


class Lookup:
    """Whether values are in a fixed set: a bit table first, then the sorted values."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.values >> np.uint64(44)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x of members, and which value each is."""
        if not len(self.values):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.bits[x >> np.uint64(44)])
        which = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        same = self.values[which] == x[at]
        return at[same], which[same]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> list[tuple[int, int]]:
    """Best local alignment of each item with its passage: (score, end of it in the passage)."""
    out: list[tuple[int, int]] = [(0, 0)] * len(items)
    order = sorted(range(len(items)), key=lambda i: (len(passages[i]), len(items[i])))
    at = 0
    while at < len(order):
        wide = max(1, len(passages[order[at]]))
        some = [i for i in order[at:at + max(1, min(512, (1 << 21) // wide))]]
        at += len(some)
        width, height = max(len(passages[i]) for i in some), max(len(items[i]) for i in some)
        text = np.zeros((len(some), width), np.uint64)
        item = np.zeros((len(some), height), np.uint64)
        real = np.zeros((len(some), width), bool)
        for k, i in enumerate(some):
            text[k, :len(passages[i])], item[k, :len(items[i])], real[k, :len(passages[i])] = passages[i], items[i], True
        slope = (np.arange(width) * -GAP).astype(np.int32)
        above = np.zeros((len(some), width), np.int32)
        best, end = np.zeros(len(some), np.int32), np.zeros(len(some), np.int64)
        live = np.array([len(items[i]) for i in some])
        for row in range(height):
            step = np.where((text == item[:, row:row + 1]) & real, MATCH, MISMATCH).astype(np.int32)
            step[:, 1:] += above[:, :-1]
            now = np.maximum(np.maximum(step, above + GAP), 0)
            now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the row
            now[live <= row] = 0
            top = now.argmax(axis=1)
            value = now[np.arange(len(some)), top]
            better = value > best
            best[better], end[better] = value[better], top[better] + 1
            above = now
        for k, i in enumerate(some):
            out[i] = (int(best[k]), int(end[k]))
    return out


class Matcher:
    """A block of items with their seeds, as it goes to the tasks."""

    def __init__(self, ids: list[int], items: list[np.ndarray], grams: np.ndarray, where: np.ndarray):
        """grams: the seeds' n-grams; where: for each of them (which item, place in the item)."""
        self.ids, self.items = ids, items
        order = np.argsort(grams, kind="stable")
        self.lookup = Lookup(grams)
        self.where = where[order]
        self.first = np.append(np.searchsorted(grams[order], self.lookup.values), len(order))

    def copies(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(which text, which item, score, first word, end word) of the best copy of each item in each text."""
        words, starts = many_hashes(texts)
        at, which = self.lookup.find(gram_hashes(words))
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = at + GRAM <= starts[doc + 1]
        at, which, doc = at[inside], which[inside], doc[inside]
        many = self.first[which + 1] - self.first[which]
        hit = np.repeat(np.arange(len(at)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, place = self.where[self.first[which][hit] + nth].T if len(hit) else (np.empty(0, np.int64),) * 2
        length = np.array([len(x) for x in self.items], np.int64)
        slack = np.ceil(length * SLACK).astype(np.int64)
        low = np.maximum(at[hit] - place - slack[item], starts[doc[hit]]) if len(hit) else np.empty(0, np.int64)
        high = np.minimum(at[hit] - place + length[item] + slack[item], starts[doc[hit] + 1]) if len(hit) else low
        # passages of one text and item that overlap are one
        order = np.lexsort((low, item, doc[hit]))
        jobs: list[list[int]] = []
        for d, i, a, b in zip(doc[hit][order].tolist(), item[order].tolist(), low[order].tolist(), high[order].tolist(), strict=True):
            if jobs and jobs[-1][0] == d and jobs[-1][1] == i and a <= jobs[-1][3]:
                jobs[-1][3] = max(jobs[-1][3], b)
            else:
                jobs.append([d, i, a, b])
        best: dict[tuple[int, int], tuple] = {}
        jobs = [j for j in jobs if self._may_be_copy(self.items[j[1]], words[j[2]:j[3]])]
        scored = align([self.items[j[1]] for j in jobs], [words[j[2]:j[3]] for j in jobs])
        for (d, i, a, b), (score, end) in zip(jobs, scored, strict=True):
            share = score / (MATCH * len(self.items[i]))
            if share >= SCORE and score >= MATCH * min(AGREE, len(self.items[i])) and (d, i) not in best or (d, i) in best and share > best[d, i][2]:
                first = max(a, a + end - int(len(self.items[i]) * (1 + SLACK)))
                best[d, i] = (d, i, share, int(first - starts[d]), int(a + end - starts[d]))
        return list(best.values())

    @staticmethod
    def _may_be_copy(item: np.ndarray, passage: np.ndarray) -> bool:
        """Whether the item's words that stand in the passage are enough, were all of them to match in order."""
        most = np.count_nonzero(np.isin(item, passage))
        return most >= SCORE * len(item) and most >= min(AGREE, len(item))


def _item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word values, in blocks of bounded size: the driver holds one block at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).where(f"`{key}` is not null").orderBy(key, text).toLocalIterator():
        words = word_hashes(row[1] or "")
        if len(words) < GRAM:
            continue
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row[0], words))
        held += len(words)
    if block:
        yield block


def _seeds(docs: DataFrame, text: str, block: list[tuple[int, np.ndarray]]) -> tuple:
    """What a Matcher is made of: a block of items and its seeds, the n-grams that any document holds."""
    grams = [gram_hashes(words) for _, words in block]
    values = np.unique(np.concatenate(grams))
    sent, size = docs.sparkSession.sparkContext.broadcast(values), len(values)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, lookup = np.zeros(size, bool), Lookup(sent.value)
        for batch in batches:
            for part in chunks.text_slices(batch, "text", SLICE):
                words, starts = many_hashes([t or "" for t in part.column("text").to_pylist()])
                at, which = lookup.find(gram_hashes(words))
                doc = np.searchsorted(starts, at, side="right") - 1
                inside = at + GRAM <= starts[doc + 1]
                seen[which[inside]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], ["gram"])

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(mark, "gram long").distinct()
    held = np.zeros(size, bool)
    for row in stored(found, "grams").toLocalIterator():  # one row for each n-gram of the block at most
        held[row.gram] = True
    where = np.concatenate([np.stack([np.full(len(own), i), np.arange(len(own))], axis=1) for i, own in enumerate(grams)])
    all_grams = np.concatenate(grams)
    use = held[np.searchsorted(values, all_grams)]
    return [i for i, _ in block], [w for _, w in block], all_grams[use], where[use]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, score, first_word, end_word): the best copy of each item in each document that has one.

    score is the alignment's part of the item's full score, from ``SCORE`` to 1. Null and empty
    texts hold no copies; items with a null id or fewer than ``GRAM`` words are in no document; an
    item listed twice gives a row for each listing. Repeated and null document keys each keep their
    rows. Other columns are not read. No items: no rows.
    """
    spark = docs.sparkSession
    schema = "key long, item_id long, score double, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    for block in _item_blocks(benchmark, item_key, item_text):
        sent = spark.sparkContext.broadcast(_seeds(docs, text, block))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value)
            for batch in batches:
                for part in chunks.text_slices(batch, "text", SLICE):
                    got = matcher.copies([t or "" for t in part.column("text").to_pylist()])
                    if got:
                        yield pa.RecordBatch.from_arrays([
                            part.column("key").take(pa.array([g[0] for g in got])), pa.array([matcher.ids[g[1]] for g in got], pa.int64()),
                            pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())],
                            ["key", "item_id", "score", "first_word", "end_word"])

        out = out.unionByName(rows.mapInArrow(find, schema))
    return out.withColumnRenamed("key", key)


def clean_column(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> Column:
    """Whether a document holds no copy of any item, for tables with any other columns."""
    def flag(sent) -> Column:
        def free(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(*sent.value)
            for texts in parts:
                flags = np.ones(len(texts), bool)
                values = [t if isinstance(t, str) else "" for t in texts]
                for at, some in _slices(values):
                    for g in matcher.copies(some):
                        flags[at + g[0]] = False
                yield pd.Series(flags)

        return F.pandas_udf(free, "boolean")(F.col(f"`{text}`"))

    clean = F.lit(True)
    for block in _item_blocks(benchmark, item_key, item_text):
        clean = clean & flag(docs.sparkSession.sparkContext.broadcast(_seeds(docs, text, block)))
    return clean


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > SLICE:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, texts[at:]
