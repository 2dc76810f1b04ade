"""Ranked lexical search by Block-Max MaxScore over an index of shards.

A shard is what one task has read, cut by bytes of text. For each term it holds the postings (document,
occurrences) in ascending document order, as variable-length numbers in blocks of ``BLOCK``, and for each block the
pairs (occurrences, length of the document) that no other pair of the block beats on both: whatever the
corpus statistics turn out to be, the block's highest possible score is that of one of these pairs.

A query walks the shard in windows of documents. The lists are ordered by the highest score that any of
their blocks allows; as many of the lowest as together can't pass the score of the k-th best so far are
non-essential, and only documents of the other, essential lists are looked at. Their scores from the
essential lists plus the block maxima of the non-essential ones, which need no decompression, reject most; for the rest the
non-essential lists are read from the highest down, each block at most once, rejecting as the bounds
fall. The shards' heaps are merged by Spark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import text_slices
from .common import stored

#: Postings in a block.
BLOCK = 128
#: Documents in a window.
WINDOW = 4096
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 32 << 20
#: Terms of all queries in one pass over the index: what the driver and each task hold of them.
PASS_TERMS = 500_000
#: Characters of terms, with A-Z lower-cased; the rest separates.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text whose terms are listed at a time.
SLICE = 4 << 20

INDEX = ("shard long, term string, df long, terms long, last binary, at binary, data binary, "
         "best_at binary, best_tf binary, best_n binary, ids binary, lengths binary")


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, some megabytes at a time."""
    plain, at = raw.translate(_TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the highest bit set on all bytes of a number but its last; and where each number begins."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= 1 << 7 * k if 7 * k < 63 else 0
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(start[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[:-1][has] + k] = values[has] >> 7 * k & 127 | (size[has] > k + 1).astype(np.int64) << 7
    return out, start


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts) if len(ends) else np.empty(0, np.int64)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array as a column of bytes, by the places where they begin and end."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def shard_rows(number: int, ids: np.ndarray, lengths: np.ndarray, words: list[bytes], term: np.ndarray, doc: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents, then each term's postings. ``term`` and ``doc`` have one entry for each word of the texts."""
    order = np.argsort(ids, kind="stable")  # documents are numbered by ascending id
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ids, lengths = ids[order], lengths[order]
    pair, tf = np.unique(term.astype(np.int64) << 32 | rank[doc], return_counts=True)
    term, doc = pair >> 32, pair & 0xFFFFFFFF
    present, begin, df = np.unique(term, return_index=True, return_counts=True)
    place = np.arange(len(term)) - np.repeat(begin, df)
    opens = np.flatnonzero(place % BLOCK == 0)
    block = np.cumsum(place % BLOCK == 0) - 1
    blocks_before = np.append(np.searchsorted(opens, begin), len(opens))
    delta = np.diff(doc, prepend=-1)
    delta[begin] = doc[begin] + 1
    data, start = packed(np.stack([delta, tf], axis=1).ravel())
    starts = start[:-1][::2]
    last = doc[np.append(opens[1:], len(doc)) - 1].astype(np.int32)
    # pairs that no other of the block beats: by length, those with more occurrences than all shorter ones
    by = np.lexsort((-tf, lengths[doc], block))
    reach = np.maximum.accumulate(tf[by] + block[by] * (1 << 33))
    beats = np.append(True, reach[1:] > reach[:-1]) if len(by) else np.empty(0, bool)
    beats[np.flatnonzero(np.diff(block[by], prepend=-1))] = True
    kept = by[beats]
    best_at = np.searchsorted(block[kept], np.arange(len(opens)))
    n = len(present)
    ends = np.append(starts[begin], len(data))
    best_bounds = np.append(best_at, len(kept))[blocks_before]
    in_term = np.repeat(np.arange(n), np.diff(blocks_before))
    none = pa.nulls(1, pa.binary())
    yield pa.RecordBatch.from_arrays([
        pa.array([number]), pa.nulls(1, pa.string()), pa.array([len(ids)]), pa.array([int(lengths.sum())]), none, none, none, none, none, none,
        pa.array([ids.tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary())], schema=schema)
    for a in range(0, n, 20_000):
        z = min(n, a + 20_000)
        own = slice(blocks_before[a], blocks_before[z])
        b = blocks_before[a:z + 1] - blocks_before[a]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(z - a, number)), pa.array([words[t].decode() for t in present[a:z].tolist()], pa.string()), pa.array(df[a:z].astype(np.int64)), pa.nulls(z - a, pa.int64()),
            _binary(last[own], b), _binary((starts[opens[own]] - starts[begin][in_term[own]]).astype(np.int32), b),
            _binary(data[ends[a]:ends[z]], ends[a:z + 1] - ends[a]),
            _binary((best_at[own] - best_bounds[in_term[own]]).astype(np.int32), b),
            _binary(tf[kept[best_bounds[a]:best_bounds[z]]].astype(np.int32), best_bounds[a:z + 1] - best_bounds[a]),
            _binary(lengths[doc[kept[best_bounds[a]:best_bounds[z]]]].astype(np.int32), best_bounds[a:z + 1] - best_bounds[a]),
            pa.nulls(z - a, pa.binary()), pa.nulls(z - a, pa.binary())], schema=schema)


def index_partition(batches: Iterable[pa.RecordBatch], schema: pa.Schema, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    fresh = lambda: (defaultdict(count().__next__), [], [], [], 0)
    vocabulary, ids, lengths, words, held = fresh()

    def close():
        nonlocal made
        if ids:
            sizes = np.array(lengths, np.int64)
            yield from shard_rows(part << 24 | made, np.array(ids, np.int64), sizes.astype(np.int32), list(vocabulary), np.concatenate(words),
                                  np.repeat(np.arange(len(ids)), sizes), schema)
            made += 1

    for batch in batches:
        for some in text_slices(batch, "text"):
            for key, text in zip(some.column("key").to_pylist(), some.column("text").to_pylist()):
                raw = text.encode()
                if ids and held + len(raw) > shard_bytes:
                    yield from close()
                    vocabulary, ids, lengths, words, held = fresh()
                found = [np.fromiter(map(vocabulary.__getitem__, terms), np.int32, len(terms)) for terms in terms_of(raw)]
                n = sum(map(len, found))
                if n:
                    ids.append(key)
                    lengths.append(n)
                    words.extend(found)
                    held += len(raw)
    yield from close()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a stored table: for each shard a row of its documents (term null) and one for each term.

    Rows with a null id or text and texts without terms are not in it; repeated rows are documents of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(INDEX))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("key is not null and text is not null")
    return stored(rows.mapInArrow(partial(index_partition, schema=schema, shard_bytes=shard_bytes), INDEX), "index")


class Postings:
    """One term's list in a shard; blocks are decompressed when they are first read."""

    def __init__(self, row, weight: int, norms):
        array = lambda name, kind: np.frombuffer(getattr(row, name), kind)
        self.weight, self.norms = weight, norms
        self.df, self.last, self.at, self.data = int(row.df), array("last", np.int32), array("at", np.int32), array("data", np.uint8)
        self.limits = np.append(self.at, len(self.data))
        highest = self.scores(array("best_tf", np.int32), array("best_n", np.int32))
        self.maxima = np.append(np.maximum.reduceat(highest, array("best_at", np.int32)), 0)  # none behind the last block
        self.highest = int(self.maxima.max())
        # an unread block's places hold its last document, so the list is in order all along
        self.docs = np.repeat(self.last, BLOCK)[:self.df].copy()
        self.parts = np.zeros(self.df, np.int64)
        self.read = np.zeros(len(self.last), bool)

    def scores(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return self.weight * (1_000_000_000 * tf // (1000 * tf + 20 * self.norms(n)))

    def decompress(self, blocks: np.ndarray, lengths: np.ndarray) -> None:
        """Read the blocks that have not been read."""
        blocks = blocks[~self.read[blocks]]
        if not len(blocks):
            return
        for run in np.split(blocks, np.flatnonzero(np.diff(blocks) > 1) + 1):
            a, z = int(run[0]), int(run[-1]) + 1
            pairs = unpacked(self.data[self.limits[a]:self.limits[z]]).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0]) + (self.last[a - 1] if a else -1)
            here = slice(a * BLOCK, a * BLOCK + len(docs))
            self.docs[here], self.parts[here] = docs, self.scores(pairs[:, 1], lengths[docs])
        self.read[blocks] = True

    def within(self, lo: int, hi: int) -> tuple[int, int]:
        """The blocks that may hold documents from lo to hi - 1."""
        a, z = np.searchsorted(self.last, (lo, hi))
        return int(a), min(int(z) + 1, len(self.last))


def best_of_shard(lists: list[Postings], lengths: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best with a score above 0, highest first, ties by ascending document."""
    lists = sorted(lists, key=lambda p: p.highest)
    reach = np.cumsum([p.highest for p in lists])
    docs, scores, floor = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for lo in range(0, len(lengths), window):
        essential = int(np.searchsorted(reach, floor, side="right"))
        if essential == len(lists):
            break
        hi = min(lo + window, len(lengths))
        spans = [p.within(lo, hi) for p in lists]
        if sum(int(p.maxima[a:z].max(initial=0)) for p, (a, z) in zip(lists, spans)) <= floor:
            continue
        total = np.zeros(hi - lo, np.int64)
        for p, (a, z) in zip(lists[essential:], spans[essential:]):
            if a < z:
                p.decompress(np.arange(a, z), lengths)
                some = slice(*np.searchsorted(p.docs[a * BLOCK:z * BLOCK], (lo, hi)) + a * BLOCK)
                total[p.docs[some] - lo] += p.parts[some]
        found = np.flatnonzero(total)
        got, found = total[found], found + lo
        at = [np.searchsorted(p.last, found) for p in lists[:essential]]
        still = [p.maxima[i] for p, i in zip(lists, at)]
        bound = got + sum(still) if still else got
        for i in range(essential - 1, -1, -1):
            keep = bound > floor
            if not keep.all():
                found, got, bound = found[keep], got[keep], bound[keep]
                at, still = [x[keep] for x in at[:i + 1]], [x[keep] for x in still[:i + 1]]
            if not len(found):
                break
            p, blocks = lists[i], at[i]
            inside = blocks < len(p.last)
            p.decompress(np.unique(blocks[inside]), lengths)
            place = np.minimum(np.searchsorted(p.docs, found), p.df - 1)
            part = np.where(p.docs[place] == found, p.parts[place], 0)
            got, bound = got + part, bound - still[i] + part
        better = got > floor
        docs, scores = np.append(docs, found[better]), np.append(scores, got[better])
        first = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[first], scores[first]
        if len(docs) == k:
            floor = int(scores[-1])
    return docs, scores


def searching(queries, k: int, window: int, corpus: tuple[int, int]):
    """The k best documents of one shard for every query of the pass."""
    def search_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        items, terms, weights = queries.value
        head = pdf[pdf["term"].isna()].iloc[0]
        ids, lengths = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["lengths"], np.int32)
        documents, words = corpus
        norms = lambda n: 50 + 50 * n.astype(np.int64) * documents // words
        lists = {row.term: Postings(row, weights[row.term], norms) for row in pdf[pdf["term"].notna()].itertuples()}
        out = []
        for item, own in zip(items, terms):
            here = [lists[t] for t in own if t in lists]
            if here:
                docs, scores = best_of_shard(here, lengths, k, window)
                out.append(pd.DataFrame({"item": item, "doc": ids[docs], "score": scores}))
        return pd.concat(out).assign(shard=key[0])[["shard", "item", "doc", "score"]] if out \
            else pd.DataFrame({"shard": [], "item": [], "doc": [], "score": []}, dtype="int64")

    return search_shard


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = 50,
           window: int = WINDOW, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item, rank, doc, score): each item's k best documents of an index, ties by ascending document.

    Terms count once for each item; a term's weight is floor(1000 ln((2N+2)/(2df+1))), a document's share of it
    10^9 tf div (1000 tf + 20 m) with m = 50 + 50 n N div L. Items with a null id or text and items
    without terms of the index have no rows; equal rows are one item, and the texts of a repeated id are taken together.
    """
    spark = index.sparkSession
    plain = F.translate(F.col(f"`{text}`"), _UPPER, _LOWER)
    wanted = stored(items.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("item"), F.explode(F.regexp_extract_all(plain, F.lit(f"({TERM})"), F.lit(1))).alias("term")).distinct(), "wanted")
    documents, words = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    terms = wanted.select("term").distinct()
    counted = index.select("term", "df").join(terms, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = stored(wanted.join(counted.select("term", weight.alias("w")), "term"), "weighted")
    passes = max(1, -(-weighted.count() // pass_terms))
    found = spark.createDataFrame([], "item long, doc long, score long")
    for number in range(passes):
        some = weighted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number)
        grouped, weights = defaultdict(list), {}
        for item, term, w in some.select("item", "term", "w").collect():  # bounded by pass_terms
            grouped[item].append(term)
            weights[term] = w
        sent = spark.sparkContext.broadcast((list(grouped), list(grouped.values()), weights))
        rows = index.join(some.select("term").distinct(), "term", "left_semi").unionByName(index.where("term is null"))
        best = rows.groupBy("shard").applyInPandas(searching(sent, k, window, (documents, words)), "shard long, item long, doc long, score long")
        # heaps of some shards at a time, then of all
        near = Window.partitionBy("item", F.pmod(F.xxhash64("shard"), F.lit(64))).orderBy(F.desc("score"), "doc")
        found = found.unionByName(stored(best.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).select("item", "doc", "score"), "heaps"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc", "score")

