"""Token ids in grammar-compressed files that can be read at any place.

The ids of the documents, in ascending key order, each closed by an end id, are cut into shards. A
shard's ids are compressed by Re-Pair: frequent pairs of neighbouring ids are replaced by a new
nonterminal, for ``ROUNDS`` rounds at most, so that pairs that repeat may be left. Many pairs are replaced in a round, the most
frequent first where they overlap. A file holds its shards one after the other, each with its
rules, the expansion length of every rule, the ends of its documents and the sequence that is left;
a document is found by the lengths and expanded without the rest of the shard.

File: the magic, then for each shard a header of eight 64-bit numbers (number of documents, ids,
rules, symbols, first nonterminal, bytes a symbol, null keys, ids of the file before this shard) and
the arrays: keys (i64), ends of documents (i64), left and right of each rule and its expansion length
(u32), symbols.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks, tree_bpe
from .common import new_path, stored
from .warc import filesystem

MAGIC = b"RPIDS001"
END = 2
#: First nonterminal: above every id of the vocabulary.
BASE = 1 << 17
#: Ids in a shard, about; rounds of replacement, and how often a pair must stand in the shard.
SHARD_IDS, ROUNDS, LEAST = 1 << 20, 8, 6
#: Slots that a round counts pairs in, as a power of two.
SLOT_BITS = 21
#: Bytes of text that are encoded at once, about.
SLICE_BYTES = 16 << 20
#: Bytes of text in a file, about.
FILE_BYTES = 32 << 20


def frequent(seq: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, pair of each place, pairs ascending, how often each stands) of the pairs that stand at the places ``at``,
    without those in slots of a hash that are met fewer than ``least`` times."""
    a = seq.view(np.uint32)
    slot = a[at] * np.uint32(2654435761) + a[at + 1] * np.uint32(2246822519)
    slot ^= slot >> np.uint32(15)
    slot *= np.uint32(739982445)
    slot >>= np.uint32(32 - SLOT_BITS)
    full = np.bincount(slot, minlength=1 << SLOT_BITS) >= least
    some = full[slot]
    at, slot = at[some], slot[some]
    key = (seq[at].astype(np.int64) << 32) | seq[at + 1]
    # a slot of one pair numbers its places; those of slots with more pairs are sorted
    one = np.empty(1 << SLOT_BITS, np.int64)
    one[slot] = key
    mixed = np.zeros(1 << SLOT_BITS, bool)
    mixed[slot[one[slot] != key]] = True
    shared = mixed[slot]
    full &= ~mixed
    alone = np.flatnonzero(full)
    others, which = np.unique(key[shared], return_inverse=True)
    pairs = np.concatenate([one[alone], others])
    by = np.argsort(pairs)
    number = np.empty(len(pairs), np.int32)
    number[by] = np.arange(len(pairs), dtype=np.int32)
    of_slot = np.empty(1 << SLOT_BITS, np.int32)
    of_slot[alone] = number[:len(alone)]
    kind = of_slot[slot]
    kind[shared] = number[len(alone):][which]
    return at, kind, pairs[by], np.bincount(kind, minlength=len(pairs))


def repair(ids: np.ndarray, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules as pairs, expansion lengths) of ids below BASE; the rules of a round use those before it."""
    seq, rules, lengths = ids.astype(np.int32), [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    made = 0
    size = np.ones(0, np.int64)
    none = np.iinfo(np.int32).max
    at = np.arange(len(seq) - 1)
    for _ in range(rounds):
        if len(seq) < 2 * least:
            break
        at, kind, run, count = frequent(seq, at, least)
        if not len(at):
            break
        often = np.flatnonzero(count >= least)
        rank = np.full(len(run), none, np.int32)
        rank[often[np.argsort(-count[often], kind="stable")]] = np.arange(len(often), dtype=np.int32)
        # priority of the pair at each place; where pairs overlap the more frequent, then the left one, is replaced
        pair = np.full(len(seq) + 2, none, np.int32)
        left, here, right = pair[:-2], pair[1:-1], pair[2:]
        here[at] = rank[kind]
        taken = np.zeros(len(seq), bool)
        for _ in range(4):
            win = (here < left) & (here <= right)
            taken |= win
            gone = win * np.int32(none)
            here |= gone
            left |= gone
            right |= gone
            pair[0] = pair[-1] = none
        won = taken[at]
        place, kind = at[won], kind[won]
        used = np.bincount(kind, minlength=len(run))
        good = used > 2
        if not good.any():
            break
        keep = good[kind]
        place, which = place[keep], (np.cumsum(good) - 1)[kind[keep]]
        kinds = run[good]
        pairs = np.stack([kinds >> 32, kinds & 0xFFFFFFFF], axis=1)
        rules.append(pairs)
        both = np.where(pairs >= BASE, size[np.maximum(pairs - BASE, 0)] if made else 1, 1)
        lengths.append(both.sum(axis=1))
        before = len(seq)
        seq[place] = BASE + made + which
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        # a pair that is frequent in the next round holds a new symbol or was so in this one
        near = np.zeros(len(seq), bool)
        near[at] = True
        near[place] = True
        near = near[stay]
        seq = seq[stay]
        fresh = seq >= BASE + made
        near[:-1] |= fresh[1:]
        near[-1] = False
        at = np.flatnonzero(near)
        made += len(kinds)
        size = np.concatenate(lengths)
        if before - len(seq) < before // 200:
            break
    return seq.astype(np.int64), np.concatenate(rules), np.concatenate(lengths)


def expand(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that a sequence stands for."""
    while len(big := np.flatnonzero(seq >= BASE)):
        wide = np.ones(len(seq), np.int64)
        wide[big] = 2
        to = np.cumsum(wide) - wide
        out = np.empty(len(seq) + len(big), np.int64)
        pairs = rules[seq[big] - BASE]
        out[to] = seq
        out[to[big]], out[to[big] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


@dataclass
class Shard:
    keys: np.ndarray
    nulls: int
    ends: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    seq: np.ndarray
    before: int = 0

    @classmethod
    def of(cls, keys: list, docs: list[np.ndarray], before: int) -> Shard:
        """A shard of documents in order; null keys come first."""
        nulls = sum(k is None for k in keys)
        seq, rules, lengths = repair(np.concatenate(docs))
        return cls(np.array([k or 0 for k in keys], np.int64), nulls, np.cumsum([len(d) for d in docs]), rules, lengths, seq, before)

    def bytes(self) -> bytes:
        width = 3 if BASE + len(self.rules) <= 1 << 24 else 4
        head = np.array([len(self.keys), self.ends[-1], len(self.rules), len(self.seq), BASE, width, self.nulls, self.before], "<i8")
        symbols = np.ascontiguousarray(self.seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
        return b"".join([head.tobytes(), self.keys.astype("<i8").tobytes(), self.ends.astype("<i8").tobytes(), self.rules.astype("<u4").tobytes(),
                         self.lengths.astype("<u4").tobytes(), symbols.tobytes()])

    @classmethod
    def read(cls, stream) -> Shard | None:
        """The next shard of a file, None at its end."""
        head = stream.read(64)
        if not head:
            return None
        docs, _, rules, symbols, base, width, nulls, before = np.frombuffer(head, "<i8").tolist()
        if base != BASE:
            raise ValueError("another first nonterminal")
        take = lambda kind, n: np.frombuffer(stream.read(n * np.dtype(kind).itemsize), kind)
        keys, ends, pairs, lengths = take("<i8", docs), take("<i8", docs), take("<u4", 2 * rules), take("<u4", rules)
        raw = np.zeros((symbols, 4), np.uint8)
        raw[:, :width] = take("u1", symbols * width).reshape(-1, width)
        return cls(keys, nulls, ends, pairs.reshape(-1, 2).astype(np.int64), lengths.astype(np.int64), raw.view("<u4")[:, 0].astype(np.int64), before)

    def ids(self) -> np.ndarray:
        """All ids: every rule is expanded once, then the symbols' expansions follow each other."""
        pool = np.concatenate([np.arange(BASE), expand(BASE + np.arange(len(self.rules)), self.rules)])
        wide = np.concatenate([np.ones(BASE, np.int64), self.lengths])
        return tree_bpe.gathered(pool, (np.cumsum(wide) - wide)[self.seq], wide[self.seq])

    def document(self, i: int) -> np.ndarray:
        """The ids of one document: only the symbols over it are expanded."""
        a, b = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        reach = np.cumsum(np.where(self.seq >= BASE, self.lengths[np.maximum(self.seq - BASE, 0)] if len(self.lengths) else 1, 1))
        low, high = np.searchsorted(reach, a, side="right"), np.searchsorted(reach, b)
        begin = int(reach[low - 1]) if low else 0
        return expand(self.seq[low:high + 1], self.rules)[a - begin:b - begin]


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Encode every text, close it by ``end`` and write the files; returns the manifest (path, file, n_docs, n_ids, start).

    path: a BPE file with word ends of the tokenizers library. Null and empty texts are the end id
    alone. Files follow each other in ascending key order, null keys first, rows that share a key
    in the order of their text's hash. start: ids in the files before. No rows: no files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")) \
        .withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    folder = new_path(spark, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part = f"{uuid.uuid4().hex}.rpids"
        known = tree_bpe.words(path)
        out, keys, held, total, n_docs = None, [], [], 0, 0

        def flush():
            nonlocal total, n_docs
            shard = Shard.of(keys, held, total)
            out.write(shard.bytes())
            total, n_docs = total + int(shard.ends[-1]), n_docs + len(keys)
            keys.clear()
            held.clear()

        size = 0
        for batch in batches:
            for piece in chunks.text_slices(batch, "text", SLICE_BYTES):
                ids, ends = known.encode(piece.column("text"), end)
                for k, own in zip(piece.column("key").to_pylist(), np.split(ids, ends[:-1]), strict=True):
                    if out is None:
                        out = fs.open_output_stream(f"{base}/.{part}", compression=None)
                        out.write(MAGIC)
                    held.append(own)
                    keys.append(k)
                    size += len(own)
                    if size >= SHARD_IDS:
                        flush()
                        size = 0
        if keys:
            flush()
        if out is not None:
            out.close()
            fs.move(f"{base}/.{part}", f"{base}/{part}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{part}"], "file": [TaskContext.get().partitionId()], "n_docs": [n_docs], "n_ids": [total]}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("file", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    dealt = rows.repartitionByRange(files, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    manifest = stored(dealt.mapInArrow(write, "path string, file long, n_docs long, n_ids long"), "ids-manifest")
    # one short row for each file: their running total
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return stored(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "ids-files")


def read_ids(manifest: DataFrame, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files; with ``ids`` the ids too."""
    names = ["key", "start", "n_tokens", "ids_crc32", "ids"][: 5 if ids else 4]
    schema = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.list_(pa.int32())], strict=False)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, own = filesystem(place)
                with fs.open_input_stream(own, compression=None) as stream:
                    if stream.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"not a file of ids: {place}")
                    while (shard := Shard.read(stream)) is not None:
                        raw = shard.ids().astype("<u4")
                        begin = np.concatenate(([0], shard.ends[:-1]))
                        view = memoryview(raw.tobytes())
                        crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begin.tolist(), shard.ends.tolist(), strict=True)]
                        arrays = [pa.array(shard.keys, mask=np.arange(len(shard.keys)) < shard.nulls), pa.array(begin + shard.before + start),
                                  pa.array(shard.ends - begin), pa.array(crc, pa.int64())]
                        if ids:
                            arrays.append(pa.array([raw[a:b].astype(np.int32) for a, b in zip(begin, shard.ends, strict=True)], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    files = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return files.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids).withColumnRenamed("key", key)
