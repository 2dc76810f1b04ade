"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so that neighbours share most bits. Runs of neighbours are
leaves; a node keeps the bits that all fingerprints below it share (mask and pattern), and upper
nodes factor out what their children share. Two nodes whose shared bits already differ in more
places than allowed are pruned with all that is below them; what is left is compared bit by bit.

The top of the index is what is dealt over the cluster: the 64 bits are cut into blocks, and a top
node is the set of fingerprints with the same bits in some of them. Fingerprints within the
distance differ in few blocks, so they meet below at least one top node. A top node with too many
fingerprints is replaced by nodes that share one more part of the bits, chosen so that still no
pair is lost; only distinct fingerprints are ever indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import connected_components, forget, stored

SEED = 42
#: Fingerprints below a top node at most, before it is split.
NODE_ROWS = 4096
#: Fingerprints in a leaf, and children of an upper node.
LEAF, FANOUT = 16, 8
#: Shingles hashed at a time.
SHINGLES = 1 << 17


def fingerprints(texts: list[str], width: int = 3) -> np.ndarray:
    """64-bit SimHash of each text over its word shingles, repeats included (uint64).

    Words are runs of bytes other than blank and 09 to 0D, A-Z in lower case. Fewer words than
    ``width``: the whole sequence is the one shingle. No words: zero.
    """
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush():
        if owners:
            values = np.array(hashes, np.uint64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.array([n for _, n in owners])
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            for (i, _), set_bits in zip(owners, ones, strict=True):
                votes[i] += set_bits
            hashes.clear()
            owners.clear()

    votes = np.zeros((len(texts), 64), np.int64)
    totals = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = max(1, len(words) - width + 1)
        totals[i] = n
        first, last = starts[:n].tolist(), (ends[width - 1:] if len(words) >= width else ends[-1:]).tolist()
        for at in range(0, n, SHINGLES):
            some = [digest(line[a:b], SEED) for a, b in zip(first[at:at + SHINGLES], last[at:at + SHINGLES], strict=True)]
            hashes += some
            owners.append((i, len(some)))
            if len(hashes) >= SHINGLES:
                flush()
    flush()
    set_bits = (votes * 2 > totals[:, None]).astype(np.uint8)
    out[:] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)[:, 0] if len(texts) else out
    return out


def fingerprint_table(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, fp long) for every row."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.text_slices(batch, "text"):
                fps = fingerprints([t or "" for t in part.column("text").to_pylist()], width)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fps.view(np.int64))], ["key", "fp"])

    return rows.mapInArrow(mark, "key long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, as a signed long in the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(bits: list[int], n: int) -> list[int]:
    """The bit positions cut into n masks of like size."""
    return [sum(1 << b for b in bits[len(bits) * i // n: len(bits) * (i + 1) // n]) for i in range(n)]


def top_masks(distance: int) -> list[int]:
    """Masks such that any two fingerprints within the distance agree on one of them at least."""
    blocks = _parts(list(range(64)), distance + 2)
    return [_signed(a | b) for a, b in combinations(blocks, 2)]


def finer_masks(hot: DataFrame, distance: int) -> DataFrame:
    """(mask, shared, finer): the masks that replace each node's, given the bits that ``vary`` in it.

    Those bits are cut into distance + 1 parts; two fingerprints of the node that are within the
    distance agree on one part. Each finer mask holds one part and all bits that don't vary, so the
    bits left free are about a quarter fewer (distance 3) at each split.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, s, _signed((~v | part) & (1 << 64) - 1)) for m, s, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for part in _parts([b for b in range(64) if v >> b & 1], distance + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["mask", "shared", "finer"])

    return hot.select("mask", "shared", "vary").mapInArrow(cut, "mask long, shared long, finer long")


def top_nodes(fps: DataFrame, distance: int, most: int) -> DataFrame:
    """(mask, shared, fp, node): each distinct fingerprint below its top nodes, none of them above ``most`` rows.

    Each level leaves fewer bits free, and a node with few bits free is small: 2 to that number. A
    node with no more free bits than the distance is not split: all its fingerprints are links.
    """
    under = lambda masks: F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    most, done = max(most, 64), []
    rows = fps.select("fp", "node", under(top_masks(distance)).alias("mask"))
    while True:
        rows = rows.withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "shared").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("vary"))
        sizes = stored(sizes.where((F.col("n") > int(most)) & (F.bit_count("vary") > distance)).drop("n"), "hot-nodes")
        if sizes.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(sizes, ["mask", "shared"], "left_anti"))
        finer = stored(finer_masks(sizes, distance), "finer-masks")
        rows = stored(rows.join(finer, ["mask", "shared"]).select("fp", "node", F.col("finer").alias("mask")).distinct(), "split-nodes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def index_links(fps: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) within the distance in the same group; fps stand by group, then Gray rank.

    Nodes that share all but ``distance`` bits hold only such pairs and give a star, not all of them.
    """
    n = len(fps)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    # leaves: runs of LEAF neighbours of one group
    per = -(-sizes // LEAF)
    leaf_group = np.repeat(np.arange(len(starts)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = starts[leaf_group] + nth * LEAF
    end = np.minimum(begin + LEAF, starts[leaf_group] + sizes[leaf_group])
    levels = [(np.bitwise_and.reduceat(fps, begin), np.bitwise_or.reduceat(fps, begin), leaf_group, begin, end)]
    # upper nodes: FANOUT children of one group, up to one root for each group
    kids = []
    while len(levels[-1][0]) > len(starts):
        all_and, all_or, own, _, _ = levels[-1]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        count = np.diff(np.concatenate((first, [len(own)])))
        per = -(-count // FANOUT)
        up = np.repeat(np.arange(len(first)), per)
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        low = first[up] + nth * FANOUT
        high = np.minimum(low + FANOUT, first[up] + count[up])
        kids.append((low, high))
        levels.append((np.bitwise_and.reduceat(all_and, low), np.bitwise_or.reduceat(all_or, low), own[low], levels[-1][3][low], levels[-1][4][high - 1]))
    out_a, out_b = [], []
    one = two = np.arange(len(levels[-1][0]))  # pairs of nodes, from the roots down
    for depth in range(len(levels) - 1, -1, -1):
        all_and, all_or, _, begin, end = levels[depth]
        mask = ~(all_and ^ all_or)
        # differences so far: shared bits of both that are not the same
        apart = np.bitwise_count((all_and[one] ^ all_and[two]) & mask[one] & mask[two])
        keep = apart <= distance
        one, two = one[keep], two[keep]
        # all pairs below are links: the bits not shared by both, or shared and different, are few
        free = 64 - np.bitwise_count(mask[one] & mask[two]) + apart[keep]
        close = free <= distance
        for a, b in zip(one[close].tolist(), two[close].tolist(), strict=True):
            rest = np.concatenate((np.arange(begin[a] + 1, end[a]), np.arange(begin[b], end[b]) if a != b else np.empty(0, np.int64)))
            out_a.append(np.full(len(rest), begin[a]))
            out_b.append(rest)
        one, two = one[~close], two[~close]
        if depth:
            low, high = kids[depth - 1]
            wide_a, wide_b = high[one] - low[one], high[two] - low[two]
            total = wide_a * wide_b
            which = np.repeat(np.arange(len(one)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            a, b = low[one][which] + k // wide_b[which], low[two][which] + k % wide_b[which]
            keep = a <= b
            one, two = a[keep], b[keep]
    for at in range(0, len(one), 4096):
        a, b = one[at:at + 4096], two[at:at + 4096]
        grid = np.arange(LEAF)
        i, j = begin[a][:, None] + grid, begin[b][:, None] + grid
        i_ok, j_ok = i < end[a][:, None], j < end[b][:, None]
        i, j = np.where(i_ok, i, 0), np.where(j_ok, j, 0)
        near = (np.bitwise_count(fps[i][:, :, None] ^ fps[j][:, None, :]) <= distance) & i_ok[:, :, None] & j_ok[:, None, :] \
            & (i[:, :, None] < j[:, None, :])
        p, q, r = np.nonzero(near)
        out_a.append(i[p, q])
        out_b.append(j[p, r])
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place reachable by the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near_links(nodes: DataFrame, distance: int, most: int = NODE_ROWS) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within the distance do.

    nodes: distinct fp, and node (long). What a task finds below its top nodes is reduced to one
    link for each fingerprint and group, so no group is written as all of its pairs.
    """
    rows = top_nodes(nodes, distance, most)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("mask", "shared", "fp", "node").repartition(parts, "mask", "shared") \
        .sortWithinPartitions("mask", "shared", gray_rank(F.col("fp")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def found(mask, shared, fps, node):
            new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1])))
            group = np.cumsum(new)
            more = np.bincount(group)[group] > 1
            fps, node, group = fps[more], node[more], group[more]
            if len(fps):
                a, b = index_links(fps.view(np.uint64), group, distance)
                root = smallest_reachable(len(fps), a, b)
                own = np.flatnonzero(root != np.arange(len(root)))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "shared", "fp", "node")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0]  # may go on in the next batch
            yield from found(*[x[:last] for x in now]) if last else ()
            held = [x[last:] for x in now]
        if held is not None and len(held[0]):
            yield from found(*held)

    return rows.mapInArrow(link, "a long, b long").distinct()


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for every row.

    fingerprint: 16 lowercase hex digits. Fingerprints that differ in ``distance`` bits or fewer are
    linked; component_id is the smallest key reachable. Texts without words (null, empty, blanks)
    have fingerprint zero and are linked like any other. Repeated rows keep their rows and share a
    component. Rows with a null key link nothing: they get a fingerprint, and the component of
    other rows with the same fingerprint if there are any, else null. Other columns are not read.
    """
    marked = stored(fingerprint_table(docs, key, text, width), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("key").alias("node")), "distinct")
    links = stored(near_links(distinct.where("node is not null"), distance), "links")
    found = connected_components(links)
    named = stored(distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "components")
    # a fingerprint may have a large share of the rows: a plain join of two tables, which Spark can split
    out = marked.join(named, "fp", "left")
    forget(links)
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
