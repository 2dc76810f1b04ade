"""BPE encoding and decoding of whole texts, long unsplit text by tree concatenation.

Texts are cut at white space, which the tokenizer drops and never encodes across. A run without
white space is encoded as it stands when it is short. In a long one, each piece that the
tokenizer would merge as a whole is halved again and again down to leaves; all leaves are encoded
apart, and neighbours are joined bottom-up: a window around the join is encoded anew and doubled
until its outer tokens equal those of both sides. A BPE sequence is right when each adjacent pair
of its tokens is, so agreement on both edges makes the joined sequence the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks

#: White space that the tokenizer drops and that no normal form joins with its neighbours.
SPACE = re.compile(r"[ \t\n\r]+")
#: Fixed pattern: the pieces in which the tokenizer merges lower-case text, and the characters (to U+00FF) it is used for.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile("[!-~\xa1-\xff]+")
#: Longer pieces that the tokenizer merges as a whole go through the tree.
LEAF = 128
#: Runs whose ids and decoded text a worker remembers at least, twice as many at most; about 250 bytes each.
RUNS = 250_000
#: Runs, and pieces, whose ids a worker remembers in columns at most; about 50 bytes each.
WORDS = 1 << 19
#: Slices gathered at once.
BLOCK = 1 << 16
#: Pieces in one text for the library.
JOINED = 256
#: Tokens on either side in the first window.
WINDOW = 4

Token = tuple[int, int]  # id, number of symbols


def concatenate(left: list[Token], right: list[Token], symbols: str, start: int,
                encode: Callable[[str], list[Token]], closed: bool) -> list[Token]:
    """The encoding of symbols[start:...] from those of its two halves.

    closed: whether ``right`` ends where the merged piece ends, as ``encode`` takes every text for a
    whole piece and marks its last symbol.
    """
    cut = start + sum(n for _, n in left)
    wide = WINDOW
    while True:
        a, b = left[max(0, len(left) - wide):], right[:wide]
        low, high = cut - sum(n for _, n in a), cut + sum(n for _, n in b)
        window = encode(symbols[low:high])
        all_left, all_right = len(a) == len(left), len(b) == len(right)
        if all_left and all_right:
            return window
        if all_left or window[0] == a[0]:
            if all_right and closed:
                return left[: len(left) - len(a)] + window
            joined = _meet(window, b, low, cut)
            if joined is not None:
                return left[: len(left) - len(a)] + joined + right[len(b):]
            if all_right:  # an open end: what encode marks there is mended at the next join
                return left[: len(left) - len(a)] + window
        wide *= 2


def _meet(window: list[Token], right: list[Token], low: int, cut: int) -> list[Token] | None:
    """The window up to the last token that the right half has too, then the right half's own."""
    spans, at = {}, cut
    for i, token in enumerate(right):
        spans[at, token] = i
        at += token[1]
    at, found = low, None
    for j, token in enumerate(window):
        if j and (at, token) in spans and (i := spans[at, token]) < len(right) - 1:
            found = window[:j] + right[i:]
        at += token[1]
    return found


def encode_long(symbols: str, encode: Callable[[str], list[Token]], leaf: int = LEAF) -> list[Token]:
    """The encoding of one merged piece: leaves apart, then joins of neighbours until one is left."""
    n = max(1, -(-len(symbols) // leaf))
    parts = 1 << (n - 1).bit_length()
    edges = sorted({len(symbols) * i // parts for i in range(parts + 1)})
    level = [(a, encode(symbols[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
    while len(level) > 1:
        level = [
            (a[0], concatenate(a[1], pair[1][1], symbols, a[0], encode, closed=i + 2 >= len(level))) if len(pair) == 2 else a
            for i in range(0, len(level), 2) for pair in (level[i: i + 2],) for a in (pair[0],)]
    return level[0][1] if level else []


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Coder:
    """Encodes and decodes runs without white space as the tokenizer of ``path`` does."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.tok, self.leaf = chunks.tokenizer(path), leaf
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = self.tok.model.end_of_word_suffix or ""
        self.merger, self.last = chunks.kept(f"merger {path}", lambda: self.merging(path))
        self.memo = chunks.Memo(self.library)

    def merging(self, path: str) -> tuple:
        """The tokenizer without normal form and pattern, which pieces are through with, and which ids end a piece."""
        from tokenizers import Tokenizer, pre_tokenizers

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        made.normalizer = None
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = made.get_vocab()
        last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        last[[i for t, i in vocabulary.items() if self.mark and t.endswith(self.mark)]] = True
        return made, last

    def symbols(self, piece: str) -> list[Token]:
        """Tokens of one merged piece with the symbols each of them spans."""
        return [(t.id, len(t.value.removesuffix(self.mark))) for t in self.tok.model.tokenize(piece)]

    def run(self, text: str) -> list[int]:
        """Ids of a long run: special strings and merged pieces as the tokenizer cuts them."""
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    found = self.symbols(piece) if len(piece) <= self.leaf else encode_long(piece, self.symbols, self.leaf)
                    ids += [i for i, _ in found]
        return ids

    def pieces(self, run: str) -> list[str] | None:
        """The pieces that a run of Latin letters, digits and signs is merged in; None for other runs.

        Such text has one normal form but for its case, and holds no special string.
        """
        return PIECES.findall(run.lower()) if len(run) <= self.leaf and PLAIN.fullmatch(run) and "<|" not in run else None

    def packed(self, runs: list[str]) -> list[bytes]:
        """Ids of each run as little-endian 32-bit integers: short ones by the library's batches, long ones by the tree."""
        pieces = [self.pieces(r) for r in runs]
        known = self.memo.of([p for p in pieces if p])
        short = [r for r, p in zip(runs, pieces, strict=True) if p is None and len(r) <= self.leaf]
        got = iter(self.library(short))
        return [b"".join(map(known.__getitem__, p)) if p is not None else next(got) if len(r) <= self.leaf else _bytes(self.run(r))
                for r, p in zip(runs, pieces, strict=True)]

    def library(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces of :meth:`pieces` one after the other, number for each piece): as from ``library``, but many
        pieces in one text, told apart by the ids that end a piece."""
        texts = [" ".join(pieces[i:i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.empty(0, "<u4"), *(np.array(e.ids, "<u4") for e in self.merger.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):  # a piece with signs that the vocabulary lacks at its end
            return joined(self.library(pieces))
        return ids, np.diff(ends, prepend=0)

    def encode(self, runs: list[str]) -> list[list[int]]:
        """Ids of each run."""
        return [np.frombuffer(b, "<u4").tolist() for b in self.packed(runs)]

    def told(self, runs: list[str]) -> list[tuple[int, str, str]]:
        """Of each run: number of ids, the ids as text, and what the library decodes them to."""
        ids = self.encode(runs)
        return [(len(x), " ".join(map(str, x)), d) for x, d in zip(ids, self.tok.decode_batch(ids, skip_special_tokens=False), strict=True)]

    def lines(self, runs: list[str]) -> list[str]:
        """Of each run one string: its ids, a line feed and what they decode to; empty if there are no ids.

        Tokens spell parts of the run, and a run holds no line feed, so there is just one.
        """
        return [ids + "\n" + decoded if n else "" for n, ids, decoded in self.told(runs)]


def memo(path: str, what: str, least: int = chunks.KEPT) -> chunks.Memo:
    """Run -> what a Coder's method gives for it, for the worker."""
    return chunks.kept(f"{what} {path}", lambda: chunks.Memo(getattr(Coder(path), what), least))


def gathered(pool: np.ndarray, start: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` that begin at ``start`` and are ``wide`` long, one after the other."""
    to = np.cumsum(wide)
    out = np.empty(to[-1] if len(to) else 0, pool.dtype)
    for i in range(0, len(to), BLOCK):  # the places of some slices at once
        own, low = wide[i:i + BLOCK], to[i] - wide[i]
        end = to[min(i + BLOCK, len(to)) - 1]
        out[low:end] = pool[np.repeat(start[i:i + BLOCK] - (to[i:i + BLOCK] - own), own) + np.arange(low, end)]
    return out


def joined(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after the other, and their number for each."""
    return np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4


class Memory:
    """Ids of distinct strings, looked up in columns and encoded if not met before."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = WORDS):
        """encode: (ids, number for each) of strings; most: how many are remembered; then the half not met for longest goes."""
        self.encode, self.most, self.clock = encode, most, 0
        self.words, self.ids = pa.array([], pa.string()), np.empty(0, "<u4")
        self.start, self.wide, self.met = (np.empty(0, np.int64) for _ in range(3))

    def of(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, number): the ids of a string stand from its start."""
        self.clock += 1
        place = pc.fill_null(pc.index_in(strings, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = place < 0
        self.met[place[~new]] = self.clock
        fresh = strings.filter(pa.array(new))
        added, wide = self.encode(fresh)
        ids = np.concatenate([self.ids, added])
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(wide) - wide])
        wide = np.concatenate([self.wide, wide])
        place[new] = len(self.words) + np.arange(len(fresh))
        short = pc.less_equal(pc.binary_length(fresh), chunks.LONGEST).to_numpy(zero_copy_only=False)
        kept = np.concatenate([np.arange(len(self.words)), len(self.words) + np.flatnonzero(short)])
        self.words = pa.concat_arrays([self.words, fresh.filter(pa.array(short))])
        met = np.concatenate([self.met, np.full(int(short.sum()), self.clock)])
        if len(kept) > self.most:
            half = np.sort(np.argsort(-met, kind="stable")[: self.most // 2])
            kept, met, self.words = kept[half], met[half], self.words.take(pa.array(half))
        self.met, self.wide = met, wide[kept]
        if len(kept) == len(start):
            self.ids, self.start = ids, start
        else:
            self.ids, self.start = gathered(ids, start[kept], self.wide), np.cumsum(self.wide) - self.wide
        return ids, start[place], wide[place]


class Words:
    """Ids of whole columns of texts: each distinct run, and each distinct piece of new runs, is looked up once."""

    def __init__(self, coder: Coder, most: int = WORDS):
        self.coder = coder
        self.runs, self.pieces = Memory(self.new_runs, most), Memory(lambda new: coder.merged(new.to_pylist()), most)

    def new_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each): as ``Coder.packed``, with the pieces of a column at once."""
        plain = pc.and_not(pc.and_(pc.match_substring_regex(runs, f"^(?:{PLAIN.pattern})$"), pc.less_equal(pc.utf8_length(runs), self.coder.leaf)),
                           pc.match_substring(runs, "<|"))
        lists = pc.ascii_split_whitespace(pc.ascii_ltrim_whitespace(
            pc.replace_substring_regex(pc.utf8_lower(runs.filter(plain)), f"({PIECES.pattern})", r" \1")))
        pieces = lists.flatten().dictionary_encode()
        ids, start, wide = self.pieces.of(pieces.dictionary)
        which = pieces.indices.to_numpy()
        ids, wide = gathered(ids, start[which], wide[which]), wide[which]
        to = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
        easy = plain.to_numpy(zero_copy_only=False)
        if easy.all():
            return ids, np.diff(to)
        rest, own = joined(self.coder.packed(runs.filter(pc.invert(plain)).to_pylist()))
        number, begin = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64)
        number[easy], begin[easy] = np.diff(to), to[:-1]
        number[~easy], begin[~easy] = own, len(ids) + np.cumsum(own) - own
        return gathered(np.concatenate([ids, rest]), begin, number), number

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end``; where each text ends)."""
        # ASCII blanks only: other white space stays in its run, which the library cuts
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        runs = lists.flatten().dictionary_encode()
        ids, start, wide = self.runs.of(runs.dictionary)
        closed = np.cumsum(lists.value_lengths().to_numpy())
        which = np.insert(runs.indices.to_numpy(), closed, len(wide))
        start, wide = np.append(start, len(ids))[which], np.append(wide, 1)[which]
        return gathered(np.append(ids, np.uint32(end)).astype("<u4"), start, wide), np.cumsum(wide)[closed + np.arange(len(closed))]


def words(path: str) -> Words:
    """The worker's ids of runs."""
    return chunks.kept(f"words {path}", lambda: Words(Coder(path)))


def runs_of(text: str) -> list[str]:
    """The text cut at white space. The characters 1C to 1F, which Python takes for such, are not."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [r for r in SPACE.split(text) if r]
    return text.split()


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each text, without added special tokens."""
    runs = [runs_of(t) for t in texts]
    known = memo(path, "packed").of(runs)
    return [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4").tolist() for own in runs]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row; with ``texts`` also ids and decoded.

    ``path`` names a BPE file with word ends of the tokenizers library (no decoder: token strings
    joined by a blank). Null and empty texts have no ids and decode to an empty string. Repeated
    and null keys each keep their row; other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.text_slices(batch, "text"):
                runs = [runs_of(t or "") for t in part.column("text").to_pylist()]
                known = memo(path, "lines", RUNS).of(runs)
                out: list[list] = [[], [], [], [], []]
                for own in runs:
                    told = "\n".join(filter(None, map(known.__getitem__, own))).split("\n")
                    ids, decoded = " ".join(told[::2]), " ".join(told[1::2])
                    out[0].append(ids.count(" ") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if texts:
                        out[3].append([int(i) for i in ids.split()])
                        out[4].append(decoded)
                arrays = [part.column("key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                if texts:
                    arrays += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return rows.mapInArrow(code, schema).withColumnRenamed("key", key)
