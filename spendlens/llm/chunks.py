"""Exact encoding of whole texts from memoised chunks.

A text is cut only where the tokenizer itself always begins a new piece, so the ids of the text
are the ids of its chunks in order. Natural text repeats its chunks, so each worker keeps those it
has met, up to ``KEPT`` of them, and the tokenizer library encodes the others in one batch.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Chunks a worker remembers at least, and twice as many at most (results are the same whatever it is).
KEPT = 120_000
#: Longer chunks are not remembered.
LONGEST = 256
#: Bytes of text in one batch for the library.
BATCH_BYTES = 1 << 20

#: A blank between two non-blanks: byte-level BPE always begins a piece with that blank.
BLANK = re.compile(r"(?<=\S) (?=\S)")


def worker_store() -> dict:
    """A dictionary that lives as long as the worker process: functions sent to it bring their own globals each time."""
    name = "spendlens_llm_worker"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def kept(key: str, make: Callable):
    """What ``make`` gives, made once for each worker."""
    store = worker_store()
    if key not in store:
        store[key] = make()
    return store[key]


def tokenizer(path: str):
    """The tokenizer of a ``.json`` file, without truncation or padding, loaded once for each worker."""
    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        return made

    return kept(f"tokenizer {path}", load)


def by_bytes(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about ``limit`` bytes; a longer text is a batch of its own."""
    batch, held = [], 0
    for text in texts:
        size = len(text.encode())
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += size
    if batch:
        yield batch


class Memo:
    """What ``encode`` gives for chunks: looked up, and computed in batches for those not met before."""

    def __init__(self, encode: Callable[[list[str]], list], least: int = KEPT):
        """least: how many chunks are remembered at least."""
        self.encode, self.least, self.known, self.older, self.long = encode, least, {}, {}, []

    def of(self, chunks: list[list[str]]) -> dict:
        """The results for all chunks of some texts, until the next call."""
        for chunk in self.long:
            self.known.pop(chunk, None)
        if len(self.known) > self.least:  # what is met again comes back from the older half
            self.known, self.older = {}, self.known
        new = set().union(*chunks).difference(self.known)
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new = sorted(new - again, key=len)  # of like length in one batch
        for batch in by_bytes(new):
            self.known.update(zip(batch, self.encode(batch), strict=True))
        self.long = [c for c in new if len(c) > LONGEST]
        return self.known


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch holding about ``limit`` bytes of text each; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)
