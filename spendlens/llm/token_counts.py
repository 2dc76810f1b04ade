"""Token counts: batch encoding in Arrow functions that return lengths only.

A long text is cut at safe boundaries (a blank between two non-blanks, where a byte-level BPE
always begins a piece; special strings hold no blank), and the counts of its pieces add up.
Batches for the tokenizer are balanced by bytes, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks


def _memo(path: str) -> chunks.Memo:
    """Chunk -> number of tokens, for the worker."""
    coder = chunks.tokenizer(path)
    count = lambda batch: [len(e) for e in coder.encode_batch_fast(batch, add_special_tokens=False)]
    return chunks.kept(f"counts {path}", lambda: chunks.Memo(count))


def safe_pieces(text: str) -> list[str]:
    """The text cut before each blank that stands between two non-blanks; joined they give the text."""
    if not text:
        return []
    first, *rest = chunks.BLANK.split(text)
    return [first, *[" " + x for x in rest]]


def counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library counts them without added special tokens."""
    pieces = [safe_pieces(t) for t in texts]
    known = _memo(path).of(pieces)
    return [sum(map(known.__getitem__, p)) for p in pieces]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for every row; null texts count as empty and give zeros.

    ``path`` names a byte-level BPE file of the tokenizers library that every executor can read.
    Repeated and null keys each keep their row; other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.text_slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), sizes, pa.array(counts(texts, path), pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
