"""WARC archives: one gzip member per record, written and read in sequence by Spark tasks.

Writing: each task writes files of bounded size to the shared folder under a name of its own and
moves a file to its final name when it is complete; the files that count are those named in the
manifest, which Spark commits. A task that runs twice so leaves files nobody lists.
Reading: a task opens the files of its manifest rows one after the other and never holds more than
a block: incremental decompression, framing by Content-Length, digests checked on the way.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored

#: Bytes after which a task begins another file, and bytes read or decompressed at a time.
FILE_BYTES = 64 << 20
BLOCK = 1 << 16
#: Fixed date in the records: the tables carry none.
DATE = "2020-01-01T00:00:00Z"
#: An HTTP header block may not be longer than this many bytes; a longer one is reported as broken.
#: A record's own header holds its target, of any length, and may go on to the end of its gzip member.
HEADER_BYTES = 1 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a uri or of a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _headers(lines: list[tuple[str, str]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response, or a revisit of ``refers_to`` without its payload."""
    http = _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    body = http + (payload if refers_to is None else b"")
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", "sha1:" + b32(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", "sha1:" + b32(hashlib.sha1(body).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if refers_to is not None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_headers(lines, "WARC/1.1") + body + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, name: str = "warc", least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of pages (page_id, url, html); returns the manifest (path, records, bytes).

    Of records with equal payloads of at least ``least`` bytes, those with the largest page_id are
    responses and the others revisit it; smaller ones are all responses. Null html is an empty
    payload, a null url an empty target. A null page_id is smaller than any other: it revisits a
    numbered page with its payload, and is a response if there is none. Rows repeated under the
    largest page_id are responses each. Other columns are not read.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")) \
        .withColumn("sha", F.sha1("payload"))
    # the page to revisit, for payloads that several pages share
    first = stored(rows.where(F.length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
                   .where("n > 1 and target is not null").select("sha", "target"), "warc-first")
    rows = rows.join(first, "sha", "left").withColumn(
        "refers_to", F.when((F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("target")), F.col("target"))) \
        .select("page_id", "url", "payload", "refers_to")
    folder = new_path(pages.sparkSession, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, size, n, done = None, 0, 0, []

        def close():
            out.close()
            fs.move(f"{base}/.{part}", f"{base}/{part}")
            done.append((f"{folder}/{part}", n, size))

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    part, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/.{part}", compression=None)
                data = record(*(batch.column(k)[i].as_py() for k in ("page_id", "url", "payload", "refers_to")))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]},
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stored(rows.mapInArrow(write, "path string, records long, bytes long"), name + "-manifest")


class _Member:
    """One gzip member of a stream, read in blocks."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.raw, self.data = stream, rest, b""
        self.packer = zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompress another block into ``data``; False at the end of the member."""
        while not self.packer.eof:
            raw = self.packer.unconsumed_tail or self.raw or self.stream.read(BLOCK)
            self.raw = b""
            if not raw:
                raise EOFError("the file ends inside a record")
            got = self.packer.decompress(raw, BLOCK)
            if got:
                self.data += got
                return True
        return False

    def block(self, end: bytes, most: int | None = None) -> bytes:
        """What comes up to ``end``, which is dropped."""
        held, seen = bytearray(self.data), 0
        while (at := held.find(end, seen)) < 0:
            seen, self.data = max(0, len(held) - len(end) + 1), b""
            if most is not None and len(held) > most or not self.more():
                raise ValueError("no end of headers")
            held += self.data
        self.data = bytes(held[at + len(end):])
        return bytes(held[:at])

    def rest(self) -> bytes:
        """What follows the member in the file."""
        while self.more():
            self.data = b""
        return self.packer.unused_data


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def records(stream, payloads: bool) -> Iterator[dict]:
    """The records of one archive, in order; a broken one ends the file with its ``error`` set."""
    raw = stream.read(BLOCK)
    while raw:
        row = dict.fromkeys(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error"))
        try:
            member = _Member(stream, raw)
            head = _fields(member.block(b"\r\n\r\n"))
            left, whole, own, kept = int(head["content-length"]), hashlib.sha1(), hashlib.sha1(), []
            http = member.block(b"\r\n\r\n", HEADER_BYTES) + b"\r\n\r\n"
            whole.update(http)
            left -= len(http)
            size = 0
            while left > 0:
                if not member.data and not member.more():
                    raise ValueError("the record is shorter than its Content-Length")
                piece, member.data = member.data[:left], member.data[left:]
                left, size = left - len(piece), size + len(piece)
                whole.update(piece)
                own.update(piece)
                if payloads:
                    kept.append(piece)
            while len(member.data) < 4 and member.more():
                pass
            row |= {"page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
                    "refers_to": _page(head.get("warc-refers-to")), "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
                    "payload_bytes": int(_fields(http[:-4])["content-length"]), "payload": b"".join(kept) if payloads else None}
            if left < 0 or member.data != b"\r\n\r\n" or member.more():
                raise ValueError("the record does not end where its Content-Length says")
            if head["warc-block-digest"] != "sha1:" + b32(whole.digest()):
                raise ValueError("wrong block digest")
            if head["warc-type"] == "response" and (row["payload_digest"] != b32(own.digest()) or size != row["payload_bytes"]):
                raise ValueError("wrong payload digest or length")
            raw = member.rest() or stream.read(BLOCK)
        except (ValueError, KeyError, EOFError, zlib.error) as e:
            row["error"], raw = f"{type(e).__name__}: {e}", b""
        yield row


def read_warc(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the files in ``manifest`` (path); with ``payloads`` their bytes too (null for revisits).

    A record that is cut off, does not fit its Content-Length or fails a digest gives a row with
    ``error`` set, and nothing after it in its file is read. An empty manifest gives no rows.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, own = filesystem(path)
                with fs.open_input_stream(own, compression=None) as stream:
                    held, size = [], 0
                    for row in records(stream, payloads):
                        held.append(row)
                        size += 200 + len(row["payload"] or b"") + len(row["url"] or "")
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    # one file is one unit of work, however few bytes its manifest row has
    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to long, payload binary, error string")
