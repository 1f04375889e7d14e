"""WARC archives: writing, normalising monolithic gzip files, and reading by offset index.

A monolithic archive is one gzip stream over all its records, so no record can
be read without inflating all before it. ``normalise_archives`` inflates each
stream once, rewrites every record as a gzip member of its own, and writes a
sidecar index (``<archive>.idx``: offset, length, type and record id, tab
separated), after which any record is one ranged read. On the way, records whose
payload another record has already become revisit records without payload.

A task handles one file as a stream: it holds one inflate window and one record's
headers, and passes payloads on in pieces. Files get a name of their own per attempt, and only the
names that committed tasks return are used, so a repeated task leaves at most an
unused file. Folders are URIs that pyarrow's file systems open.

Defined results: a null payload is empty. Of equal payloads of at least
``min_bytes`` bytes the smallest page_id is the response (null ids last; of
repeated ids the first written). A damaged or truncated stream raises
``ValueError``. Empty tables give no archives and no records. Columns other than
those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.staging import bounded_batches, new_folder, stored

ARCHIVE_BYTES = 16 << 20
_PIECE = 1 << 16
_DATE = "2024-01-01T00:00:00Z"
WRITTEN = "file string, ordinal long, page_id long, payload_bytes long, payload_digest string"
INDEXED = "file string, records long"
RECORDS = (
    "file string, offset long, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; also of the one-slash form ``file:/x``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest_of(payload: bytes) -> str:
    """SHA-1 in base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_head(kind: str, page_id: int | None, url: str | None, digest: str, size: int, body: int, refers_to: int | None = None) -> bytes:
    """Header block of a record; ``size`` is of the full payload, ``body`` of what follows here."""
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}|{url}|{digest}|{kind}|{refers_to}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page: {'' if refers_to is None else refers_to}")
    lines.append(f"Content-Length: {body}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if line)}


class InflatedRecords:
    """Records of a gzip stream (of any number of members), inflated once, in pieces."""

    def __init__(self, raw):
        self.raw = raw
        self.inflate = zlib.decompressobj(31)
        self.held = b""
        self.ended = False

    def _more(self) -> bool:
        """Inflate another piece; False at the end of the file."""
        if self.ended:
            return False
        data = self.inflate.unconsumed_tail or self.inflate.unused_data or self.raw.read(_PIECE)
        if self.inflate.eof and data:
            self.inflate = zlib.decompressobj(31)
        if not data:
            rest = b"" if self.inflate.eof else self.inflate.decompress(b"", _PIECE)
            if not rest and not self.inflate.eof:
                raise ValueError("truncated gzip stream")
            self.held += rest
            self.ended = not rest
            return bool(rest)
        try:
            self.held += self.inflate.decompress(data, _PIECE)
        except zlib.error as e:
            raise ValueError(f"damaged gzip stream: {e}") from e
        return True

    def heads(self) -> Iterator[dict[str, str]]:
        """Each record's headers; its payload must be taken by :meth:`payload` before the next."""
        while True:
            while b"\r\n\r\n" not in self.held:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("truncated record")
                    return
            head, self.held = self.held.split(b"\r\n\r\n", 1)
            yield parse_head(head.lstrip(b"\r\n"))

    def payload(self, length: int) -> Iterator[bytes]:
        """The record's body in pieces, and the blank lines behind it."""
        left = length
        while left:
            if not self.held and not self._more():
                raise ValueError("truncated record")
            part, self.held = self.held[:left], self.held[left:]
            left -= len(part)
            if part:
                yield part
        while len(self.held) < 4 and self._more():
            pass
        if self.held[:4] != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")
        self.held = self.held[4:]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a response record per row into monolithic archives of about ``archive_bytes`` inflated bytes.

    Returns :data:`WRITTEN`, one row per record, lazily: consume it once.
    """
    bounded_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        out = deflate = name = None
        size = ordinal = 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                page_id, url, payload = page_id.as_py(), url.as_py(), (html.as_py() or "").encode()
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, deflate, size, ordinal = fs.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                digest = digest_of(payload)
                record = record_head("response", page_id, url, digest, len(payload), len(payload)) + payload + b"\r\n\r\n"
                out.write(deflate.compress(record))
                rows.append((f"{folder}/{name}", ordinal, page_id, len(payload), digest))
                ordinal += 1
                size += len(record)
                if size >= archive_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                    names=["file", "ordinal", "page_id", "payload_bytes", "payload_digest"],
                )
        if out is not None:
            out.write(deflate.flush())
            out.close()

    return pages.select("page_id", "url", "html").mapInArrow(write, WRITTEN)


def revisits(written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(file, ordinal, refers_to) of the records whose payload an earlier page has.

    Minima per digest are combined before the shuffle; only digests that occur
    again are joined back, and a hot one is split by the engine.
    """
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "file", "ordinal")
    long_enough = written.where(F.col("payload_bytes") >= min_bytes)
    first = long_enough.groupBy("payload_digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = long_enough.join(first, "payload_digest")
    other = (F.col("file") != F.col("first.file")) | (F.col("ordinal") != F.col("first.ordinal"))
    return again.where(other).select("file", "ordinal", F.col("first.page_id").alias("refers_to"))


def normalise_archives(files: DataFrame, repeated: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives named in ``files`` (column file), a member per record, with sidecar indexes.

    ``repeated`` are :func:`revisits`. Returns :data:`INDEXED`, one row per new archive, lazily: consume it once.
    """
    n = max(1, files.count())
    per_file = repeated.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "refers_to"))).alias("revisits"))
    jobs = files.select("file").join(per_file, "file", "left").repartition(min(n, 100_000), "file")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, again in zip(batch["file"].to_pylist(), batch["revisits"].to_pylist()):
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                count = normalise_file(file, target, dict(again or ()))
                yield pa.RecordBatch.from_pydict({"file": [target], "records": [count]})

    return jobs.mapInArrow(rewrite, INDEXED)


def normalise_file(source: str, target: str, again: dict[int, int | None]) -> int:
    """One archive, as a stream; ``again``: by ordinal, the page whose payload the record repeats."""
    fs, path = opened(source)
    out_fs, out_path = opened(target)
    out_fs.create_dir(out_path.rpartition("/")[0], recursive=True)
    index = []
    with fs.open_input_stream(path, compression=None) as raw, out_fs.open_output_stream(out_path, compression=None) as out:
        offset = 0
        records = InflatedRecords(raw)
        for ordinal, head in enumerate(records.heads()):
            body = int(head["content-length"])
            page = int(head["x-page-id"]) if "x-page-id" in head else None
            repeated = ordinal in again
            kind = "revisit" if repeated else head["warc-type"]
            size = int(head["x-payload-length"])
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            new_head = record_head(kind, page, head.get("warc-target-uri"), digest, size, 0 if repeated else body, again.get(ordinal))
            length = out.write(deflate.compress(new_head)) or 0
            for part in records.payload(body):
                if not repeated:
                    length += out.write(deflate.compress(part)) or 0
            length += out.write(deflate.compress(b"\r\n\r\n") + deflate.flush()) or 0
            index.append(f"{offset}\t{length}\t{kind}\t{parse_head(new_head)['warc-record-id']}\n")
            offset += length
    with out_fs.open_output_stream(out_path + ".idx") as out:
        out.write("".join(index).encode())
    return len(index)


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """:data:`RECORDS` of normalised archives (column file), each record by a ranged read at its indexed offset.

    ``payload_bytes`` and ``payload_digest`` of a response are computed from the bytes read.
    """
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["file"].to_pylist():
                fs, path = opened(file)
                with fs.open_input_stream(path + ".idx") as sidecar:
                    entries = [line.split("\t") for line in sidecar.read().decode().splitlines()]
                with fs.open_input_file(path) as archive:
                    rows, held = [], 0
                    for offset, length, *_ in entries:
                        rows.append(_record(file, int(offset), archive.read_at(int(length), int(offset)), with_payload))
                        held += len(rows[-1]["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return files.select("file").repartition(min(n, 100_000), "file").mapInArrow(read, RECORDS)


def _record(file: str, offset: int, member: bytes, with_payload: bool) -> dict:
    head, body = zlib.decompress(member, 31).split(b"\r\n\r\n", 1)
    head = parse_head(head)
    payload = body[: int(head["content-length"])]
    revisit = head["warc-type"] == "revisit"
    return {
        "file": file,
        "offset": offset,
        "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
        "url": head.get("warc-target-uri"),
        "record_type": head["warc-type"],
        "refers_to": int(head["x-refers-to-page"]) if head.get("x-refers-to-page") else None,
        "payload_bytes": int(head["x-payload-length"]) if revisit else len(payload),
        "payload_digest": head["warc-payload-digest"].removeprefix("sha1:") if revisit else digest_of(payload),
        "payload": payload if with_payload and not revisit else None,
    }


_RECORD_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(rows[0], _RECORD_TYPES)], names=list(rows[0]))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back: :data:`RECORDS` without payloads, one row per page."""
    spark = pages.sparkSession
    written = stored(write_archives(pages, new_folder(spark, "warc-monolithic")), "warc-written")
    files = written.select("file").distinct()
    index = stored(normalise_archives(files, revisits(written, min_bytes), new_folder(spark, "warc")), "warc-index")
    return read_archives(index, with_payload=False)
