"""WARC archives, written and read as a table of chunks.

A payload is cut into rows of record identifier and chunk number by built-in functions; a task takes them one by one
into a gzip member, so that no Python process ever holds a whole payload. Digest and length, which a record's header
needs before its payload, come from an aggregate over the pages that also finds equal payloads. Reading gives chunk rows
again, each with the digest of all that was read up to its end.

Archives are written under another name for each task attempt; only those in the manifest that Spark commits are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, partitions_for, scratch

CHUNK = 1 << 16
_CHUNKS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
CHUNK_ROWS = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, chunk binary, digest_so_far string, last boolean"


def _base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def planned(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows to write, a record's one after the other: page_id, url, payload_bytes, payload_sha1, refers_to, chunk_no,
    chunks, chunk.

    Of records with equal payloads of at least least_bytes bytes, those with the smallest page_id are responses and the
    others refer to it. Equal payloads are found by length and digest, on rows without payloads: an aggregate gives the
    smallest page_id of each, and a row of page_id, digest and what it refers to for each page that has a twin. Payloads
    are cut where they are read, and chunks meet those rows by page_id and digest, which spreads the copies of one payload
    over all tasks. Equal rows are told apart by a number.
    """
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.select("page_id", "url", "body", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("payload_sha1"))
    of = ["payload_sha1", "payload_bytes"]
    narrow = (rows.filter(f"payload_bytes >= {least_bytes}") if least_bytes else rows).groupBy("page_id", *of).agg(F.count(F.lit(1)).alias("n"))
    first = narrow.groupBy(*of).agg(F.min("page_id").alias("first_id"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    # A payload's chunks are made as one list, so that no row beside a chunk holds the payload.
    part = lambda k: F.substring("body", k * chunk + 1, F.lit(chunk))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk)).cast("int") - 1), part)
    # One exchange of chunks, by record; all that follows keeps to it, the join too, whichever way it runs.
    n = partitions_for(pages, 32 << 20)
    named = [F.coalesce("page_id", F.lit(0)).alias("__id"), F.col("page_id").isNull().alias("__none"), "payload_sha1"]
    cut = rows.select("page_id", "url", *of[1:], *named, F.posexplode(parts).alias("chunk_no", "chunk")).repartition(n, "__id", "__none", "payload_sha1")
    refers = narrow.drop("n").join(first, of).filter("not page_id <=> first_id").select(*named, F.col("first_id").alias("refers_to")).repartition(n, "__id", "__none", "payload_sha1")
    joined = cut.join(refers, ["__id", "__none", "payload_sha1"], "left").filter("refers_to is null or chunk_no = 0").withColumn("chunk", F.when(F.col("refers_to").isNull(), F.col("chunk")))
    record = ["__id", "__none", "payload_sha1", "url"]
    copy = F.row_number().over(Window.partitionBy(*record, "chunk_no").orderBy(F.lit(0)))
    joined = joined.withColumn("copy", copy).sortWithinPartitions(*record, "copy", "chunk_no")
    chunks = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk))).cast("int")
    return joined.select("page_id", "url", "payload_bytes", "payload_sha1", "refers_to", "chunk_no", chunks.alias("chunks"), "chunk")


def _clean(text: str | None) -> str:
    return "".join(c for c in text or "" if c >= " " and c != "\x7f")


def _header(row: dict, record_id: str, http: bytes) -> bytes:
    ref, digest = row["refers_to"], _base32(row["payload_sha1"])
    lines = ["WARC/1.1", f"WARC-Type: {'response' if ref is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(row['url'])}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}"]
    if ref is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{ref}')}>", f"X-Refers-To-Page-ID: {ref}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (row['payload_bytes'] if ref is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


class _Member:
    """One gzip member of an archive, written piece by piece."""

    def __init__(self, out):
        self.out, self.z = out, zlib.compressobj(4, zlib.DEFLATED, 31)

    def put(self, data: bytes) -> int:
        return self.out.write(self.z.compress(data)) or 0

    def end(self) -> None:
        self.out.write(self.z.flush())


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, file_bytes: int = 64 << 20, chunk: int = CHUNK) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html; others are left out). Returns the manifest: path, records.

    A null html is an empty payload, and a null page_id or url an empty field. Rows of one page_id are separate records;
    with equal payloads none of them refers to another. An empty table makes no archive.
    """
    folder = folder or scratch(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, root = fs.FileSystem.from_uri(f"{folder}/data")
        to.create_dir(root, recursive=True)
        out = member = name = None
        records = payload = 0
        sha = hashlib.sha1()

        def closed() -> pa.RecordBatch:
            out.close()
            to.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/data/{name}"], "records": pa.array([records], pa.int64())})

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                if row["chunk_no"] == 0:
                    if out is None:
                        name, records, payload = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = to.open_output_stream(f"{root}/{name}.part", compression=None)
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
                    named = uuid.uuid5(uuid.NAMESPACE_OID, f"page-{row['page_id']}")
                    member, sha = _Member(out), hashlib.sha1()
                    member.put(_header(row, str(named), http) + http)
                if row["chunk"]:
                    sha.update(row["chunk"])
                    member.put(row["chunk"])
                    payload += len(row["chunk"])
                if row["chunk_no"] == row["chunks"] - 1:
                    if row["refers_to"] is None and sha.hexdigest() != row["payload_sha1"]:
                        raise ValueError(f"the chunks of page {row['page_id']} don't make its payload")
                    member.put(b"\r\n\r\n")
                    member.end()
                    records += 1
                    if payload >= file_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    rows = planned(pages, least_bytes, chunk)
    in_arrow(rows, write, "path string, records long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


class _Stream:
    """An archive's bytes after gzip, read in bounded pieces."""

    def __init__(self, source, piece: int = 1 << 16):
        self.source, self.piece = source, piece
        self.z, self.raw, self.buf = zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.z.unconsumed_tail or self.raw or self.source.read(self.piece)
            self.raw = b""
            if not data:
                return False
            got = self.z.decompress(data, self.piece)
            if got:
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to a mark, which is skipped; None at the end."""
        while mark not in self.buf:
            if not self._more():
                if self.buf.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out, _, self.buf = self.buf.partition(mark)
        return out

    def take(self, most: int) -> bytes:
        if not self.buf and not self._more():
            raise ValueError("the archive ends inside a record")
        out, self.buf = self.buf[:most], self.buf[most:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(source, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive: every record has one at least, the last of which is marked."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        http = stream.until(b"\r\n\r\n")
        left = int(warc["content-length"]) - len(http) - 4
        row = {
            "record_id": warc["warc-record-id"].strip("<>"),
            "page_id": int(warc["x-page-id"]) if warc["x-page-id"] else None,
            "record_type": warc["warc-type"],
            "refers_to": int(warc["x-refers-to-page-id"]) if "x-refers-to-page-id" in warc else None,
            "payload_bytes": int(_fields(http)["content-length"]),
            "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:"),
        }
        sha, no = hashlib.sha1(), 0
        if row["record_type"] == "response" and left != row["payload_bytes"]:
            raise ValueError(f"{row['record_id']}: lengths differ")
        while True:
            part = b""
            while left and len(part) < chunk:
                got = stream.take(min(left, chunk - len(part)))
                part += got
                left -= len(got)
            sha.update(part)
            so_far = base64.b32encode(sha.digest()).decode()
            if not left and row["record_type"] == "response" and so_far != row["payload_digest"]:
                raise ValueError(f"{row['record_id']}: the payload isn't what its digest says")
            yield row | {"chunk_no": no, "chunk": part, "digest_so_far": so_far, "last": not left}
            no += 1
            if not left:
                break
        if stream.until(b"\r\n\r\n") is None:
            raise ValueError("the archive ends inside a record")


def read_archives(manifest: DataFrame, payloads: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of written archives. Without payloads, chunks are read and checked but not handed on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                to, path = fs.FileSystem.from_uri(uri)
                with to.open_input_stream(path, compression=None) as f:
                    held, size = [], 0
                    for row in records(f, chunk):
                        if not payloads:
                            row["chunk"] = None
                        held.append(row)
                        size += len(row["chunk"] or b"") + 256
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, _CHUNKS)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, _CHUNKS)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(manifest.select("path").repartition(n), read, CHUNK_ROWS)


def page_records(chunk_rows: DataFrame) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return chunk_rows.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
