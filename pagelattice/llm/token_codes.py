"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one; a bitmap beside
each level says which ids go on to the next, and a directory of ranks, one for each 512 bits, turns a place in a level
into the place in the next one. Any token, and any document, is read without decoding what lies before it.

File: magic, counts, the documents' ids and starts, then for each level its chunks, bitmap and ranks. All numbers are
little-endian. Files are written under another name for each task attempt, and only those in the manifest, which Spark
commits, are ever read: a lost executor's files are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, partitions_for, scratch

MAGIC = b"DACTOK01"
#: Bits that one entry of the rank directory covers.
RANK_BITS = 512
_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of a file that holds these documents' ids."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    rest = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    levels = []
    while True:
        chunk = (rest & 0xFF).astype(np.uint8)
        rest = rest >> 8
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        ranks = np.concatenate([[0], np.cumsum(_POP[bits].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64))]).astype("<u4")
        levels.append((chunk, bits, ranks))
        if not goes_on.any():
            break
        rest = rest[goes_on]
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    head = MAGIC + struct.pack("<QQI", len(doc_ids), int(starts[-1]), len(levels))
    body = [head, known.tobytes(), names.tobytes(), starts.tobytes()]
    for chunk, bits, ranks in levels:
        body += [struct.pack("<QQQ", len(chunk), len(bits), len(ranks)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(body)


class Shard:
    """A file's documents and tokens, read in place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQI", data, 8)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, names = take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(names, known, strict=True)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n, b, r = struct.unpack_from("<QQQ", data, at)
            at += 24
            self.levels.append((take("u1", n), take("u1", b), take("<u4", r)))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level's bitmap."""
        _, bits, ranks = self.levels[level]
        block, byte = i // RANK_BITS, i // 8
        n = int(ranks[block]) + int(_POP[bits[block * (RANK_BITS // 8) : byte]].sum())
        return n + bin(int(bits[byte]) & ((1 << i % 8) - 1)).count("1") if i % 8 else n

    def token(self, i: int) -> int:
        """The id at place i of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b, b left out."""
        out = np.zeros(b - a, np.uint32)
        where = slice(None)
        for level, (chunk, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= chunk[a:b].astype(np.uint32) << (8 * level)
            on = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if not on.any():
                break
            where = np.flatnonzero(on) if isinstance(where, slice) else where[on]
            a = self._rank(level, a)
            b = a + int(on.sum())
        return out

    def doc(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def _put(folder: str, name: str, data: bytes) -> str:
    from pyarrow import fs

    to, path = fs.FileSystem.from_uri(folder)
    to.create_dir(path, recursive=True)
    with to.open_output_stream(f"{path}/{name}.part") as f:
        f.write(data)
    to.move(f"{path}/{name}.part", f"{path}/{name}")
    return f"{folder}/{name}"


def _get(uri: str) -> bytes:
    from pyarrow import fs

    to, path = fs.FileSystem.from_uri(uri)
    with to.open_input_file(path) as f:
        return f.read()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, shard_tokens: int = 2_000_000) -> DataFrame:
    """Encode docs (doc_id, text; other columns are left out) and write token files in ascending doc_id order.

    Returns the manifest, one row a file: part, seq, path, n_docs, n_tokens, base (ids in all files before it).
    Null doc_ids come first; rows of one doc_id follow each other in an order fixed by their text; a null or empty text
    has the end id alone; an empty table makes no file. A file ends at the first document that reaches shard_tokens.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    data = f"{folder}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .pretoken import Encoder

        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            path = _put(data, f"tokens-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac", pack(names, ids))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": len(names), "n_tokens": held}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                texts = [x or "" for x in some.column(1).to_pylist()]
                for name, got in zip(some.column(0).to_pylist(), encoder.encode_all(texts, end_id), strict=True):
                    names.append(name)
                    ids.append(got)
                    held += len(got)
                    if held >= shard_tokens:
                        yield flush()
                        names, ids, held, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(partitions_for(docs.select("doc_id", "text"), 8 << 20), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    in_arrow(ordered, write, "part int, seq int, path string, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    files = spark.read.parquet(f"{folder}/manifest")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return files.withColumn("inside", inside).join(parts, "part").select("part", "seq", "path", "n_docs", "n_tokens", (F.col("before") + F.col("inside")).alias("base"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """The documents of written files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(_get(path))
                sizes = np.diff(shard.starts)
                crcs = [zlib.crc32(shard.doc(k).astype("<u4").tobytes()) for k in range(len(sizes))]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + base, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(manifest.select("path", "base").repartition(n), read, "doc_id long, start long, n_tokens long, ids_crc32 long")
