"""Token counts without token ids.

Documents are taken in blocks. A block's distinct pre-tokens become rows, each with the places in the block where the
pre-token stands, so that a pre-token travels once for each block and not for each document. Rows meet by pre-token,
in order: each distinct one is counted once, however many blocks have it, and its count goes back to its blocks, where
it is added to the documents that have it, as often as they do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, partitions_for

BLOCK_DOCS, BLOCK_CHARS = 8192, 24 << 20


def _pack(names: list[int | None], sizes: list[int]) -> bytes:
    """A block's documents: whether they have a doc_id, doc_ids, bytes. In one binary value: a column of lists would cost
    every row that goes to Python more than all the rest."""
    return np.array([[x is not None for x in names], [x or 0 for x in names], sizes], "<i8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(3, -1)


def _index(tokenizer: str):
    """docs (doc_id, text) -> pre-token rows: piece, block, places; one more row a block, without piece, holds its documents."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .pretoken import PreTokens

        pre, part, seq = PreTokens(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        sizes: list[int] = []
        at: dict[str, int] = {}
        places: list[np.ndarray] = []
        chars = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            key = (part << 24) | seq
            seq += 1
            pieces = list(at)
            lens = np.fromiter(map(len, places), np.int64, len(places))
            keys = np.concatenate(places).astype(np.int64) << 16 | np.repeat(np.arange(len(places)), lens) if places else np.zeros(0, np.int64)
            keys.sort()
            cuts = np.searchsorted(keys >> 16, np.arange(len(pieces) + 1))
            data = (keys & 0xFFFF).astype("<u2")
            body = pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer((cuts * 2).astype(np.int32)), pa.py_buffer(data)])
            n = len(pieces)
            for a in range(0, n, 20_000):
                b = min(n, a + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(pieces[a:b], pa.string()), pa.array(np.full(b - a, key)), body.slice(a, b - a)], ["piece", "block", "places"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([key]), pa.array([_pack(names, sizes)], pa.binary())], ["piece", "block", "places"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                pieces = pre.of(text)
                names.append(name)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                places.append(np.fromiter((at.setdefault(x, len(at)) for x in pieces), np.int32, len(pieces)))
                chars += len(text)
                if len(names) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    yield from block()
                    names, sizes, at, places, chars = [], [], {}, [], 0
        if names:
            yield from block()

    return index


def _count(tokenizer: str):
    """Rows in order of their piece -> block, n (tokens of a pre-token), places. Of a block, the places of pre-tokens with
    equally many tokens go on together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pretoken import PreTokens

        pre = PreTokens(tokenizer)
        last, last_n = None, 0
        held: dict[tuple[int, int | None], list[bytes]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in keys], pa.int64()), pa.array([n for _, n in keys], pa.int32()), pa.array([b"".join(held[k]) for k in keys], pa.binary())], ["block", "n", "places"])

        for batch in batches:
            pieces = batch.column(0).to_pylist()
            new = [x for x in dict.fromkeys(pieces) if x is not None and x != last]
            known: dict[str | None, int | None] = dict(zip(new, pre.counts(new), strict=True))
            if last is not None:
                known[last] = last_n
            if pieces and pieces[-1] is not None:
                last, last_n = pieces[-1], known[pieces[-1]]
            known[None] = None
            for piece, block, places in zip(pieces, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault((block, known[piece]), []).append(places)
                size += len(places)
            if size >= 4 << 20:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return count


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their block -> doc_id, n_bytes, n_tokens."""
    now, sums, docs = None, np.zeros(0, np.int64), None

    def done() -> Iterator[pa.RecordBatch]:
        if docs is not None:
            known, names, sizes = docs
            ids = pa.array(names, pa.int64(), mask=known == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sums[: len(names)])], ["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
            if a == b:
                continue
            if now != blocks[a]:
                yield from done()
                now, sums, docs = blocks[a], np.zeros(BLOCK_DOCS, np.int64), None
            part = batch.slice(a, b - a)
            raw = part.column(2).to_pylist()
            pieces = part.column(1)
            if pieces.null_count:
                k = pieces.is_null().index(True).as_py()
                docs, raw[k] = _unpack(raw[k]), b""
            times = np.repeat(pieces.fill_null(0).to_numpy(), np.fromiter((len(x) // 2 for x in raw), np.int64, len(raw)))
            sums += np.bincount(np.frombuffer(b"".join(raw), "<u2"), times, BLOCK_DOCS).astype(np.int64)
    yield from done()


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) for every row of docs (doc_id, text; others play no
    part). A null text is an empty one, with 0 tokens; repeated rows are separate; an empty table gives none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions_for(rows, 8 << 20)
    index = in_arrow(rows, _index(tokenizer), "piece string, block long, places binary")
    # Rows of a block's documents have no piece; they are dealt out by their block.
    dealt = index.repartition(n, F.when(F.col("piece").isNull(), F.col("block")).otherwise(F.xxhash64("piece"))).sortWithinPartitions("piece")
    counted = in_arrow(dealt, _count(tokenizer), "block long, n int, places binary")
    summed = in_arrow(counted.repartition(n, "block").sortWithinPartitions("block"), _total, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
