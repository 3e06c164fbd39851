"""Quality classifier: a convolutional network over bytes, in numpy.

A byte becomes a small vector; learned filters look at chunks of 16 bytes, one every 8, from a document's first byte to
its last; each filter's greatest response over the document goes into one logistic unit. A document is read in pieces
that share a block, so that no chunk is missed and memory stays bounded. Training runs on the driver over a bounded
sample of labelled documents; a filter's gradient flows to the chunk that gave its greatest response.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

STRIDE, WIDTH, FILTERS = 8, 8, 32
#: Labelled documents that the network is fitted to at most, and the longest of them in bytes.
SAMPLE_ROWS, SAMPLE_TEXT = 3000, 200_000
#: Bytes of a document that are in work at once.
PIECE = 1 << 18


@dataclass
class Net:
    """embed: a vector for each byte and one for padding; first, second: the filters' halves; weights, bias: the unit."""

    embed: np.ndarray
    first: np.ndarray
    second: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def _blocks(self, data: bytes) -> np.ndarray:
        codes = np.frombuffer(data, np.uint8).astype(np.int16)
        return np.pad(codes, (0, -len(codes) % STRIDE), constant_values=256).reshape(-1, STRIDE)

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Blocks of 8 codes -> responses of the chunks of two blocks that lie side by side."""
        x = self.embed[codes].reshape(len(codes), -1)
        return x[:-1] @ self.first + x[1:] @ self.second

    def pooled(self, data: bytes) -> np.ndarray:
        """Each filter's greatest response over the whole document, at least 0."""
        best = np.zeros(len(self.shift), np.float32)
        for at in range(0, max(len(data), 1), PIECE):
            codes = self._blocks(data[at : at + PIECE + STRIDE])
            codes = np.concatenate([codes, np.full((max(1, 2 - len(codes)), STRIDE), 256, np.int16)])
            best = np.maximum(best, self.responses(codes).max(0) + self.shift)
        return best

    def scores(self, texts: list[bytes]) -> np.ndarray:
        pooled = np.stack([self.pooled(t) for t in texts]) if texts else np.zeros((0, len(self.shift)), np.float32)
        return 1 / (1 + np.exp(-(pooled @ self.weights + self.bias).astype(np.float64)))


def _cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The raw score that parts the labels best, both counting the same; the middle of the widest place that does."""
    order = np.sort(np.unique(raw))
    places = np.concatenate([[order[0] - 1], (order[:-1] + order[1:]) / 2, [order[-1] + 1]])
    width = np.concatenate([[0], np.diff(order), [0]])
    good, bad = np.sort(raw[y > 0]), np.sort(raw[y == 0])
    right = (len(good) - np.searchsorted(good, places)) / len(good) + np.searchsorted(bad, places) / len(bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(places[best[np.argmax(width[best])]])


def fit(texts: list[bytes], labels: list[int], cut: float = 0.3, **how) -> Net:
    """A net whose score is at the cut where a fifth of the examples, kept out of training, is parted best. With fewer
    than five of either label among those, all examples find that place."""
    held = np.arange(len(texts)) % 5 == 4
    y = np.array(labels, np.int64)
    net = _trained([t for t, h in zip(texts, held, strict=True) if not h], y[~held].tolist(), **how)
    if not net.weights.any():
        return net
    pick = held if min((y[held] > 0).sum(), (y[held] == 0).sum()) >= 5 else np.ones(len(texts), bool)
    p = np.clip(net.scores([t for t, h in zip(texts, pick, strict=True) if h]), 1e-9, 1 - 1e-9)
    if 0 < y[pick].sum() < pick.sum():
        net.bias += float(np.log(cut / (1 - cut))) - _cut(np.log(p / (1 - p)), y[pick])
    return net


def _trained(texts: list[bytes], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Net:
    """Adam on the log loss. Without both labels, the net scores their share, 0.5 without any."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net(
        rng.normal(0, 0.5, (257, WIDTH)).astype(f32), rng.normal(0, 0.15, (STRIDE * WIDTH, FILTERS)).astype(f32), rng.normal(0, 0.15, (STRIDE * WIDTH, FILTERS)).astype(f32),
        np.zeros(FILTERS, f32), rng.normal(0, 0.1, FILTERS).astype(f32), 0.0,
    )
    y = np.array(labels, f32)
    share = float((y.sum() + 0.5) / (len(y) + 1))
    net.bias = float(np.log(share / (1 - share)))
    if not (0 < y.sum() < len(y)):
        net.weights[:] = 0
        return net
    blocks = [np.concatenate([net._blocks(t), np.full((1 if len(t) > STRIDE else 2, STRIDE), 256, np.int16)]) for t in texts]
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("embed", "first", "second", "shift", "weights")}
    state["bias"] = [np.zeros(()), np.zeros(())]
    t = 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(texts)), -(-len(texts) // batch)):
            codes = np.concatenate([blocks[k] for k in some])
            ends = np.cumsum([len(blocks[k]) for k in some])
            x = net.embed[codes].reshape(len(codes), -1)
            out = x[:-1] @ net.first + x[1:] @ net.second
            at = np.stack([a + out[a : b - 1].argmax(0) for a, b in zip([0, *ends[:-1]], ends, strict=True)])
            best = out[at, np.arange(FILTERS)]
            h = np.maximum(best + net.shift, 0)
            p = 1 / (1 + np.exp(-(h @ net.weights + net.bias)))
            d = (p - y[some]) / len(some)
            g = {"weights": h.T @ d + 1e-4 * net.weights, "bias": d.sum()}
            dh = np.outer(d, net.weights) * (h > 0)
            g["shift"] = dh.sum(0)
            g["first"], g["second"] = np.zeros_like(net.first), np.zeros_like(net.second)
            dx = np.zeros_like(x)
            for k in range(FILTERS):
                rows, w = at[:, k], dh[:, k : k + 1]
                g["first"][:, k] = (x[rows] * w).sum(0)
                g["second"][:, k] = (x[rows + 1] * w).sum(0)
                np.add.at(dx, rows, w * net.first[:, k])
                np.add.at(dx, rows + 1, w * net.second[:, k])
            hit = np.flatnonzero(np.abs(dx).sum(1))
            g["embed"] = np.zeros_like(net.embed)
            np.add.at(g["embed"], codes[hit].ravel(), dx[hit].reshape(-1, WIDTH))
            t += 1
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for name, grad in g.items():
                m, v = state[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                change = step * m / (np.sqrt(v) + 1e-7)
                if name == "bias":
                    net.bias -= float(change)
                else:
                    getattr(net, name)[...] -= change
    return net


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """The training part's labelled documents, SAMPLE_ROWS at most, by hash; those whose crc32(doc_id) mod 5 is 0 are
    never among them, and labels that contradict each other are left out."""
    known = labels.filter("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).filter("low = quality")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).select("doc_id", "quality")
    texts = docs.filter(F.octet_length("text") <= SAMPLE_TEXT).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    return [t.encode() for t in rows.column("text").to_pylist()], [int(q > 0) for q in rows.column("quality").to_pylist()]


def scored(docs: DataFrame, net: Net, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text; others play no part). A null text scores as
    an empty one; equal texts score alike; an empty table gives an empty result."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                got = net.scores([x.as_py() or b"" for x in some.column(2)])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(got), pa.array((got >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return in_arrow(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("data")), score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit to the training part's labels and score every row of docs."""
    return scored(docs, fit(*training_rows(docs, labels)))
