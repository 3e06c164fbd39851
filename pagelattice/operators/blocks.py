"""Pages of like size as padded matrices, so that a step runs over thousands of pages at once.

A page's words stay in list order along the second axis; what a mask leaves out takes no part. Sums run from left to right
and equals keep their order, as in the folds over one page. A word whose place is null is near nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vocabulary import TYPES

PLACES = ("x", "y", "x0", "y0", "x1", "y1", "size")
PS = "array<struct<ord:int,text:string,x:double,y:double,x0:double,y0:double,x1:double,y1:double,size:double,type:string>>"
#: Words of a block at most, a single page apart; bytes of an Arrow batch.
WORDS, BATCH = 200_000, 16 << 20
KIND = {name: k for k, name in enumerate((*TYPES, "MODEL_CODE"))}
_LAST = np.iinfo(np.int64).max


class Words:
    """The words of a batch's pages, one after the other."""

    def __init__(self, ps: pa.ListArray):
        flat = ps.flatten()
        fields = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
        self.n = pc.fill_null(pc.list_value_length(ps), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.n) - self.n
        self.fields, self.text = fields, fields["text"]
        self.length = pc.fill_null(pc.utf8_length(fields["text"]), 0).to_numpy(zero_copy_only=False)
        self.ord = pc.fill_null(fields["ord"], 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.place = {c: fields[c].to_numpy(zero_copy_only=False) for c in PLACES}
        coded = pc.dictionary_encode(pc.fill_null(fields["type"], "TEXT"))
        names = list(KIND) + [t for t in coded.dictionary.to_pylist() if t not in KIND]
        known = {t: k for k, t in enumerate(names)}
        self.names = pa.array(names, pa.string())
        lookup = np.array([known[t] for t in coded.dictionary.to_pylist()], np.int64)
        self.kind = lookup[coded.indices.to_numpy(zero_copy_only=False)] if len(lookup) else np.zeros(0, np.int64)

    def blocks(self) -> Iterator[Block]:
        """Pages by size, so that little of a matrix is padding."""
        order = np.argsort(self.n, kind="stable")
        sizes = self.n[order]
        k = 0
        while k < len(order):
            end = np.searchsorted(sizes, max(8, int(sizes[k] * 1.4)), "right")
            while end > k + 1 and (end - k) * sizes[end - 1] > WORDS:
                end = k + max(1, min(end - k - 1, int(WORDS // sizes[end - 1])))
            yield Block(self, order[k:end])
            k = end


class Block:
    """Some pages of a batch: matrices of a row a page."""

    def __init__(self, words: Words, rows: np.ndarray):
        self.words, self.rows, self.n = words, rows, words.n[rows]
        wide = np.arange(self.n.max(initial=0))
        self.on = wide < self.n[:, None]
        self.at = np.where(self.on, words.starts[rows][:, None] + wide, 0)
        self.kind = np.where(self.on, self.of(words.kind), -1)
        self.ord = self.of(words.ord)

    def of(self, flat: np.ndarray) -> np.ndarray:
        return flat[self.at] if len(flat) else np.zeros(self.at.shape, flat.dtype)

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in PLACES:
            raise AttributeError(name)
        value = self.of(self.words.place[name])
        setattr(self, name, value)
        return value

    def has(self, *kinds: str) -> np.ndarray:
        return np.isin(self.kind, [KIND[k] for k in kinds])

    def ps(self) -> pa.ListArray:
        """The pages' words with the types that they have now."""
        at = pa.array(self.at[self.on])
        fields = {c: v.take(at) for c, v in self.words.fields.items()}
        fields["type"] = self.words.names.take(pa.array(self.kind[self.on]))
        return lists(self.n, pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def lists(n: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values)


def picked(values: np.ndarray, on: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list for each row: the values that a mask leaves."""
    return lists(on.sum(1), pa.array(values[on], kind))


def take(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(values, order, axis=1)


def at(sorted_values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The value at one place of each row; NaN outside."""
    if not sorted_values.shape[1]:
        return np.full(len(place), np.nan)
    inside = (place >= 0) & (place < sorted_values.shape[1])
    return np.where(inside, sorted_values[np.arange(len(place)), np.where(inside, place, 0)], np.nan)


def order_of(on: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what a mask leaves in order of the keys, the first one leading, then of the list; and how many."""
    if len(keys) == 1:
        key = keys[0]
        order = np.argsort(np.where(on, np.where(np.isnan(key), np.finfo(float).max, key), np.inf), axis=1, kind="stable")
    elif keys:
        order = np.lexsort((*reversed(keys), ~on), axis=1)
    else:
        order = np.argsort(~on, axis=1, kind="stable")
    n = on.sum(1)
    return order[:, : n.max(initial=0)], n


def compact(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of what a mask leaves, in order of the list; their mask; how many."""
    order, n = order_of(on)
    return order, np.arange(order.shape[1]) < n[:, None], n


def upper_median(values: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The upper one of the middle two; NaN for none."""
    n = on.sum(1)
    return np.where(n > 0, at(np.sort(np.where(on, values, np.inf), axis=1), n // 2), np.nan)


def median(values: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Mean of the middle one or two; NaN for none."""
    n, s = on.sum(1), np.sort(np.where(on, values, np.inf), axis=1)
    return np.where(n > 0, (at(s, (n - 1) // 2) + at(s, n // 2)) / 2, np.nan)


def steps(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of values that follow each other, and which of them there are."""
    return values[:, 1:] - values[:, :-1], np.arange(max(values.shape[1] - 1, 0)) < n[:, None] - 1


def spacing(values: np.ndarray, on: np.ndarray, default: float) -> np.ndarray:
    """Usual distance of distinct rounded places: the median of the gaps below 2.5 times their upper median."""
    places = np.rint(values)
    order, n = order_of(on, places)
    gaps, there = steps(take(places, order), n)
    there &= gaps > 0
    usual = upper_median(gaps, there)
    found = median(gaps, there & (gaps < usual[:, None] * 2.5))
    return np.where((there.sum(1) < 2) | np.isnan(found), default, found)


def clusters(values: np.ndarray, on: np.ndarray, tolerance) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy grouping of values in their order: each joins the first group whose mean is nearer than the tolerance, else
    it begins one. Returns the order, the group of each in that order (-1 for none), and the groups' sums and counts."""
    order, n = order_of(on, values)
    placed = take(values, order)
    tolerance = np.broadcast_to(tolerance, n.shape)[:, None]
    sums, counts, group = np.zeros(placed.shape), np.zeros(placed.shape, np.int64), np.full(placed.shape, -1)
    used = np.zeros(len(n), np.int64)
    for k in range(placed.shape[1]):
        r = np.flatnonzero(k < n)
        v, top = placed[r, k], used.max()
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.abs(sums[r, :top] / counts[r, :top] - v[:, None]) < tolerance[r]
        hit = near.any(1)
        g = np.where(hit, near.argmax(1) if top else 0, used[r])
        sums[r, g] += v
        counts[r, g] += 1
        used[r] += ~hit
        group[r, k] = g
    top = used.max(initial=0)
    return order, group, sums[:, :top], counts[:, :top]


def first_of(on: np.ndarray, key: np.ndarray, ords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ord of the greatest key, the smallest ord of equals; and whether there is any."""
    if not on.shape[1]:
        return np.zeros(len(on), np.int64), np.zeros(len(on), bool)
    most = np.where(on, key, -np.inf).max(1)
    tied = on & (key == most[:, None])
    return np.where(tied, ords, _LAST).min(1), tied.any(1)


def batches(rows: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """fn over batches of page_key, ps and further columns of pages."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                yield from fn(batch)

    return rows.select("page_key", F.col("ps").cast(PS).alias("ps"), *extra).mapInArrow(run, schema)
