"""Grids of thousands of pages at once: columns by gaps over widths, rows from the gaps in columns, cells and their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import blocks
from .blocks import Block, clusters, picked


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 of runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _first(group: np.ndarray, n: int, *keys: np.ndarray) -> np.ndarray:
    """For each group the place of its first item by the keys, the first one leading; -1 for none."""
    order = np.lexsort((*reversed(keys), group))
    out = np.full(n, -1)
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    out[group[order][first]] = order[first]
    return out


def _summary(group: np.ndarray, v: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """Of sorted values by group: how many, least, greatest, median; NaN for none."""
    n = np.bincount(group, minlength=groups)
    start = np.cumsum(n) - n
    some = n > 0
    at = lambda k: np.where(some, v[np.where(some, start + k, 0)], np.nan) if len(v) else np.full(groups, np.nan)
    return n, at(np.zeros(groups, np.int64)), at(n - 1), (at((n - 1) // 2) + at(n // 2)) / 2


class Steps:
    """Lines of words, one behind the other: the page and size of each line, and its steps with gap, middle and line."""

    def __init__(self, b: Block, r: np.ndarray, line: np.ndarray, word: np.ndarray, nth: np.ndarray, low: np.ndarray, high: np.ndarray):
        by = np.lexsort((nth, low[r, word], line, r))
        r, line, word = r[by], line[by], word[by]
        run = _runs(r, line)
        size = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        keep = (size >= 2)[run] if len(run) else np.zeros(0, bool)
        r, word, run = r[keep], word[keep], _runs(run[keep])
        self.n_pages, self.size = len(b.n), np.bincount(run) if len(run) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(run, prepend=-1))
        self.page, self.run = r[first], run
        a, z = low[r, word], high[r, word]
        self.extent, self.words = z - a, (r, word)
        inside = run[1:] == run[:-1]
        self.line, self.pair = run[1:][inside], (r[1:][inside], word[:-1][inside], word[1:][inside])
        self.gap, self.at = (a[1:] - z[:-1])[inside], ((z[:-1] + a[1:]) / 2)[inside]

    def mean_extent(self, positive: bool) -> np.ndarray:
        """Mean extent of the words of each line, from left to right; NaN without one."""
        on = self.extent > 0 if positive else np.ones(len(self.extent), bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.bincount(self.run[on], self.extent[on], len(self.size)) / np.bincount(self.run[on], minlength=len(self.size))

    def natural(self, above: float, group: np.ndarray | None = None, groups: int = 0) -> np.ndarray:
        """expr.natural_threshold of each line's (or other group's) gaps above a bound; NaN where there are fewer than two."""
        group, groups = (self.line, len(self.size)) if group is None else (group, groups)
        on = np.flatnonzero(self.gap > above)
        on = on[np.lexsort((self.gap[on], group[on]))]
        v, line = self.gap[on], group[on]
        n = np.bincount(line, minlength=groups)
        end = np.cumsum(n)
        out = np.full(groups, np.nan)
        two, more = n == 2, n >= 3
        out[two] = (v[end[two] - 2] + v[end[two] - 1]) / 2
        out[more] = v[end[more] - 1] + 1
        inside = np.flatnonzero((line[1:] == line[:-1]) & (v[:-1] > 0))
        ratio = v[inside + 1] / v[inside]
        best = _first(line[inside], groups, -ratio, inside)
        jump = (best >= 0) & more
        jump[jump] = ratio[best[jump]] >= 1.5
        k = inside[best[jump]]
        out[jump] = (v[k] + v[k + 1]) / 2
        return out

    def positive(self) -> tuple[np.ndarray, ...]:
        """Of each line's positive gaps: how many, least, greatest, median."""
        on = np.flatnonzero(self.gap > 0)
        on = on[np.lexsort((self.gap[on], self.line[on]))]
        return _summary(self.line[on], self.gap[on], len(self.size))

    def cuts(self, threshold: np.ndarray) -> np.ndarray:
        return self.gap > threshold[self.line] if len(self.gap) else np.zeros(0, bool)

    def voted(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of parts that most of a page's lines have, the first of several (1 without a line), and which steps are
        the boundaries: those of the line with the most words, the first of several, among the lines that voted for it."""
        parts = np.bincount(self.line[cut], minlength=len(self.size)) + 1
        by = np.lexsort((parts, self.page))
        same = _runs(self.page[by], parts[by])
        first = np.flatnonzero(np.diff(same, prepend=-1))
        count = np.bincount(same) if len(same) else np.zeros(0, np.int64)
        # Lines of equal parts stay in order, so that the first of them leads.
        chosen = _first(self.page[by][first], self.n_pages, -count, by[first])
        target = np.ones(self.n_pages, np.int64)
        target[chosen >= 0] = parts[by[first]][chosen[chosen >= 0]]
        agree = np.flatnonzero(parts == target[self.page])
        best = _first(self.page[agree], self.n_pages, -self.size[agree], agree)
        lines = np.zeros(len(self.size), bool)
        lines[agree[best[best >= 0]]] = True
        lines &= (target > 1)[self.page]
        return target, cut & lines[self.line] if len(cut) else cut

    def listed(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some steps' middles as a matrix of a row a page, and which there are."""
        page = self.page[self.line[steps]] if len(steps) else np.zeros(0, np.int64)
        return matrix(page, self.at[steps], self.n_pages)


def matrix(page: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(page, minlength=n)
    on = np.arange(count.max(initial=0)) < count[:, None]
    out = np.full(on.shape, np.inf)
    out[on] = values
    return out, on


def lines(b: Block, axis: str = "x") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sense.rows_of (on the y axis, columns_of): the words in order of their top (left) edge, the line of each, and which
    there are."""
    edge, least, default = (b.y0, 4.0, 15.0) if axis == "x" else (b.x0, 8.0, 30.0)
    order, group, _, _ = clusters(edge, b.on, np.maximum(least, blocks.spacing(edge, b.on, default) * 0.5))
    return order, group, group >= 0


def row_steps(b: Block, found: tuple[np.ndarray, ...], axis: str = "x", pages: np.ndarray | None = None) -> Steps:
    order, group, on = found
    r, k = np.nonzero(on & ((b.n >= 2) if pages is None else pages)[:, None])
    return Steps(b, r, group[r, k], order[r, k], k, *((b.x0, b.x1) if axis == "x" else (b.y0, b.y1)))


def _nearest(r: np.ndarray, v: np.ndarray, middles: np.ndarray) -> np.ndarray:
    """The region whose middle is nearest, the first of equals."""
    least, out = np.full(len(v), np.inf), np.full(len(v), -1)
    for k in range(middles.shape[1]):
        d = np.abs(v - middles[r, k])
        out = np.where(d < least, k, out)
        least = np.where(d < least, d, least)
    return out


def _marks(b: Block, axis: str, regions: pa.ListArray, short: bool) -> np.ndarray:
    """Counts of each page's steps by truth and prediction: tp, fp, tn, fn; nothing for pages of a single region."""
    n = pc.fill_null(pc.list_value_length(regions), 0).to_numpy(zero_copy_only=False)
    flat = regions.flatten()
    low, high = (flat.flatten()[flat.type.get_field_index(f"{axis}{end}")].to_numpy(zero_copy_only=False) for end in ("min", "max"))
    middles, _ = matrix(np.repeat(np.arange(len(n)), n), (low + high) / 2, len(n))
    s = row_steps(b, lines(b, axis), axis, n >= 2)
    count, _, most, _ = s.positive()
    t = s.natural(0.0)
    t = np.where((count >= 3) & (t <= most), t, np.nan)
    said = s.cuts(t)
    r, a, z = s.pair
    centre = b.x if axis == "x" else b.y
    truth = _nearest(r, centre[r, a], middles) != _nearest(r, centre[r, z], middles)
    judged = np.ones(len(r), bool) if short else (count >= 3)[s.line]
    return np.stack([np.bincount(r[judged & (truth == x) & (said == y)], minlength=len(n)) for x, y in ((True, True), (False, True), (False, False), (True, False))])


def judged(rows: DataFrame, axes: tuple[str, ...], short: bool = False) -> DataFrame:
    """evaluate.boundary_marks by gaps, counted over thousands of pages at once: page_key, tp, fp, tn, fn, total, words."""
    names = ["tp", "fp", "tn", "fn", "total", "words"]
    schema = StructType([rows.schema["page_key"], *StructType.fromDDL(", ".join(f"{c} long" for c in names)).fields])
    regions = tuple({"x": "columns", "y": "rows"}[a] for a in axes)

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in blocks.Words(batch.column("ps")).blocks():
            at = pa.array(b.rows)
            counts = sum(_marks(b, a, batch.column(c).take(at), short) for a, c in zip(axes, regions, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("page_key").take(at), *(pa.array(v, pa.int64()) for v in (*counts, counts.sum(0), b.n))], ["page_key", *names])

    return blocks.batches(rows, of, schema, regions)


def _page_natural(s: Steps, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """The natural threshold of all positive gaps of each page (the gap itself, if there is one alone), and how many."""
    page = s.page[s.line] if len(s.line) else s.line
    on = np.flatnonzero(s.gap > 0)
    on = on[np.lexsort((s.gap[on], page[on]))]
    n, one, _, _ = _summary(page[on], s.gap[on], pages)
    return np.where(n == 1, one, s.natural(0.0, page, pages)), n


def _count_maxjump(b: Block, axis: str) -> np.ndarray:
    """grid.count_universal by largest jumps: each line votes by its own threshold or that of the page."""
    s = row_steps(b, lines(b, axis), axis)
    count, least, most, middle = s.positive()
    every = _page_natural(s, len(b.n))[0][s.page]
    own = s.natural(0.0)
    wide = np.flatnonzero(s.extent > 0)
    wide = wide[np.lexsort((s.extent[wide], s.run[wide]))]
    usual = _summary(s.run[wide], s.extent[wide], len(s.size))[3]
    plain = np.where(middle > np.where(np.isnan(usual), 10.0, usual) * 0.5, least - 0.1, most + 1)
    t = np.where(count >= 3, np.where(own <= most, own, np.where(every <= most, every, plain)), every)
    return s.voted(s.cuts(np.where(count > 0, t, np.inf)))[0]


def ratio_threshold(s: Steps, k: float) -> np.ndarray:
    mean = s.mean_extent(False)
    return np.where(mean > 0, mean, 10.0) * k


def _apart(page: np.ndarray, place: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Where a new run begins among sorted places: those of a run follow each other nearer than the page's tolerance."""
    apart = np.ones(len(page), bool)
    apart[1:] = (page[1:] != page[:-1]) | ~(place[1:] - place[:-1] < tolerance[page[1:]])
    return apart


def jump_splits(b: Block, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries that several rows agree on, each row with its own threshold or that of the page."""
    s = row_steps(b, found, pages=b.on.any(1))
    n = found[1].max(1, initial=-1) + 1
    count, _, most, _ = s.positive()
    every, _ = _page_natural(s, len(b.n))
    own = s.natural(0.0)
    t = np.where((count >= 3) & (own <= most), own, every[s.page])
    some = np.flatnonzero(count > 0)
    some = some[np.lexsort((t[some], s.page[some]))]
    tolerance = _summary(s.page[some], t[some], len(b.n))[3] * 0.5
    cut = s.cuts(t) & (s.gap > 0)
    page = s.page[s.line[cut]] if len(cut) else np.zeros(0, np.int64)
    by = np.lexsort((s.at[cut], page))
    page, place = page[by], s.at[cut][by]
    apart = _apart(page, place, tolerance)
    run, page = np.cumsum(apart) - 1, page[apart]
    size, _, _, middle = _summary(run, place, len(page))
    kept = size >= np.maximum(2.0, n * 0.2)[page]
    return matrix(page[kept], middle[kept], len(b.n))


def cell_of(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many boundaries lie below a place."""
    out = np.zeros(v.shape, np.int64)
    for k in range(cuts.shape[1]):
        out += v > cuts[:, k, None]
    return out


def row_cuts(b: Block, column: np.ndarray, method: str, k: float, share: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries between rows from the columns that words are in. Methods: fixed, natural, consensus."""
    r, w = np.nonzero(b.on)
    s = Steps(b, r, column[r, w], w, w, b.y0, b.y1)
    cut = s.cuts(s.natural(0.5) if method == "natural" else np.clip(s.mean_extent(True), 3.0, 30.0) * k)
    if method == "natural":
        cut &= s.gap > 0.5
    if method != "consensus":
        return s.listed(s.voted(cut)[1])
    page = s.page[s.line[cut]] if len(cut) else np.zeros(0, np.int64)
    by = np.lexsort((s.at[cut], page))
    page, place = page[by], s.at[cut][by]
    tolerance = np.maximum(3.0, blocks.spacing(b.y0, b.on, 15.0) * 0.4)
    apart = _apart(page, place, tolerance)
    run = np.cumsum(apart) - 1
    size = np.bincount(run) if len(run) else np.zeros(0, np.int64)
    columns = np.bincount(s.page, minlength=len(b.n))
    kept = (size >= np.maximum(2, np.floor(columns * share))[page[apart]]) & (columns >= 2)[page[apart]]
    mean = np.bincount(run, place, len(size)) / size if len(size) else np.zeros(0)
    return matrix(page[apart][kept], mean[kept], len(b.n))


def row_of(b: Block, found: tuple[np.ndarray, ...], cuts: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without gaps, by boundaries where there are any, else by closeness: the words in order, and the row of each (-1
    for none). Closeness keeps them in order of their top edge."""
    order, near, _ = found
    rows = np.where(b.on, cell_of(b.y0, cuts), np.iinfo(np.int64).max)
    s = np.sort(rows, axis=1)
    fresh = np.ones(s.shape, bool)
    fresh[:, 1:] = s[:, 1:] != s[:, :-1]
    dense = np.empty(s.shape, np.int64)
    np.put_along_axis(dense, np.argsort(rows, axis=1, kind="stable"), np.cumsum(fresh, axis=1) - 1, axis=1)
    by_cut = on.any(1)[:, None]
    width = b.on.shape[1]
    near = np.pad(near, ((0, 0), (0, width - near.shape[1])), constant_values=-1)
    order = np.pad(order, ((0, 0), (0, width - order.shape[1])))
    return np.where(by_cut, np.arange(width), order), np.where(by_cut, np.where(b.on, dense, -1), near)


def _cells(b: Block, order: np.ndarray, rows: np.ndarray, column: np.ndarray, n_rows: np.ndarray, n_cols: np.ndarray) -> pa.ListArray:
    """Every cell of the grid, empty ones too: row, col, and the texts in it joined in the order of its row."""
    count = n_rows * n_cols
    start = np.cumsum(count) - count
    page = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(page)) - start[page]
    r, k = np.nonzero(rows >= 0)
    word = order[r, k]
    cell = start[r] + rows[r, k] * n_cols[r] + column[r, word]
    by = np.argsort(cell, kind="stable")
    texts = blocks.lists(np.bincount(cell, minlength=len(page)), b.words.text.take(pa.array(b.at[r, word][by])))
    fields = [pa.array(nth // n_cols[page], pa.int32()), pa.array(nth % n_cols[page], pa.int32()), pc.binary_join(texts, " ")]
    return blocks.lists(count, pa.StructArray.from_arrays(fields, ["row", "col", "text"]))


_OUT = {"splits": "array<double>", "row_splits": "array<double>", "n_cols": "int", "n_rows": "int", "cells": "array<struct<row:int,col:int,text:string>>", "rowed": blocks.PS.replace("type:string", "type:string,g:int"), "k_cols": "array<int>", "n_lines": "int", "jump_cols": "int", "jump_rows": "int"}


def gridded(rows: DataFrame, *made: str, col_method: str = "ratio", row_method: str = "fixed", k_x: float = 0.3, k_y: float = 0.1, ks: tuple[float, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """pages -> page_key, the columns to keep and those to make: splits, row_splits, n_cols, n_rows, cells, rowed (particles
    with their row g); k_cols, the number of columns by each of several constants; n_lines, the rows of two words or more; jump_cols and jump_rows,
    the numbers of columns and rows by largest jumps.

    Columns are parted by ratio or maxjump, or as a column `splits` of the pages says. Rows: fixed, natural or consensus."""
    given = "splits" in rows.columns
    passed = ("page_key", *keep)
    schema = StructType([*(rows.schema[c] for c in passed), *StructType.fromDDL(", ".join(f"{c} {_OUT[c]}" for c in made)).fields])

    def block(b: Block, splits: pa.ListArray | None) -> dict[str, pa.Array]:
        found, out = lines(b), {}
        for c, axis in (("jump_cols", "x"), ("jump_rows", "y")):
            if c in made:
                out[c] = pa.array(_count_maxjump(b, axis), pa.int32())
        if splits is None or ks:
            steps = row_steps(b, found)
        if ks:
            votes = np.stack([steps.voted(steps.cuts(ratio_threshold(steps, k)))[0] for k in ks], axis=1)
            out["k_cols"] = picked(votes, np.ones(votes.shape, bool), pa.int32())
        if col_method == "maxjump":
            cuts, on = jump_splits(b, found)
        elif splits is None:
            cuts, on = steps.listed(steps.voted(steps.cuts(ratio_threshold(steps, k_x)))[1])
            out["n_lines"] = pa.array(np.bincount(steps.page, minlength=len(b.n)), pa.int32())
        else:
            n = pc.list_value_length(splits).to_numpy(zero_copy_only=False)
            cuts, on = matrix(np.repeat(np.arange(len(n)), n), splits.flatten().to_numpy(zero_copy_only=False), len(n))
        n_cols = on.sum(1) + 1
        out |= {"splits": picked(cuts, on, pa.float64()), "n_cols": pa.array(n_cols, pa.int32())}
        if {"row_splits", "n_rows", "cells", "rowed"} & set(made):
            column = cell_of(b.x, cuts)
            bounds, there = row_cuts(b, column, row_method, k_y)
            order, row = row_of(b, found, bounds, there)
            n_rows = row.max(1, initial=-1) + 1
            out |= {"row_splits": picked(bounds, there, pa.float64()), "n_rows": pa.array(n_rows, pa.int32())}
            if "cells" in made:
                out["cells"] = _cells(b, order, row, column, n_rows, n_cols)
            if "rowed" in made:
                at = blocks.take(b.at, order)[row >= 0]
                fields = {c: v.take(pa.array(at)) for c, v in b.words.fields.items()} | {"g": pa.array(row[row >= 0], pa.int32())}
                out["rowed"] = blocks.lists(b.n, pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        return {c: out[c] for c in made}

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in blocks.Words(batch.column("ps")).blocks():
            at = pa.array(b.rows)
            found = {c: batch.column(c).take(at) for c in passed} | block(b, batch.column("splits").take(at) if given else None)
            yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    return blocks.batches(rows, of, schema, (*keep, *(("splits",) if given else ())))
