"""Spatial sensing: what stands around a word refines its type.

Works on pages, a row each with an array of particles `ps` in list order; grouping words into pages is the one exchange,
all steps here are local to a page. Order matters in the greedy steps, and is kept. Typing runs over blocks of pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import expr
from ..functions.expr import let, median, natural_threshold, spacing
from . import blocks
from .blocks import KIND, Block, at, clusters, compact, first_of, order_of, take

STRUCTURED = ("NUMERIC", "SPEC_LABEL", "MODEL", "MODEL_CODE", "UNIT", "SECTION", "SIZE_HEADER", "KW_HEADER")
PARTICLE = ("ord", "text", "x", "y", "x0", "y0", "x1", "y1", "size", "type")


def pages(particles: DataFrame) -> DataFrame:
    """Particles -> page_key, ps. The engine's exchange: everything after it is local to a page."""
    return particles.groupBy("page_key").agg(F.sort_array(F.collect_list(F.struct(*PARTICLE))).alias("ps"))


def unpacked(rows: DataFrame, column: str = "ps") -> DataFrame:
    return rows.select("page_key", F.explode(column).alias("p")).select("page_key", "p.*")


def of_type(ps: Column, *types: str) -> Column:
    return F.filter(ps, lambda p: p["type"].isin(*types))


def row_spacing(ps: Column) -> Column:
    """Usual distance of lines with numbers."""
    return spacing(F.transform(of_type(ps, "NUMERIC"), lambda p: p["y0"]), 15.0)


def row_spacing_all(ps: Column) -> Column:
    return spacing(F.transform(ps, lambda p: p["y0"]), 15.0)


def col_spacing_all(ps: Column) -> Column:
    return spacing(F.transform(ps, lambda p: p["x0"]), 30.0)


def row_spacing_plain(ps: Column) -> Column:
    """The simpler estimate: median step above 1 between lines at tenths of a point, 10 without any."""
    places = F.array_sort(F.array_distinct(F.transform(ps, lambda p: F.round(p["y0"], 1))))
    gaps = let(places, lambda s: F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda v, i: v - F.get(s, i)))
    return F.when(F.size(places) < 2, 10.0).otherwise(F.coalesce(median(F.filter(gaps, lambda g: g > 1.0)), F.lit(10.0)))


def _by(ps: Column, key: str) -> Column:
    """Particles in order of a coordinate, then of the list."""
    return F.transform(F.sort_array(F.transform(ps, lambda p, i: F.struct(p[key].alias("k"), i.alias("i"), p.alias("p")))), lambda s: s["p"])


def grouped(ps: Column, key: str, tolerance: Column) -> Column:
    """Particles in order of a coordinate with `g`, their group by running means."""
    def of(s: Column) -> Column:
        return let(expr.clusters(F.transform(s, lambda p: p[key]), tolerance), lambda g: F.transform(s, lambda p, i: F.struct(*[p[c].alias(c) for c in PARTICLE], F.get(g, i).alias("g"))))

    return let(_by(ps, key), of)


def lists(items: Column, what=lambda p: p) -> Column:
    """Particles with a group -> an array of groups, each an array in the order given."""
    def of(s: Column) -> Column:
        n = F.coalesce(F.array_max(F.transform(s, lambda p: p["g"])) + 1, F.lit(0))
        each = lambda k: F.transform(F.filter(s, lambda p: p["g"] == k), what)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), each)).otherwise(F.transform(F.slice(F.array(F.lit(0)), 1, 0), lambda k: each(k)))

    return let(items, of)


def rows_of(ps: Column) -> Column:
    """Lines: groups by top edge, within half a line's distance."""
    return grouped(ps, "y0", F.greatest(F.lit(4.0), row_spacing_all(ps) * 0.5))


def columns_of(ps: Column) -> Column:
    """Columns: groups by left edge, within half a column's distance."""
    return grouped(ps, "x0", F.greatest(F.lit(8.0), col_spacing_all(ps) * 0.5))


def detected_columns(ps: Column, least: int = 3, threshold: float = 15.0) -> Column:
    """Columns of typed particles: x, y_min, y_max, count, from left to right; at least `least` of them on two lines."""
    def of(group: Column) -> Column:
        ys = F.transform(group, lambda p: p["y0"])
        x = F.aggregate(group, F.lit(0.0), lambda a, p: a + p["x"]) / F.size(group)
        lines = F.size(F.array_distinct(F.transform(ys, lambda y: F.bround(y, 0))))
        return F.struct(x.alias("x"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"), F.size(group).alias("count"), lines.alias("lines"))

    every = let(of_type(ps, *STRUCTURED), lambda s: F.transform(lists(grouped(s, "x", F.lit(threshold))), of))
    kept = F.filter(every, lambda c: (c["count"] >= least) & (c["lines"] >= 2))
    return F.sort_array(F.transform(kept, lambda c: F.struct(c["x"].alias("x"), c["y_min"].alias("y_min"), c["y_max"].alias("y_max"), c["count"].alias("count"))))


def crystal(ps: Column) -> Column:
    """Column boundaries from centres that line up over the whole page: steps above the natural threshold."""
    def of(xs: Column) -> Column:
        gaps = F.filter(F.transform(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda v, i: F.struct((v - F.get(xs, i)).alias("g"), ((F.get(xs, i) + v) / 2).alias("at"))), lambda g: g["g"] > 0.5)

        def cut(gs: Column) -> Column:
            above = lambda t: F.transform(F.filter(gs, lambda g: g["g"] > t), lambda g: g["at"])
            return F.when(F.size(gs) < 3, F.array().cast("array<double>")).otherwise(let(natural_threshold(F.transform(gs, lambda g: g["g"])), above))

        return let(gaps, cut)

    return F.when(F.size(ps) < 4, F.array().cast("array<double>")).otherwise(let(F.array_sort(F.transform(ps, lambda p: p["x"])), of))


def _structured(b: Block, few: int = 5, least: int = 3, threshold: float = 15.0) -> tuple[np.ndarray, ...]:
    """detected_columns of a block's pages: x, y_min, y_max and count as matrices from left to right, and how many."""
    order, group, sums, count = clusters(b.x, b.has(*STRUCTURED) & (b.n >= few)[:, None], threshold)
    r, k = np.nonzero(group >= 0)
    g, y = group[r, k], b.y0[r, order[r, k]]
    low, high, lines = np.full(sums.shape, np.inf), np.full(sums.shape, -np.inf), np.zeros(sums.shape, np.int64)
    np.fmin.at(low, (r, g), y)
    np.fmax.at(high, (r, g), y)
    by = np.lexsort((np.rint(y), g, r))
    line = np.stack([r[by], g[by], np.rint(y)[by]])
    fresh = np.ones(len(by), bool)
    fresh[1:] = (line[:, 1:] != line[:, :-1]).any(0)
    np.add.at(lines, (r[by][fresh], g[by][fresh]), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = sums / count
    kept, n = order_of((count >= least) & (lines >= 2), x, low, high, count)
    return *(take(v, kept) for v in (x, low, high, count)), n


def _headers(b: Block, columns: tuple[np.ndarray, ...], reach: float = 60.0, aside: float = 30.0) -> tuple[np.ndarray, ...]:
    """Plain text above a column, the nearest one, first come first served."""
    x, low, _, _, n = columns

    def near(k: int) -> np.ndarray:
        above = low[:, k, None] - b.y0
        return (above > 0) & (above < reach) & (np.abs(b.x - x[:, k, None]) < aside) & (k < n)[:, None]

    return _greedy(b, b.has("TEXT"), x.shape[1], near, b.y0)


def _greedy(b: Block, free: np.ndarray, seeds: int, near, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each seed in turn the candidate of the greatest key not yet taken, the first of equals: their ords, whether
    there was one, and the words that are taken."""
    ords, found, taken = np.zeros((len(b.n), seeds), np.int64), np.zeros((len(b.n), seeds), bool), np.zeros(b.on.shape, bool)
    for k in range(seeds):
        ords[:, k], found[:, k] = first_of(near(k) & free & ~taken, key, b.ord)
        taken |= (b.ord == ords[:, k, None]) & found[:, k, None] & b.on
    return ords, found, taken


def _row_labels(b: Block, columns: tuple[np.ndarray, ...], gap: float = 50.0) -> tuple[np.ndarray, ...]:
    """The largest left-aligned group of plain text beside the first column, three or more."""
    x, low, high, _, n = columns
    there = np.arange(x.shape[1]) < n[:, None]
    top, bottom = np.where(there, low, np.inf).min(1, initial=np.inf), np.where(there, high, -np.inf).max(1, initial=-np.inf)
    left = b.has("TEXT") & (b.x0 < (at(x, np.zeros(len(n), np.int64)) - gap * 0.3)[:, None]) & (b.y0 >= (top - 20)[:, None]) & (b.y0 <= (bottom + 20)[:, None]) & (n > 0)[:, None]
    order, group, _, count = clusters(b.x0, left, 12.0)
    if not count.shape[1]:
        return np.zeros((len(n), 0), np.int64), np.zeros((len(n), 0), bool), np.zeros(b.on.shape, bool)
    chosen = (group == count.argmax(1)[:, None]) & (count.max(1) >= 3)[:, None]
    marked = np.zeros(b.on.shape, bool)
    r, k = np.nonzero(chosen)
    marked[r, order[r, k]] = True
    return take(b.ord, order), chosen, marked


def _spec_pairs(b: Block, least: int = 2) -> tuple[np.ndarray, ...]:
    """Plain text to the left of a number on its line, the nearest one, first come first served; two pairs at least."""
    tolerance = np.clip(_row_spacing(b) * 0.6, 5.0, 25.0)[:, None]
    where, on, _ = compact(b.has("NUMERIC") & (b.n >= 5)[:, None])
    x0, y0 = take(b.x0, where), take(b.y0, where)

    def near(k: int) -> np.ndarray:
        ahead = x0[:, k, None] - b.x1
        return (np.abs(b.y0 - y0[:, k, None]) < tolerance) & (ahead > 0) & (ahead < 300) & on[:, k, None]

    ords, found, taken = _greedy(b, b.has("TEXT"), where.shape[1], near, b.x1)
    enough = (found.sum(1) >= least)[:, None]
    return ords, found & enough, taken & enough


def _row_spacing(b: Block) -> np.ndarray:
    return blocks.spacing(b.y0, b.has("NUMERIC"), 15.0)


def _sections(b: Block, ratio: float = 1.3, longest: int = 60) -> np.ndarray:
    """Plain text in a font well above the median one."""
    sized = b.on & (b.size > 0)
    length = b.of(b.words.length)
    large = b.has("TEXT") & (b.size > blocks.median(b.size, sized)[:, None] * ratio) & (length > 3) & (length < longest)
    return large & (sized.sum(1) >= 5)[:, None]


def _incoherent(b: Block, columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers outside columns with neither a label nor another number near their line, and units without a number."""
    tolerance = np.maximum(12.0, _row_spacing(b) * 0.7)[:, None]
    numbers, units = b.has("NUMERIC"), b.has("UNIT")

    def beside(kind: str, near) -> np.ndarray:
        where, on, _ = compact(b.has(kind))
        y, n = take(b.y0, where), np.zeros(b.on.shape, np.int64)
        for k in range(where.shape[1]):
            n += near(y[:, k, None]) & on[:, k, None]
        return n

    close = lambda y: np.abs(y - b.y0) < tolerance
    inside = np.zeros(b.on.shape, bool)
    for k in range(columns[0].shape[1]):
        inside |= (np.abs(b.x - columns[0][:, k, None]) < 20) & (k < columns[-1])[:, None]
    any_number = (numbers.any(1) & (b.n >= 5))[:, None]
    around = beside("NUMERIC", lambda y: (y > b.y0 - tolerance) & (y < b.y0 + tolerance))
    lone = numbers & ~inside & (beside("SPEC_LABEL", close) == 0) & (around < 2)
    return lone & any_number, units & (beside("NUMERIC", close) == 0) & any_number


def _listed(columns: tuple[np.ndarray, ...]) -> pa.ListArray:
    there = np.arange(columns[0].shape[1]) < columns[-1][:, None]
    fields = [pa.array(v[there], t) for v, t in zip(columns[:4], (pa.float64(), pa.float64(), pa.float64(), pa.int32()), strict=True)]
    return blocks.lists(columns[-1], pa.StructArray.from_arrays(fields, ["x", "y_min", "y_max", "count"]))


def found_columns(rows: DataFrame) -> DataFrame:
    """pages -> page_key, cols: detected_columns of thousands of pages at once, small ones too."""
    schema = StructType([rows.schema["page_key"], *StructType.fromDDL("cols array<struct<x:double,y_min:double,y_max:double,count:int>>").fields])

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in blocks.Words(batch.column("ps")).blocks():
            yield pa.RecordBatch.from_arrays([batch.column("page_key").take(pa.array(b.rows)), _listed(_structured(b, 0))], ["page_key", "cols"])

    return blocks.batches(rows, of, schema)


def _sense(b: Block) -> dict[str, pa.Array]:
    columns = _structured(b)
    full = (b.n >= 5)[:, None]
    out = {"cols": _listed(columns)}
    ords = {}
    for name, kind, found in (("headers", "MODEL", lambda: _headers(b, columns)), ("row_labels", "SPEC_LABEL", lambda: _row_labels(b, columns)), ("specs", "SPEC_LABEL", lambda: _spec_pairs(b)), ("sections", "SECTION", lambda: (b.ord, large := _sections(b), large))):
        ord_, on, marked = found()
        on = on & full
        out[name] = pa.array(on.sum(1), pa.int32())
        ords[f"{name}_ords"] = blocks.picked(ord_, on, pa.int32())
        b.kind = np.where(marked & full, KIND[kind], b.kind)
    numbers, units = _incoherent(b, columns)
    b.kind = np.where(numbers | units, KIND["TEXT"], b.kind)
    out["proofread"] = pa.array(numbers.sum(1) + units.sum(1), pa.int32())
    wrong = [blocks.picked(b.ord, on, pa.int32()) for on in (numbers, units)]
    return {"ps": b.ps(), **out, **ords, "wrong": pa.StructArray.from_arrays(wrong, ["numbers", "units"])}


_SENSED = f"ps {blocks.PS}, cols array<struct<x:double,y_min:double,y_max:double,count:int>>, headers int, row_labels int, specs int, sections int, proofread int, headers_ords array<int>, row_labels_ords array<int>, specs_ords array<int>, sections_ords array<int>, wrong struct<numbers:array<int>,units:array<int>>"


def sensed(rows: DataFrame) -> DataFrame:
    """pages -> pages whose particles have their final types, with cols and the counts of what was changed. A page of
    fewer than five particles stays as it is. Thousands of pages at once: see blocks."""
    schema = StructType([rows.schema["page_key"], *StructType.fromDDL(_SENSED).fields])

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in blocks.Words(batch.column("ps")).blocks():
            found = _sense(b)
            yield pa.RecordBatch.from_arrays([batch.column("page_key").take(pa.array(b.rows)), *found.values()], ["page_key", *found])

    return blocks.batches(rows, of, schema)


def neighbour_evidence(row: Column, everything: Column) -> Column:
    """For each step of a line (particles by left edge): whether some particle off the line is nearer to the left word
    than half the distance to the right one, and more below or above than beside it."""
    def of(s: Column) -> Column:
        here = F.transform(s, lambda p: p["ord"])

        def gap(q: Column, i: Column) -> Column:
            p = F.get(s, i)
            ahead = F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
            dx, dy = (lambda o: F.abs(p["x"] - o["x"])), (lambda o: F.abs(p["y"] - o["y"]))
            return F.exists(everything, lambda o: ~F.array_contains(here, o["ord"]) & (F.sqrt(dx(o) * dx(o) + dy(o) * dy(o)) < ahead * 0.5) & (dy(o) > dx(o)))

        return F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), gap)

    return let(_by(row, "x0"), of)
