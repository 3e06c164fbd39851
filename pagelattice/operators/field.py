"""Binding numbers to labels, headings and units: a potential, and for each number the best of each kind."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expr import let
from . import blocks
from .blocks import Block, compact, order_of, take, upper_median
from .sense import of_type

#: How strongly a number and a particle of a type belong together; all other types don't. Fixed values.
ATTRACTION = {"SPEC_LABEL": 1.0, "SIZE_HEADER": 0.8, "MODEL": 0.6, "KW_HEADER": 0.8, "UNIT": 0.7, "NUMERIC": 0.3, "TEXT": -0.1, "SECTION": 0.0}
#: Power of the distance by which the potential decays; default tolerances; default weight of magnitudes. Fixed values.
DECAY, SIGMA_Y, SIGMA_X, LAMBDA_Z = 0.5, 6.0, 30.0, 50.0
HEADINGS = ("MODEL", "SIZE_HEADER", "KW_HEADER")


def _sigmas(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Tolerances of each page from the distances of its numbers: sigma_y and sigma_x."""
    on = b.has("NUMERIC")
    down, n = order_of(on, b.y)
    dy, there = blocks.steps(take(b.y, down), n)
    line = np.rint(b.y / 10) * 10
    along, _ = order_of(on, line, b.x)
    dx, _ = blocks.steps(take(b.x, along), n)
    same, _ = blocks.steps(take(line, along), n)
    sy = upper_median(dy, there & (dy > 3) & (dy < 50)) * 0.6
    sx = upper_median(dx, there & (same == 0) & (dx > 10) & (dx < 150)) * 0.5
    usual = lambda v, low, high, default: np.where((n < 3) | np.isnan(v), default, np.clip(v, low, high))
    return usual(sy, 4.0, 20.0, SIGMA_Y), usual(sx, 15.0, 60.0, SIGMA_X)


def _lambda_z(y: np.ndarray, z: np.ndarray, on: np.ndarray, sigma_y: np.ndarray) -> np.ndarray:
    """Weight of magnitudes: sigma_y over the usual spread of magnitudes on a line (numbers with z)."""
    on = on & ~np.isnan(z)
    line = np.rint(y / (sigma_y * 2)[:, None])
    order, n = order_of(on, line, z)
    there = np.arange(order.shape[1]) < n[:, None]
    r, k = np.nonzero(there)
    line, z = take(line, order)[r, k], take(z, order)[r, k]
    first = np.flatnonzero(np.diff(r, prepend=-1).astype(bool) | (np.diff(line, prepend=np.nan) != 0)) if len(r) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(r))
    first, size = first[size >= 3], size[size >= 3]
    spread = z[first + 3 * size // 4] - z[first + size // 4]
    page, spread = r[first][(spread > 0.01) & (spread < 2.0)], spread[(spread > 0.01) & (spread < 2.0)]
    count = np.bincount(page, minlength=len(n))
    by = np.lexsort((spread, page))
    usual = np.full(len(n), np.nan)
    some = np.flatnonzero(count)
    usual[some] = spread[by][(np.cumsum(count) - count + count // 2)[some]]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(usual) | (usual < 0.01), LAMBDA_Z, np.clip(sigma_y / usual, 10.0, 500.0))


def merged_labels(ps: Column, near_y: float = 9.0, near_x: float = 80.0) -> Column:
    """Labels on lines close to each other, without a number's line between them, become one, at the end of the list."""
    labels = F.array_sort(F.transform(of_type(ps, "SPEC_LABEL"), lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"), p.alias("p"))))

    def of(w: Column) -> Column:
        s, nums = w["labels"], w["nums"]

        def breaks(v: Column, i: Column) -> Column:
            u = F.get(s, i - 1)
            dy = F.abs(v["y"] - u["y"])
            between = (dy > 2) & F.exists(nums, lambda n: (n > F.least(v["y"], u["y"])) & (n < F.greatest(v["y"], u["y"])))
            return F.when(i == 0, 0).when((dy < near_y) & (F.abs(v["x"] - u["x"]) < near_x) & ~between, 0).otherwise(1)

        runs = F.aggregate(F.transform(s, breaks), F.array().cast("array<int>"), lambda acc, b: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + b)))

        def one(g: Column, k: Column) -> Column:
            low, high = (lambda c: F.array_min(F.transform(g, lambda p: p[c]))), (lambda c: F.array_max(F.transform(g, lambda p: p[c])))
            text = F.substring(F.array_join(F.transform(g, lambda p: p["text"]), " "), 1, 80)
            y = F.aggregate(g, F.lit(0.0), lambda a, p: a + p["y"]) / F.size(g)
            last = F.array_max(F.transform(ps, lambda p: p["ord"]))
            return F.struct((last + 1 + k).cast("int").alias("ord"), text.alias("text"), low("x").alias("x"), y.alias("y"), low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"), high("size").alias("size"), F.lit("SPEC_LABEL").alias("type"))

        def joined(r: Column) -> Column:
            every = F.transform(F.sequence(F.lit(0), F.array_max(r)), lambda k: F.transform(F.filter(F.transform(s, lambda v, i: F.struct(F.get(r, i).alias("g"), v["p"].alias("p"))), lambda v: v["g"] == k), lambda v: v["p"]))
            several = F.filter(every, lambda g: F.size(g) >= 2)
            gone = F.flatten(F.transform(several, lambda g: F.transform(g, lambda p: p["ord"])))
            return F.concat(F.filter(ps, lambda p: ~F.array_contains(gone, p["ord"])), F.transform(several, one))

        return F.when(F.size(s) < 2, ps).otherwise(let(runs, joined))

    return let(F.struct(labels.alias("labels"), F.transform(of_type(ps, "NUMERIC"), lambda p: p["y"]).alias("nums")), of)


def attraction(kind: Column) -> Column:
    rule = F.when(F.lit(False), 0.0)
    for k, w in ATTRACTION.items():
        rule = rule.when(kind == k, w)
    return rule.otherwise(0.0)


def potential(num: Column, other: Column, axis: str, sigma: Column, weight: Column | None = None, lam: Column | None = None, other_z: Column | None = None) -> Column:
    """How strongly a number is drawn to a particle, along its line or its column; 0 where their types don't attract."""
    w = attraction(other["type"]) if weight is None else weight
    dx, dy = num["x"] - other["x"], num["y"] - other["y"]
    off, before = (dy, other["x"] < num["x"]) if axis == "row" else (dx, other["y"] < num["y"])
    aligned = F.exp(-(off * off) / (sigma * sigma)) * F.when(before, 1.2).otherwise(0.8)
    dz = F.lit(0.0) if lam is None else F.coalesce(F.when(lam > 0, lam * (num["z"] - other_z)), F.lit(0.0))
    return F.when(w <= 0, 0.0).otherwise(w * aligned / F.pow(F.greatest(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(1.0)), F.lit(DECAY)))


_BEST = "struct<phi:double,o:int,text:string,type:string,second:double>"
_FACT = "struct<entity:string,entity_ord:int,spec:string,spec_ord:int,value:string,unit:string,x:double,y:double,phi_spec:double,phi_col:double>"
_BOUND = f"ps {blocks.PS}, params struct<sigma_y:double,sigma_x:double,lambda_z:double>, nums array<struct<k:int,ord:int,text:string,x:double,y:double,z:double,spec:{_BEST},head:{_BEST},unit:{_BEST}>>, headings array<struct<x:double,label:string,type:string>>, facts array<{_FACT}>"
_NUMBER = re.compile(r"[-+]?\d+[.,]?\d*")


def _magnitudes(texts: pa.Array) -> np.ndarray:
    """typing.magnitude of texts, NaN without one."""
    coded = pc.dictionary_encode(texts)
    if not len(coded):
        return np.zeros(0)

    def first(text: str | None) -> float:
        found = _NUMBER.search((text or "").replace(" ", ""))
        return abs(float(found[0].replace(",", "."))) if found and found[0].isascii() else np.nan

    v = np.fromiter(map(first, coded.dictionary.to_pylist()), float, len(coded.dictionary))
    return np.where(v < 0.001, 0.0, np.log10(v + 1))[coded.indices.to_numpy(zero_copy_only=False)]


def _close_labels(b: Block, near_y: float = 9.0, near_x: float = 80.0) -> np.ndarray:
    """Which pages have labels near enough to be merged."""
    order, n = order_of(b.has("SPEC_LABEL"), b.y, b.x, b.ord)
    (dy, there), (dx, _) = blocks.steps(take(b.y, order), n), blocks.steps(take(b.x, order), n)
    return (there & (np.abs(dy) < near_y) & (np.abs(dx) < near_x)).any(1)


def _with_merged(ps: list[dict], near_y: float = 9.0, near_x: float = 80.0) -> list[dict]:
    """merged_labels of one page."""
    labels = sorted((p for p in ps if p["type"] == "SPEC_LABEL" and p["y"] is not None and p["x"] is not None), key=lambda p: (p["y"], p["x"], p["ord"]))
    nums = [p["y"] for p in ps if p["type"] == "NUMERIC" and p["y"] is not None]
    runs: list[list[dict]] = []
    for p in labels:
        u = runs[-1][-1] if runs else None
        low, high = (min(p["y"], u["y"]), max(p["y"], u["y"])) if u else (0, 0)
        joins = u and high - low < near_y and abs(p["x"] - u["x"]) < near_x and not (high - low > 2 and any(low < v < high for v in nums))
        runs[-1].append(p) if joins else runs.append([p])
    several = [r for r in runs if len(r) >= 2]
    gone = {p["ord"] for r in several for p in r}
    last = max((p["ord"] for p in ps), default=0)

    def one(k: int, g: list[dict]) -> dict:
        ends = lambda pick, c: pick((p[c] for p in g if p[c] is not None), default=None)
        total = 0.0
        for p in g:
            total += p["y"]
        return {"ord": last + 1 + k, "text": " ".join(p["text"] for p in g)[:80], "x": ends(min, "x"), "y": total / len(g), "x0": ends(min, "x0"), "y0": ends(min, "y0"), "x1": ends(max, "x1"), "y1": ends(max, "y1"), "size": ends(max, "size"), "type": "SPEC_LABEL"}

    return [p for p in ps if p["ord"] not in gone] + [one(k, g) for k, g in enumerate(several)]


class _Others:
    """Particles that numbers may be bound to: places, weights, places in the batch's words; in list order."""

    def __init__(self, b: Block, on: np.ndarray, weight: np.ndarray | None = None):
        self.where, self.on, self.n = compact(on)
        self.x, self.y, self.at, self.kind = (take(v, self.where) for v in (b.x, b.y, b.at, b.kind))
        self.w = None if weight is None else take(weight, self.where)
        self.z: np.ndarray | None = None

    def then(self, other: _Others) -> _Others:
        """These, and the others behind them."""
        for c in ("x", "y", "at", "kind", "w", "on"):
            setattr(self, c, np.concatenate([getattr(self, c), getattr(other, c)], axis=1))
        order, self.n = order_of(self.on)
        for c in ("x", "y", "at", "kind", "w", "on"):
            setattr(self, c, take(getattr(self, c), order))
        return self


def _strongest(num: _Others, others: _Others, axis: str, sigma: np.ndarray, lam: np.ndarray | None = None, allowed=None) -> tuple[np.ndarray, ...]:
    """For each number the greatest positive potential, the place of the first particle that has it among the others, and
    the next potential after it: 0 where there is none."""
    best, second, chosen = np.zeros(num.x.shape), np.zeros(num.x.shape), np.full(num.x.shape, -1)
    for k in range(others.x.shape[1]):
        x, y, w = (v[:, k, None] for v in (others.x, others.y, others.w))
        dx, dy = num.x - x, num.y - y
        off, before = (dy, x < num.x) if axis == "row" else (dx, y < num.y)
        s = sigma[:, None]
        aligned = np.exp(-(off * off) / (s * s)) * np.where(before, 1.2, 0.8)
        dz = 0.0 if lam is None else np.nan_to_num(np.where(lam[:, None] > 0, lam[:, None] * (num.z - others.z[:, k, None]), 0.0), nan=0.0)
        phi = w * aligned / np.power(np.maximum(np.sqrt(dx * dx + dy * dy + dz * dz), 1.0), DECAY)
        phi = np.where((w > 0) & others.on[:, k, None] & (phi > 0), phi, 0.0)
        if allowed is not None:
            phi = np.where(allowed(k), phi, 0.0)
        ahead = phi > best
        second = np.where(ahead, best, np.maximum(second, phi))
        chosen = np.where(ahead, k, chosen)
        best = np.where(ahead, phi, best)
    return best, second, chosen


def _label_z(num: _Others, specs: _Others, sigma_y: np.ndarray) -> np.ndarray:
    """The usual magnitude of the numbers near each label's line."""
    order, n = order_of(num.on & ~np.isnan(num.z), num.z)
    z, y, there = take(num.z, order), take(num.y, order), np.arange(order.shape[1]) < n[:, None]
    out = np.full(specs.x.shape, np.nan)
    reach = (sigma_y * 3)[:, None]
    for k in range(specs.x.shape[1] if z.shape[1] else 0):
        near = there & (y >= specs.y[:, k, None] - reach) & (y <= specs.y[:, k, None] + reach)
        upto, count = np.cumsum(near, axis=1), near.sum(1)
        out[:, k] = np.where(count > 0, z[np.arange(len(n)), (upto > (count // 2)[:, None]).argmax(1)], np.nan)
    return out


def _rounded(v: np.ndarray) -> np.ndarray:
    return np.floor(v * 1e4 + 0.5) / 1e4


def _facts(page: np.ndarray, entity: np.ndarray, spec: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of numbers in order, those that are facts, in order of first mention, with the ords of their entity and label in
    their page. Of numbers bound to one entity and label, a later one replaces what is there if its potential is above that
    of the one it replaces, rounded to four digits."""
    if not len(page):
        return (np.zeros(0, np.int64),) * 3
    by = np.lexsort((spec, entity, page))
    key = np.stack([page[by], entity[by], spec[by]])
    first = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
    size = np.diff(first, append=len(by))
    kept = by[first]
    for k in range(1, size.max()):
        more = np.flatnonzero(size > k)
        later = by[first[more] + k]
        above = phi[later] > _rounded(phi[kept[more]])
        kept[more[above]] = later[above]
    order = np.argsort(by[first])
    kept = kept[order]
    page, entity = page[kept], entity[kept]
    place = np.arange(len(kept)) - np.searchsorted(page, page)
    named = np.lexsort((place, entity, page))
    fresh = np.concatenate(([True], (np.diff(page[named]) != 0) | (np.diff(entity[named]) != 0)))
    firsts = np.sort(named[fresh])
    rank = np.arange(len(firsts)) - np.searchsorted(page[firsts], page[firsts])
    of_group = np.zeros(len(kept), np.int64)
    of_group[firsts] = rank
    of_entity = np.zeros(len(kept), np.int64)
    of_entity[named] = of_group[named[fresh]][np.cumsum(fresh) - 1]
    return kept, of_entity, place


def _bind(b: Block, zones: pa.ListArray | None, soft: tuple[float, int, float] | None, texts: pa.Array, codes: np.ndarray, unknown: int) -> dict[str, pa.Array]:
    sy, sx = _sigmas(b)
    num = _Others(b, b.has("NUMERIC"))
    num.z = b.of(b.words.z)[np.arange(len(b.n))[:, None], num.where]
    lam = _lambda_z(num.y, num.z, num.on, sy)
    weigh = np.array([ATTRACTION.get(name.as_py(), 0.0) for name in b.words.names])
    weight = np.where(b.on, weigh[b.kind], 0.0)
    specs, heads, units = _Others(b, b.has("SPEC_LABEL"), weight), _Others(b, b.has(*HEADINGS), weight), _Others(b, b.has("UNIT"), weight)
    specs.z = _label_z(num, specs, sy)
    if soft:
        factor, sure, least = soft
        below = np.zeros(b.on.shape, np.int64)
        for k in range(num.x.shape[1]):
            below += num.on[:, k, None] & (np.abs(num.x[:, k, None] - b.x) < (sx * factor)[:, None]) & (num.y[:, k, None] > b.y + 5)
        share = np.minimum(1.0, below / sure)
        heads = heads.then(_Others(b, b.has("TEXT") & (share > least), -0.1 + share * 0.7))
    allowed = None
    if zones is not None:
        bounds, of_num, of_head = zones.take(pa.array(b.rows)), np.zeros(num.x.shape, np.int64), np.zeros(heads.x.shape, np.int64)
        page = np.repeat(np.arange(len(b.n)), pc.fill_null(pc.list_value_length(bounds), 0).to_numpy(zero_copy_only=False))
        v = bounds.flatten().to_numpy(zero_copy_only=False)
        nth = np.arange(len(page)) - np.searchsorted(page, page)
        for k in range(nth.max(initial=-1) + 1):
            bound = np.full(len(b.n), np.inf)
            bound[page[nth == k]] = v[nth == k]
            of_num += bound[:, None] <= num.x
            of_head += bound[:, None] <= heads.x
        allowed = lambda k: of_head[:, k, None] == of_num
    bound = (num.n >= 2) & ((specs.n > 0) | (heads.n > 0))
    on = num.on & bound[:, None]
    found = {"spec": (specs, *_strongest(num, specs, "row", sy, lam)), "head": (heads, *_strongest(num, heads, "col", sx, None, allowed)), "unit": (units, *_strongest(num, units, "row", sy))}
    r, k = np.nonzero(on)
    here = num.at[r, k]
    best, text = {}, {}
    for name, (others, phi, second, chosen) in found.items():
        phi, second, chosen = phi[r, k], second[r, k], chosen[r, k]
        none = chosen < 0
        where = np.where(none, 0, others.at[r, np.where(none, 0, chosen)]) if others.at.shape[1] else np.zeros(len(r), np.int64)
        kind = np.where(none, 0, others.kind[r, np.where(none, 0, chosen)]) if others.at.shape[1] else np.zeros(len(r), np.int64)
        text[name] = texts.take(pa.array(where, mask=none))
        fields = [pa.array(phi, mask=none), pa.array(chosen, pa.int32(), mask=none), text[name], b.words.names.take(pa.array(kind, mask=none)), pa.array(second, mask=none | (second == 0))]
        best[name] = (pa.StructArray.from_arrays(fields, ["phi", "o", "text", "type", "second"], mask=pa.array(none)), phi, where, none)
    x, y, z = num.x[r, k], num.y[r, k], num.z[r, k]
    value = texts.take(pa.array(here))
    place = lambda v: pa.array(v, mask=np.isnan(v))
    nums = pa.StructArray.from_arrays([pa.array(k, pa.int32()), pa.array(b.words.ord[here], pa.int32()), value, place(x), place(y), place(z), *(best[c][0] for c in found)], ["k", "ord", "text", "x", "y", "z", *found])
    # Facts: the numbers that have a label.
    has = np.flatnonzero(~best["spec"][3])
    (_, phi, spec_at, _), (_, phi_head, head_at, no_head) = best["spec"], best["head"]
    entity = np.where(no_head[has], unknown, codes[head_at[has]]) if len(has) else np.zeros(0, np.int64)
    kept, entity_ord, spec_ord = _facts(r[has], entity, codes[spec_at[has]] if len(has) else np.zeros(0, np.int64), phi[has])
    one = has[kept]
    pick = pa.array(one)
    named = pc.fill_null(text["head"].take(pick), "UNKNOWN")
    facts = pa.StructArray.from_arrays([named, pa.array(entity_ord, pa.int32()), text["spec"].take(pick), pa.array(spec_ord, pa.int32()), value.take(pick), text["unit"].take(pick), place(x[one]), place(y[one]), pa.array(_rounded(phi[one])), pa.array(_rounded(np.where(no_head[one], 0.0, phi_head[one])))], ["entity", "entity_ord", "spec", "spec_ord", "value", "unit", "x", "y", "phi_spec", "phi_col"])
    shown = heads.on & bound[:, None]
    headings = pa.StructArray.from_arrays([place(heads.x[shown]), texts.take(pa.array(heads.at[shown])), b.words.names.take(pa.array(heads.kind[shown]))], ["x", "label", "type"])
    params = pa.StructArray.from_arrays([pa.array(v) for v in (sy, sx, lam)], ["sigma_y", "sigma_x", "lambda_z"])
    return {"ps": b.ps(), "params": params, "nums": blocks.lists(on.sum(1), nums), "headings": blocks.lists(shown.sum(1), headings), "facts": blocks.lists(np.bincount(r[one], minlength=len(b.n)), facts)}


def bonds(rows: DataFrame, zones: str | None = None, soft: tuple[float, int, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """pages -> page_key, the columns to keep, ps, params (sigma_y, sigma_x, lambda_z), nums: for each number its best label,
    heading and unit; headings; facts: what the numbers say, in order of first mention.

    With `zones`, a column of boundaries, a heading must lie in its number's zone. With `soft` (width of a column in
    sigmas, numbers below that make a heading sure, least probability), plain text is a heading by the share of numbers
    below it. A page without two numbers, or with neither labels nor headings, has no bonds. Thousands of pages at once.
    """
    schema = StructType([*(rows.schema[c] for c in ("page_key", *keep)), *StructType.fromDDL(_BOUND).fields])

    def of(batch: pa.RecordBatch, merged: bool = False) -> Iterator[pa.RecordBatch]:
        words = blocks.Words(batch.column("ps"))
        numeric = words.kind == blocks.KIND["NUMERIC"]
        words.z = np.full(len(numeric), np.nan)
        words.z[numeric] = _magnitudes(words.text.filter(pa.array(numeric)))
        coded = pc.dictionary_encode(pa.concat_arrays([words.text, pa.array(["UNKNOWN"], words.text.type)])).indices.to_numpy(zero_copy_only=False)
        for b in words.blocks():
            close = np.zeros(len(b.n), bool) if merged else _close_labels(b)
            if close.any():
                some = batch.take(pa.array(b.rows[close]))
                at = some.schema.get_field_index("ps")
                ps = pa.array([_with_merged(p) for p in some.column(at).to_pylist()], some.schema.field(at).type)
                yield from of(some.set_column(at, some.schema.field(at), ps), True)
                b = Block(words, b.rows[~close])
            if len(b.n):
                found = _bind(b, batch.column(zones) if zones else None, soft, words.text, coded, coded[-1])
                passed = {c: batch.column(c).take(pa.array(b.rows)) for c in ("page_key", *keep)} | found
                yield pa.RecordBatch.from_arrays(list(passed.values()), list(passed))

    return blocks.batches(rows, of, schema, (*keep, *((zones,) if zones and zones not in keep else ())))


def bond_rows(bound: DataFrame) -> DataFrame:
    """A row for each number: its best label, heading and unit, null where there is none."""
    n = bound.select("page_key", F.explode("nums").alias("n"))
    return n.select("page_key", "n.k", "n.ord", F.col("n.text").alias("value"), "n.x", "n.y", F.col("n.spec.text").alias("spec"), F.col("n.head.text").alias("heading"), F.col("n.unit.text").alias("unit"), F.col("n.spec.phi").alias("phi_spec"), F.col("n.head.phi").alias("phi_col"), F.col("n.unit.phi").alias("phi_unit"), F.col("n.spec.second").alias("second_spec"), F.col("n.head.second").alias("second_col"))


def fact_rows(bound: DataFrame) -> DataFrame:
    return bound.select("page_key", F.explode("facts").alias("f")).select("page_key", "f.*")


def unmapped(bound: DataFrame) -> DataFrame:
    """Numbers without a label."""
    return bond_rows(bound).filter("spec is null").select("page_key", "ord", "value", "x", "y")


def confidence(bound: DataFrame) -> DataFrame:
    """1 less the ratio of the second potential to the first, for label and heading; numbers bound on both axes."""
    second = lambda c: F.coalesce(F.col(f"second_{c}"), F.lit(0.0))
    rows = bond_rows(bound).filter("phi_spec > 0 and phi_col > 0")
    return rows.select("page_key", "ord", "spec", "heading", (1 - second("spec") / F.col("phi_spec")).alias("conf_row"), (1 - second("col") / F.col("phi_col")).alias("conf_col"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts of two extractions by place: same, different, only in one; counts for each page."""
    key = lambda d, n: d.select("page_key", F.round("x", 1).alias("kx"), F.round("y", 1).alias("ky"), F.struct("entity", "spec").alias(n)).groupBy("page_key", "kx", "ky").agg(F.max(n).alias(n))
    both = key(a, "a").join(key(b, "b"), ["page_key", "kx", "ky"], "full_outer")
    return both.groupBy("page_key").agg(F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") != F.col("b")).alias("different"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
