"""Grids from gaps: how many columns and rows a page has, where they part, and which cell a particle is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp, first_mode, let, median, natural_threshold, staged
from .gridding import gridded
from .sense import PARTICLE, _by, columns_of, crystal, lists, row_spacing_all, rows_of

#: The boundary constant of gaps over widths, and of gaps over heights. Fixed values.
K_X, K_Y = 0.3, 0.1
_DOUBLES = "array<double>"


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def gaps_of(items: Column, axis: str = "x") -> Column:
    """Particles in order along an axis -> gap, middle and both ends of each step."""
    low, high = f"{axis}0", f"{axis}1"
    return let(items, lambda s: F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda q, i: F.struct((q[low] - F.get(s, i)[high]).alias("g"), ((F.get(s, i)[high] + q[low]) / 2).alias("at"), F.get(s, i)[high].alias("left"), q[low].alias("right"))))


def positive(gaps: Column) -> Column:
    return F.filter(F.transform(gaps, lambda g: g["g"]), lambda g: g > 0)


def _lines(ps: Column, axis: str) -> Column:
    """Rows of a page in order of left edges, or its columns in order of top edges; those of two particles or more."""
    groups = lists(rows_of(ps)) if axis == "x" else lists(columns_of(ps))
    return F.transform(F.filter(groups, lambda r: F.size(r) >= 2), lambda r: _by(r, f"{axis}0"))


def _extent(p: Column, axis: str) -> Column:
    return p[f"{axis}1"] - p[f"{axis}0"]


def ratio_threshold(row: Column, k: float = K_X) -> Column:
    mean = _mean(F.transform(row, lambda p: _extent(p, "x")))
    return let(mean, lambda m: F.when(m > 0, m).otherwise(10.0) * k)


def count_ratio(row: Column, k: float = K_X) -> Column:
    """Columns of a row: gaps wider than k mean widths, and one."""
    return let(ratio_threshold(row, k), lambda t: F.size(F.filter(gaps_of(row), lambda g: g["g"] > t)) + 1)


def count_maxjump(items: Column, everywhere: Column, axis: str = "x") -> Column:
    """Columns of a row (rows of a column): gaps above the row's natural threshold; above that of the whole page where
    the row shows no jump or has few gaps; and without any jump, all gaps or none by their size against the particles'."""
    def of(w: Column) -> Column:
        gaps = w["gaps"]

        def threshold(pos: Column) -> Column:
            sizes = F.filter(F.transform(w["items"], lambda p: _extent(p, axis)), lambda v: v > 0)
            usual = F.coalesce(median(sizes), F.lit(10.0))
            plain = F.when(median(pos) > usual * 0.5, F.array_min(pos) - 0.1).otherwise(F.array_max(pos) + 1)
            own = lambda t: F.when(t <= F.array_max(pos), t).when(everywhere <= F.array_max(pos), everywhere).otherwise(plain)
            return F.when(F.size(pos) >= 3, let(natural_threshold(pos), own)).otherwise(F.coalesce(everywhere, median(pos) * 2))

        pos = positive(gaps)
        return F.when(F.size(pos) == 0, 1).otherwise(let(let(pos, threshold), lambda t: F.size(F.filter(gaps, lambda g: g["g"] > t)) + 1))

    return let(F.struct(gaps_of(items, axis).alias("gaps"), items.alias("items")), of)


def count_universal(ps: Column, axis: str = "x", method: str = "maxjump", k: float = K_X) -> Column:
    """Columns (rows) of a page: each row (column) votes, the mode wins, the first one of several."""
    def of(lines: Column) -> Column:
        if method == "fixed":
            votes = F.transform(lines, lambda r: count_ratio(r, k))
        else:
            every = F.flatten(F.transform(lines, lambda r: positive(gaps_of(r, axis))))
            votes = let(let(every, lambda g: F.when(F.size(g) > 0, natural_threshold(g))), lambda t: F.transform(lines, lambda r: count_maxjump(r, t, axis)))
        return F.coalesce(first_mode(votes), F.lit(1))

    return F.when(F.size(ps) < 2, F.greatest(F.lit(1), F.size(ps))).otherwise(let(_lines(ps, axis), of))


def _best_line(found: Column, target: Column) -> Column:
    """Of the lines that voted for the target, the boundaries of the one with the most particles, the first of several."""
    agree = F.filter(F.transform(found, lambda f, i: F.struct(f["size"].alias("size"), (-i).alias("first"), f["n"].alias("n"), f["cuts"].alias("cuts"))), lambda f: (f["n"] == target) & (F.size(f["cuts"]) == target - 1))
    return F.when(target > 1, F.coalesce(F.array_max(agree)["cuts"], F.array().cast(_DOUBLES))).otherwise(F.array().cast(_DOUBLES))


def _voted(row: Column, threshold) -> Column:
    """A line's size, its boundaries above a threshold and the number of parts they make."""
    cuts = let(threshold(row), lambda t: F.transform(F.filter(gaps_of(row), lambda g: g["g"] > t), lambda g: g["at"]))
    return let(cuts, lambda c: F.struct(F.size(row).alias("size"), (F.size(c) + 1).alias("n"), c.alias("cuts")))


def col_splits(ps: Column, method: str = "ratio", k: float = K_X) -> Column:
    """Boundaries between columns. Methods: ratio, ratio+crystal, max+crystal, adaptive+crystal, natural, maxjump."""
    if method == "maxjump":
        return _splits_maxjump(ps)["splits"]
    if method == "natural":
        return _splits_natural(ps)

    def of(found: Column) -> Column:
        votes = F.transform(found, lambda f: f["n"])
        if method == "max+crystal":
            target = F.array_max(votes)
        elif method == "adaptive+crystal":
            target = let(votes, _adaptive)
        else:
            target = first_mode(votes)
        rescue = F.array().cast(_DOUBLES) if method == "ratio" else let(crystal(ps), lambda c: F.when(F.size(c) <= 20, c).otherwise(F.array().cast(_DOUBLES)))
        return F.when(F.size(found) == 0, F.array().cast(_DOUBLES)).otherwise(let(target, lambda t: F.when(t <= 1, rescue).otherwise(_best_line(found, t))))

    found = F.transform(_lines(ps, "x"), lambda r: _voted(r, lambda x: ratio_threshold(x, k)))
    return F.when(F.size(ps) < 2, F.array().cast(_DOUBLES)).otherwise(let(found, of))


def _adaptive(votes: Column) -> Column:
    """The mode if seven tenths agree, else the greatest number above it with two votes, else the greatest."""
    count = lambda v: F.size(F.filter(votes, lambda x: x == v))
    above = lambda m: F.array_max(F.filter(F.array_distinct(votes), lambda v: (v > m) & (count(v) >= 2)))
    return let(first_mode(votes), lambda m: F.when(count(m) / F.size(votes) >= 0.7, m).otherwise(F.coalesce(above(m), F.array_max(votes))))


def _splits_natural(ps: Column) -> Column:
    """Each row's natural threshold; rows without a jump are parted where the page's centres line up."""
    def of(bounds: Column) -> Column:
        def one(row: Column) -> Column:
            def cut(gaps: Column) -> Column:
                pos = positive(gaps)
                t = let(pos, lambda p: F.when(F.size(p) >= 3, let(natural_threshold(p), lambda t: F.when(t <= F.array_max(p), t))))
                rescued = lambda g: F.exists(bounds, lambda b: (g["left"] < b) & (b < g["right"]))
                return let(F.struct(t.alias("t")), lambda w: F.transform(F.filter(gaps, lambda g: F.when(w["t"].isNull(), rescued(g)).otherwise(g["g"] > w["t"])), lambda g: g["at"]))

            return let(let(gaps_of(row), cut), lambda c: F.struct(F.size(row).alias("size"), (F.size(c) + 1).alias("n"), c.alias("cuts")))

        found = F.transform(_lines(ps, "x"), one)
        return let(found, lambda f: F.when(F.size(f) == 0, F.array().cast(_DOUBLES)).otherwise(let(first_mode(F.transform(f, lambda r: r["n"])), lambda t: _best_line(f, t))))

    return F.when(F.size(ps) < 2, F.array().cast(_DOUBLES)).otherwise(let(crystal(ps), of))


def _runs(places: Column, tolerance: Column) -> Column:
    """Sorted places -> lists of those that follow each other nearer than the tolerance."""
    step = lambda acc, v: F.when((F.size(acc) > 0) & (v - F.element_at(F.element_at(acc, -1), -1) < tolerance), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(v))))).otherwise(F.concat(acc, F.array(F.array(v))))
    safe = lambda acc, v: F.when(F.size(acc) == 0, F.array(F.array(v))).otherwise(step(acc, v))
    return F.aggregate(places, F.array().cast("array<array<double>>"), safe)


def _splits_maxjump(ps: Column) -> Column:
    """Boundaries that several rows agree on, each row with its own threshold or that of the page: splits, and the mean
    threshold."""
    def of(w: Column) -> Column:
        def with_page(t: Column) -> Column:
            own = lambda g: let(F.transform(g, lambda x: x["g"]), lambda v: F.when(F.size(v) >= 3, let(natural_threshold(v), lambda o: F.when(o > F.array_max(v), t).otherwise(o))).otherwise(t))
            rows = F.transform(F.filter(w["gaps"], lambda g: F.size(g) > 0), lambda g: let(own(g), lambda o: F.struct(o.alias("t"), F.transform(F.filter(g, lambda x: x["g"] > o), lambda x: x["at"]).alias("cuts"))))

            def agreed(r: Column) -> Column:
                thresholds = F.transform(r, lambda x: x["t"])
                runs = let(median(thresholds) * 0.5, lambda tol: _runs(F.array_sort(F.flatten(F.transform(r, lambda x: x["cuts"]))), tol))
                splits = F.array_sort(F.transform(F.filter(runs, lambda c: F.size(c) >= F.greatest(F.lit(2.0), w["n"] * 0.2)), median))
                none = F.size(F.flatten(F.transform(r, lambda x: x["cuts"]))) == 0
                return F.struct(splits.alias("splits"), F.when(none, t).otherwise(_mean(thresholds)).alias("threshold"))

            return let(rows, agreed)

        every = F.transform(F.flatten(w["gaps"]), lambda g: g["g"])
        empty = F.struct(F.array().cast(_DOUBLES).alias("splits"), F.lit(0.0).alias("threshold"))
        return F.when(F.size(every) == 0, empty).otherwise(let(natural_threshold(every), with_page))

    rows = lists(rows_of(ps))
    return let(rows, lambda r: let(F.struct(F.size(r).alias("n"), F.transform(F.filter(r, lambda x: F.size(x) >= 2), lambda x: F.filter(gaps_of(_by(x, "x0")), lambda g: g["g"] > 0)).alias("gaps")), of))


def cell_of(x: Column, splits: Column) -> Column:
    """How many boundaries lie below a place."""
    return F.size(F.filter(splits, lambda s: x > s))


def _in_columns(ps: Column, splits: Column) -> Column:
    """Particles by the column they are in, in order of their top edges."""
    return let(splits, lambda s: F.transform(F.sequence(F.lit(0), F.size(s)), lambda c: _by(F.filter(ps, lambda p: cell_of(p["x"], s) == c), "y0")))


def height_threshold(col: Column, k: float = K_Y) -> Column:
    heights = F.filter(F.transform(col, lambda p: p["y1"] - p["y0"]), lambda h: h > 0)
    return let(heights, lambda h: F.when(F.size(h) > 0, clamp(_mean(h), 3.0, 30.0) * k))


def _col_votes(ps: Column, splits: Column, method: str, k: float) -> Column:
    def one(col: Column) -> Column:
        gaps = gaps_of(col, "y")
        if method == "natural":
            kept = F.filter(gaps, lambda g: g["g"] > 0.5)
            cuts = let(kept, lambda gs: F.when(F.size(gs) < 2, F.array().cast(_DOUBLES)).otherwise(let(natural_threshold(F.transform(gs, lambda g: g["g"])), lambda t: F.transform(F.filter(gs, lambda g: g["g"] > t), lambda g: g["at"]))))
        else:
            cuts = let(F.struct(height_threshold(col, k).alias("t")), lambda w: F.transform(F.filter(gaps, lambda g: g["g"] > w["t"]), lambda g: g["at"]))
        return let(cuts, lambda c: F.struct(F.size(col).alias("size"), (F.size(c) + 1).alias("n"), c.alias("cuts")))

    return F.transform(F.filter(_in_columns(ps, splits), lambda c: F.size(c) >= 2), one)


def row_splits(ps: Column, splits: Column, method: str = "fixed", k: float = K_Y) -> Column:
    """Boundaries between rows, from the columns that `splits` make. Methods: fixed, natural, consensus."""
    if method == "consensus":
        return _row_consensus(ps, splits, k)
    return let(_col_votes(ps, splits, method, k), lambda f: F.when(F.size(f) == 0, F.array().cast(_DOUBLES)).otherwise(let(first_mode(F.transform(f, lambda r: r["n"])), lambda t: _best_line(f, t))))


def _row_consensus(ps: Column, splits: Column, k: float, share: float = 0.4) -> Column:
    """Boundaries that enough columns have, at their mean."""
    def of(found: Column) -> Column:
        places = F.array_sort(F.flatten(F.transform(found, lambda f: f["cuts"])))
        least = F.greatest(F.lit(2), F.floor(F.size(found) * share).cast("int"))
        runs = let(F.greatest(F.lit(3.0), row_spacing_all(ps) * 0.4), lambda tol: _runs(places, tol))
        return F.when(F.size(found) < 2, F.array().cast(_DOUBLES)).otherwise(F.transform(F.filter(runs, lambda c: F.size(c) >= least), _mean))

    return let(_col_votes(ps, splits, "fixed", k), of)


def row_groups(ps: Column, splits: Column, method: str = "fixed", k: float = K_Y) -> Column:
    """Particles with `g`, their row: by boundaries where there are any, else by closeness; rows are numbered without gaps."""
    def cut(bounds: Column) -> Column:
        numbered = F.transform(ps, lambda p: F.struct(*[p[c].alias(c) for c in PARTICLE], cell_of(p["y0"], bounds).alias("g")))
        return F.when(F.size(bounds) == 0, rows_of(ps)).otherwise(let(numbered, _dense))

    return let(row_splits(ps, splits, method, k), cut)


def _dense(rows: Column) -> Column:
    groups = F.array_sort(F.array_distinct(F.transform(rows, lambda p: p["g"])))
    return let(groups, lambda g: F.transform(rows, lambda p: F.struct(*[p[c].alias(c) for c in PARTICLE], (F.array_position(g, p["g"]) - 1).cast("int").alias("g"))))


def predicted_cells(ps: Column, splits: Column, row_method: str = "fixed", k: float = K_Y) -> Column:
    """Every cell of the grid, empty ones too: row, col, and the texts in it joined in the order of its row."""
    def of(rows: Column) -> Column:
        n_rows = F.coalesce(F.array_max(F.transform(rows, lambda p: p["g"])) + 1, F.lit(0))
        placed = F.transform(rows, lambda p: F.struct(p["g"].alias("g"), cell_of(p["x"], splits).alias("c"), p["text"].alias("text")))
        text = lambda r, c: lambda ws: F.array_join(F.transform(F.filter(ws, lambda w: (w["g"] == r) & (w["c"] == c)), lambda w: w["text"]), " ")
        each = let(placed, lambda ws: F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n_rows - 1, F.lit(0))), lambda r: F.transform(F.sequence(F.lit(0), F.size(splits)), lambda c: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), text(r, c)(ws).alias("text"))))))
        return F.when(n_rows > 0, each).otherwise(F.slice(each, 1, 0))

    return let(row_groups(ps, splits, row_method, k), of)


def grids(rows: DataFrame, col_method: str = "ratio", row_method: str = "fixed", k_y: float = K_Y, made: tuple[str, ...] = ("splits", "rowed", "n_cols", "n_rows"), keep: tuple[str, ...] = ()) -> DataFrame:
    """pages -> page_key, the columns to keep, splits, rowed, n_cols, n_rows (or others of `gridded`) by a method for columns
    and one for rows, thousands of pages at once."""
    if col_method in ("ratio", "maxjump"):
        return gridded(rows.drop("splits"), *made, col_method=col_method, row_method=row_method, k_x=K_X, k_y=k_y, keep=keep)
    found = staged(rows, splits=col_splits(F.col("ps"), col_method))
    return gridded(found, *made, row_method=row_method, k_x=K_X, k_y=k_y, keep=keep)


def splits_of(rows: DataFrame, method: str = "ratio") -> DataFrame:
    """pages -> page_key, splits: col_splits of each page. What the ratio can be counted for runs over many pages at once."""
    if method in ("ratio", "maxjump"):
        return gridded(rows.drop("splits"), "splits", col_method=method)
    if method != "ratio+crystal":
        return rows.select("page_key", col_splits(F.col("ps"), method).alias("splits"))
    found = gridded(staged(rows, lined_up=crystal(F.col("ps"))), "splits", "n_lines", keep=("lined_up",))
    alone = (F.col("n_lines") > 0) & (F.size("splits") == 0)
    return found.select("page_key", F.when(alone & (F.size("lined_up") <= 20), F.col("lined_up")).otherwise(F.col("splits")).alias("splits"))


#: Words of a cell that reaches over the next one. Fixed values.
REACHING = ("total", "average", "subtotal", "sum", "mean", "median")


def joined_cells(cells: Column) -> Column:
    """Predicted cells, row by row, with those joined that look like one: row, cols, text.

    An empty cell belongs to the cell on its left, if that one has a text. A cell with a reaching word also takes the
    next one after that if it is empty or a number. What a cell takes depends on its three nearest to the right alone, so
    that nothing has to be followed through a row; cells that are wide but have no text don't exist, as blank words are no
    particles."""
    def of(cs: Column) -> Column:
        def beside(c: Column, i: Column, k: int) -> Column:
            other = F.when(i + k >= 0, F.get(cs, i + k))
            return F.when(other["row"] == c["row"], other["text"])

        blank = lambda t: F.trim(t) == ""
        number = lambda t: F.regexp_replace(F.trim(t), r"\.", "").rlike("^[0-9]+$")
        reaches = lambda t: F.lower(t).rlike("|".join(REACHING))
        sure = lambda x: F.coalesce(x, F.lit(False))
        follows = lambda t, left: sure(blank(t) & ~blank(left))

        def marked(c: Column, i: Column) -> Column:
            two, one, t, after, last = (beside(c, i, k) if k else c["text"] for k in (-2, -1, 0, 1, 2))
            after_left, after_two = follows(t, one), follows(one, two)
            taken = sure((blank(t) | number(t)) & ((reaches(one) & ~after_left) | (reaches(two) & after_two)))
            empty = follows(after, t)
            more = sure(reaches(t)) & F.when(empty, sure(blank(last) | number(last))).otherwise(sure(blank(after) | number(after)))
            return F.struct(c["row"].alias("row"), c["col"].alias("col"), t.alias("text"), (after_left | taken).alias("gone"), (empty.cast("int") + more.cast("int")).alias("more"))

        heads = F.filter(F.transform(cs, marked), lambda c: ~c["gone"])
        return F.transform(heads, lambda c: F.struct(c["row"].alias("row"), F.sequence(c["col"], c["col"] + c["more"]).alias("cols"), c["text"].alias("text")))

    return let(cells, of)


def dense_rows(rowed: Column, splits: Column, least: float = 0.3) -> Column:
    """Particles with their row g -> rows (lists of x, y0) after those that fill too few columns went to the nearer of their
    neighbours, by upper medians of y0, the upper one of equals.

    One pass from top to bottom: rows above are dense already, a sparse one is added to the last of them, or carried over
    to the next one, which is looked at with what it got."""
    row_type = "array<struct<x:double,y0:double>>"
    listed = F.transform(F.array_sort(F.array_distinct(F.transform(rowed, lambda p: p["g"]))), lambda g: F.transform(F.filter(rowed, lambda p: p["g"] == g), lambda p: F.struct(p["x"].alias("x"), p["y0"].alias("y0")))).cast(f"array<{row_type}>")
    middle = lambda r: F.get(F.array_sort(F.transform(r, lambda p: p["y0"])), F.floor(F.size(r) / 2).cast("int"))

    def of(rows: Column) -> Column:
        filled = lambda r: F.size(F.array_distinct(F.transform(r, lambda p: cell_of(p["x"], splits)))) / (F.size(splits) + 1)

        def step(acc: Column, k: Column) -> Column:
            def placed(w: Column) -> Column:
                row, above, below = w["row"], w["above"], w["below"]
                up = F.abs(middle(row) - middle(above)) <= F.abs(middle(row) - middle(below))
                stays = (filled(row) >= least) | (above.isNull() & below.isNull())
                onto = ~stays & above.isNotNull() & (below.isNull() | up)
                done = F.when(stays, F.concat(acc["done"], F.array(row))).when(onto, F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(F.concat(F.coalesce(above, row), row)))).otherwise(acc["done"])
                return F.struct(done.alias("done"), F.when(stays | onto, F.slice(row, 1, 0)).otherwise(row).alias("carry"))

            near = F.struct(F.concat(F.get(rows, k), acc["carry"]).alias("row"), F.get(acc["done"], F.size(acc["done"]) - 1).alias("above"), F.get(rows, k + 1).alias("below"))
            return let(near, placed)

        none = F.struct(F.array().cast(f"array<{row_type}>").alias("done"), F.array().cast(row_type).alias("carry"))
        folded = F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), none, step, lambda acc: acc["done"])
        return F.when(F.size(rows) > 0, folded).otherwise(F.array().cast(f"array<{row_type}>"))

    return let(listed, of)


def column_count_typed(ps: Column) -> Column:
    """Columns by centres of typed particles less than 20 apart; two particles at least."""
    kinds = ("NUMERIC", "SPEC_LABEL", "MODEL", "MODEL_CODE", "SIZE_HEADER", "KW_HEADER", "UNIT")
    xs = F.array_sort(F.transform(F.filter(ps, lambda p: p["type"].isin(*kinds)), lambda p: p["x"]))
    return F.size(F.filter(_runs(xs, F.lit(20.0)), lambda c: F.size(c) >= 2))


def row_count_plain(ps: Column, tolerance: float = 8.0) -> Column:
    """Rows by distinct centres less than a tolerance apart."""
    return F.size(_runs(F.array_sort(F.array_distinct(F.transform(ps, lambda p: F.round(p["y"], 1)))), F.lit(tolerance)))


def truth_cells(table: DataFrame) -> DataFrame:
    """page_key, rows (ymin, ymax), columns (xmin, xmax), spans (xmin, ymin, xmax, ymax) -> the true cells: rows and
    columns of each, spans that cover half a row and half a column joining them, the first of overlapping spans alone."""
    over = lambda s, r, lo, hi: F.when(r[hi] > r[lo], (F.least(s[hi], r[hi]) - F.greatest(s[lo], r[lo])) / (r[hi] - r[lo])).otherwise(0.0)
    hit = lambda s, regions, lo, hi: F.filter(F.transform(regions, lambda r, i: F.when(over(s, r, lo, hi) >= 0.5, i)), lambda i: i.isNotNull())
    spans = F.transform("spans", lambda s: F.struct(hit(s, F.col("rows"), "ymin", "ymax").alias("rs"), hit(s, F.col("columns"), "xmin", "xmax").alias("cs")))
    spans = F.filter(spans, lambda s: (F.size(s["rs"]) > 0) & (F.size(s["cs"]) > 0))
    clash = lambda a, b: F.arrays_overlap(a["rs"], b["rs"]) & F.arrays_overlap(a["cs"], b["cs"])
    kept = F.aggregate(spans, F.slice(spans, 1, 0), lambda acc, s: F.when(F.exists(acc, lambda a: clash(a, s)), acc).otherwise(F.concat(acc, F.array(s))))
    def cells(ks: Column) -> Column:
        def cell(r: Column, c: Column) -> Column:
            own = F.struct(F.array(r.cast("int")).alias("rs"), F.array(c.cast("int")).alias("cs"))
            return F.coalesce(F.get(F.filter(ks, lambda s: F.array_contains(s["rs"], r.cast("int")) & F.array_contains(s["cs"], c.cast("int"))), 0), own)

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda r: F.transform(F.sequence(F.lit(0), F.size("columns") - 1), lambda c: cell(r, c)))))

    ok = (F.size("rows") > 0) & (F.size("columns") > 0)
    return table.filter(ok).select("page_key", F.explode(let(kept, cells)).alias("c")).select("page_key", F.col("c.rs").alias("row_nums"), F.col("c.cs").alias("col_nums"))
