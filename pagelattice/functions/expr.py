"""Column helpers that the operators are built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(x) with x bound to the value, which is computed once for the row and not once for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    """text without white space at its ends, by Unicode's notion of it. One that begins and ends with visible ASCII has none."""
    plain = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(plain, text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def median(values: Column) -> Column:
    """Mean of the middle one or two; null for none."""
    def of(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return let(F.sort_array(values), of)


def upper_median(values: Column) -> Column:
    """The upper one of the middle two; null for none."""
    return let(F.sort_array(values), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))


def steps(sorted_values: Column) -> Column:
    """Differences of values that follow each other."""
    return let(sorted_values, lambda s: F.when(F.size(s) < 2, F.array().cast("array<double>")).otherwise(F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda v, i: (v - F.get(s, i)).cast("double"))))


def natural_threshold(gaps: Column) -> Column:
    """The middle of the greatest relative jump between sorted gaps: below it lie gaps inside groups, above it those
    between groups. Without a jump by half or more it is above all gaps. Of up to two gaps it is the median, of none 10."""

    def of(g: Column) -> Column:
        n = F.size(g)
        jumps = F.transform(F.slice(g, 1, F.greatest(n - 1, F.lit(0))), lambda v, i: F.when(v > 0, F.struct((F.get(g, i + 1) / v).alias("ratio"), (-i).alias("first"), ((v + F.get(g, i + 1)) / 2).alias("mid"))))
        best = lambda b: F.when(b["ratio"] >= 1.5, b["mid"]).otherwise(F.get(g, n - 1) + 1)
        return F.when(n == 0, F.lit(10.0)).when(n < 3, median(g)).otherwise(let(F.array_max(jumps), lambda b: F.coalesce(best(b), F.get(g, n - 1) + 1)))

    return let(F.sort_array(gaps.cast("array<double>")), of)


def spacing(values: Column, default: float) -> Column:
    """Usual distance of distinct rounded places: the median of the gaps below 2.5 times their upper median."""

    def usual(g: Column) -> Column:
        return let(upper_median(g), lambda m: median(F.filter(g, lambda v: (v > 0) & (v < m * 2.5))))

    places = F.array_sort(F.array_distinct(F.transform(values, lambda v: F.bround(v, 0))))
    return let(places, lambda p: F.when(F.size(p) < 3, F.lit(default)).otherwise(F.coalesce(let(steps(p), usual), F.lit(default))))


def clusters(values: Column, tolerance: Column) -> Column:
    """Greedy grouping of sorted values: each joins the first group whose mean is nearer than the tolerance, else it
    begins one. Returns each value's group, counted from 0."""
    state = "struct<sums:array<struct<s:double,n:int>>,out:array<int>>"

    def put(acc: Column, v: Column, tol: Column) -> Column:
        def placed(at: Column) -> Column:
            grown = F.transform(acc["sums"], lambda r, i: F.when(i == at - 1, F.struct((r["s"] + v).alias("s"), (r["n"] + 1).alias("n"))).otherwise(r))
            new = F.concat(acc["sums"], F.array(F.struct(v.cast("double").alias("s"), F.lit(1).alias("n"))))
            return F.struct(F.when(at > 0, grown).otherwise(new).alias("sums"), F.concat(acc["out"], F.array(F.when(at > 0, at - 1).otherwise(F.size(acc["sums"])).cast("int"))).alias("out")).cast(state)

        return let(F.array_position(F.transform(acc["sums"], lambda r: F.abs(r["s"] / r["n"] - v) < tol), True).cast("int"), placed)

    start = F.struct(F.array().cast("array<struct<s:double,n:int>>").alias("sums"), F.array().cast("array<int>").alias("out")).cast(state)
    return let(tolerance.cast("double"), lambda tol: F.aggregate(values, start, lambda acc, v: put(acc, v, tol), lambda acc: acc["out"]))


def islands(sorted_values: Column, gap) -> Column:
    """For each sorted value the number of its run, from 0: a new run begins where the step is at least gap."""
    def of(s: Column) -> Column:
        breaks = F.transform(s, lambda v, i: F.when(i == 0, 0).when(v - F.get(s, i - 1) >= gap, 1).otherwise(0))
        step = lambda acc, b: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + b))
        return F.aggregate(breaks, F.array().cast("array<int>"), step)

    return let(sorted_values, of)


def first_mode(values: Column) -> Column:
    """The most frequent value; of several, the one that comes first; null for none."""
    counted = lambda vs: F.transform(F.array_distinct(vs), lambda v, i: F.struct(F.size(F.filter(vs, lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("v")))
    return let(values, lambda vs: F.array_max(counted(vs))["v"])


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def total(values: Column) -> Column:
    """Sum from left to right."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))


def fscore(tp: Column, n_true: Column, n_pos: Column) -> Column:
    """precision, recall and their harmonic mean; empty denominators count as 1."""
    p = F.when(n_pos > 0, tp / n_pos).otherwise(1.0)
    r = F.when(n_true > 0, tp / n_true).otherwise(1.0)
    return let(F.struct(p.alias("precision"), r.alias("recall")), lambda x: F.struct(F.when(x["precision"] + x["recall"] > 0, 2 * x["precision"] * x["recall"] / (x["precision"] + x["recall"])).otherwise(0.0).alias("f"), x["precision"].alias("precision"), x["recall"].alias("recall")))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """precision, recall and f1; empty denominators count as 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return let(F.struct(p.alias("precision"), r.alias("recall")), lambda x: F.struct(x["precision"].alias("precision"), x["recall"].alias("recall"), F.when(x["precision"] + x["recall"] > 0, 2 * x["precision"] * x["recall"] / (x["precision"] + x["recall"])).otherwise(0.0).alias("f1")))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x0, y0, x1, y1]; null is an empty cell: two empty ones match, one doesn't."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(F.get(a, k + 2), F.get(b, k + 2)) - F.greatest(F.get(a, k), F.get(b, k)))
    area = lambda x: F.greatest(F.lit(0.0), F.get(x, 2) - F.get(x, 0)) * F.greatest(F.lit(0.0), F.get(x, 3) - F.get(x, 1))
    both = let(F.struct((side(0) * side(1)).alias("i"), (area(a) + area(b)).alias("s")), lambda x: F.when(x["s"] - x["i"] > 0, x["i"] / (x["s"] - x["i"])).otherwise(0.0))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more (or other) columns, each computed once for a row whatever reads it later.

    A projection would be merged with those above it, and an expression that they read often, or inside a lambda, would
    be computed anew each time. A generator of one element is never merged, and costs next to nothing.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__staged")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, made).select(*kept, *[F.col(f"__staged.{k}").alias(k) for k in columns])
