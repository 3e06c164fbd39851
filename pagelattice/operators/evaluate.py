"""Holding results against truth: boundaries, bonds, grids, receipts, forms, fields and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import f1, first_mode, fscore, let, natural_threshold, staged
from ..functions.typing import normalised
from .grid import K_Y, grids, positive
from .gridding import gridded, judged
from .sense import _by, columns_of, crystal, lists, neighbour_evidence, rows_of

_COUNTS = "struct<tp:bigint,fp:bigint,tn:bigint,fn:bigint,total:bigint>"


def nearest(v: Column, regions: Column, low: str, high: str) -> Column:
    """The region whose middle is nearest, the first of equals."""
    return F.array_min(F.transform(regions, lambda r, i: F.struct(F.abs(v - (r[low] + r[high]) / 2).alias("d"), i.alias("i"))))["i"]


def _confusion(marks: Column) -> Column:
    """An array of (truth, predicted) -> counts."""
    n = lambda t, p: F.size(F.filter(marks, lambda m: (m["t"] == t) & (m["p"] == p))).cast("long")
    return F.struct(n(True, True).alias("tp"), n(False, True).alias("fp"), n(False, False).alias("tn"), n(True, False).alias("fn"), F.size(marks).cast("long").alias("total")).cast(_COUNTS)


def boundary_marks(ps: Column, regions: Column, axis: str = "x", method: str = "gap", short: bool = False) -> Column:
    """Truth and prediction of every step in lines (columns, on the y axis) with three positive gaps or more; with `short`,
    in all lines, those with fewer gaps having no boundary.

    gap: above the line's natural threshold. Where a line shows no jump, gap+nn also takes steps whose words have nearer
    neighbours above or below, if half of the line's do, and gap+crystal those across which the page's centres part.
    """
    low, high, r_low, r_high = (("x0", "x1", "xmin", "xmax") if axis == "x" else ("y0", "y1", "ymin", "ymax"))
    lines = F.transform(F.filter(lists(rows_of(ps) if axis == "x" else columns_of(ps)), lambda r: F.size(r) >= 2), lambda r: _by(r, low))

    def with_bounds(bounds: Column) -> Column:
        def one(s: Column) -> Column:
            gaps = F.transform(F.slice(s, 2, F.size(s) - 1), lambda q, i: F.struct((q[low] - F.get(s, i)[high]).alias("g"), F.get(s, i).alias("a"), q.alias("b"), i.alias("i")))

            def judged(w: Column) -> Column:
                def mark(g: Column, ev: Column | None) -> Column:
                    truth = nearest(g["a"][axis], regions, r_low, r_high) != nearest(g["b"][axis], regions, r_low, r_high)
                    said = F.coalesce(g["g"] > w["t"], F.lit(False))
                    if method == "gap+nn":
                        said = said | (w["t"].isNull() & (g["g"] > 1.0) & F.coalesce(F.get(ev, g["i"]), F.lit(False)))
                    if method == "gap+crystal":
                        said = said | (w["t"].isNull() & F.exists(bounds, lambda b: (g["a"]["x1"] < b) & (b < g["b"]["x0"])))
                    return F.struct(truth.alias("t"), said.alias("p"))

                if method != "gap+nn":
                    return F.transform(w["gaps"], lambda g: mark(g, None))
                enough = lambda e: F.when(F.size(F.filter(e, lambda v: v)) >= F.size(e) * 0.5, e)
                evidence = let(F.when(w["t"].isNull(), neighbour_evidence(s, ps)), enough)
                return let(F.struct(evidence.alias("e")), lambda e: F.transform(w["gaps"], lambda g: mark(g, e["e"])))

            def threshold(w: Column) -> Column:
                t = let(positive(w), lambda p: let(natural_threshold(p), lambda t: F.when((t <= F.array_max(p)) & (F.size(p) >= 3), t)))
                none = F.array().cast("array<struct<t:boolean,p:boolean>>")
                marks = let(F.struct(t.alias("t"), w.alias("gaps")), judged)
                return marks if short else F.when(F.size(positive(w)) >= 3, marks).otherwise(none)

            return let(gaps, threshold)

        return F.flatten(F.transform(lines, one))

    return let(crystal(ps) if method == "gap+crystal" else F.array().cast("array<double>"), with_bounds)


def boundaries(rows: DataFrame, axis: str = "x", method: str = "gap") -> DataFrame:
    """pages with rows and columns of truth -> counts for each page with any step judged; both axes add up."""
    axes = ("x", "y") if axis == "both" else (axis,)
    if method == "gap" or axis == "y":
        return judged(rows, axes).filter("total > 0").drop("words")
    marks = [F.when(F.size("columns" if a == "x" else "rows") >= 2, boundary_marks(F.col("ps"), F.col("columns" if a == "x" else "rows"), a, method if a == "x" else "gap")) for a in axes]
    empty = F.array().cast("array<struct<t:boolean,p:boolean>>")
    out = staged(rows, c=let(F.concat(*[F.coalesce(m, empty) for m in marks]), _confusion))
    return out.filter("c.total > 0").select("page_key", "c.*")


def word_pairs(rows: DataFrame) -> DataFrame:
    """pages with columns of truth -> counts of neighbours in lines: whether truth and the line's natural threshold agree
    that a boundary lies between them; and the page's words."""
    return judged(rows.filter(F.size("columns") >= 2), ("x",), short=True).filter("total > 0")


def containing(v: Column, regions: Column, low: str, high: str) -> Column:
    """The first region that holds a place, ends included; -1 without one."""
    return F.coalesce(F.array_min(F.filter(F.transform(regions, lambda r, i: F.when((v >= r[low]) & (v <= r[high]), i)), lambda i: i.isNotNull())), F.lit(-1))


def bond_accuracy(bound: DataFrame, truth: DataFrame) -> DataFrame:
    """Facts against the true grid: an entity stands for the column that most of its facts lie in, a label for the row."""
    facts = bound.select("page_key", "nums", F.col("facts").alias("fs")).join(truth, "page_key")
    placed = F.transform("fs", lambda f: F.struct(f["entity"].alias("e"), f["spec"].alias("s"), containing(f["x"], F.col("columns"), "xmin", "xmax").alias("c"), containing(f["y"], F.col("rows"), "ymin", "ymax").alias("r")))

    def judged(fs: Column) -> Column:
        usual = lambda f, name, place: first_mode(F.transform(F.filter(fs, lambda g: (g[name] == f[name]) & (g[place] >= 0)), lambda g: g[place]))
        return F.transform(fs, lambda f: F.struct(F.coalesce((f["c"] >= 0) & (usual(f, "e", "c") == f["c"]), F.lit(False)).alias("c"), F.coalesce((f["r"] >= 0) & (usual(f, "s", "r") == f["r"]), F.lit(False)).alias("r")))

    out = staged(facts, j=let(placed, judged))
    n = F.size("fs")
    share = lambda what: F.when(n > 0, F.size(F.filter("j", what)) / n).otherwise(0.0)
    mapped = F.size(F.filter("nums", lambda x: x["spec"].isNotNull()))
    return out.select("page_key", n.alias("n_bonds"), share(lambda j: j["c"]).alias("col_acc"), share(lambda j: j["r"]).alias("row_acc"), share(lambda j: j["c"] & j["r"]).alias("cell_acc"), F.when((n > 0) & (F.size("nums") > 0), mapped / F.size("nums")).otherwise(0.0).alias("coverage"))


def structure(rows: DataFrame, col_method: str = "ratio", row_method: str = "fixed", k_y: float = K_Y) -> DataFrame:
    """pages with rows and columns of truth and no spans -> grid sizes found and true, and the grid score, which for
    grids of single cells is the overlap of the two sizes. Too large and too small tables are left out."""
    sized = rows.filter((F.size("rows").between(1, 50)) & (F.size("columns").between(1, 30)) & (F.size("ps") >= 3))
    found = grids(sized, col_method, row_method, k_y, ("n_cols", "n_rows"), ("rows", "columns")).filter("n_rows <= 60 and n_cols <= 35")
    t_rows, t_cols = F.size("rows"), F.size("columns")
    score = fscore(F.least(t_rows, F.col("n_rows")) * F.least(t_cols, F.col("n_cols")), t_rows * t_cols, F.col("n_rows") * F.col("n_cols"))
    out = staged(found, s=score)
    return out.select("page_key", t_rows.alias("gt_rows"), t_cols.alias("gt_cols"), F.col("n_rows").alias("pred_rows"), F.col("n_cols").alias("pred_cols"), F.col("s.f").alias("top"), F.col("s.precision").alias("top_precision"), F.col("s.recall").alias("top_recall"), (F.col("n_cols") == t_cols).alias("col_exact"), (F.col("n_rows") == t_rows).alias("row_exact"))


def weighted(accuracies: DataFrame, n: str = "n_bonds", of: tuple[str, ...] = ("col_acc", "row_acc", "cell_acc")) -> DataFrame:
    """Averages over pages, each weighing as much as its count; 0 where nothing is counted."""
    return accuracies.agg(F.count(F.lit(1)).alias("pages"), F.sum(n).alias(n), *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col(n)), F.sum(n)), F.lit(0.0)).alias(c) for c in of])


def histogram(scores: DataFrame, of: str, bins: int = 10) -> DataFrame:
    """How many pages score in each of equal bins from 0 to 1, which is in the last one."""
    return scores.groupBy(F.least(F.floor(F.round(of, 6) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("pages"))


def column_errors(scores: DataFrame) -> DataFrame:
    """Tables by how many columns too many (or too few, below 0) were found, with their mean score."""
    return scores.groupBy((F.col("pred_cols") - F.col("gt_cols")).alias("off")).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("top"), 6).alias("top"))


def fixed_against_jump(rows: DataFrame, k_y: float = 0.05) -> DataFrame:
    """Grid scores with columns by the fixed ratio and by the largest jump, rows by a fixed constant, over all pages."""
    kinds = [structure(rows, method, "fixed", k_y).withColumn("method", F.lit(name)) for method, name in (("ratio", "fixed"), ("maxjump", "maxjump"))]
    share = lambda c: F.avg(F.col(c).cast("int"))
    return kinds[0].unionByName(kinds[1]).groupBy("method").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("top"), 6).alias("top"), F.round(share("col_exact"), 6).alias("col_exact"), F.round(share("row_exact"), 6).alias("row_exact"))


def k_sweep(rows: DataFrame, ks: tuple[float, ...] = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)) -> DataFrame:
    """Share of pages whose number of columns is right, for each boundary constant, in one pass over the pages."""
    found = gridded(rows, "k_cols", ks=ks, keep=("columns",))
    each = F.arrays_zip(F.array(*[F.lit(k) for k in ks]).alias("k"), F.col("k_cols").alias("n"))
    return found.select(F.size("columns").alias("true"), F.explode(each).alias("r")).groupBy("r.k").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("r.n") == F.col("true")).alias("exact"))


def strata(scores: DataFrame) -> DataFrame:
    """Scores by the number of true columns: 1 to 3, 4 to 6, 7 and more, and over all."""
    size = F.when(F.col("gt_cols") <= 3, "1-3").when(F.col("gt_cols") <= 6, "4-6").otherwise("7+")
    return scores.withColumn("size", size).rollup("size").agg(F.count(F.lit(1)).alias("pages"), F.avg("top").alias("top"), F.avg(F.col("col_exact").cast("int")).alias("col_exact"), F.avg(F.col("row_exact").cast("int")).alias("row_exact"), F.count_if(F.col("pred_cols") > F.col("gt_cols")).alias("too_many"), F.count_if(F.col("pred_cols") < F.col("gt_cols")).alias("too_few"))


def confidence_bins(confidences: DataFrame, bound: DataFrame, truth: DataFrame) -> DataFrame:
    """Numbers by tenths of their row confidence, and how many of each tenth are bound to the label of their true row."""
    rows = bound.join(truth, "page_key").select("page_key", "rows", F.explode("nums").alias("n"))
    true_row = containing(F.col("n.y"), F.col("rows"), "ymin", "ymax")
    ok = rows.select("page_key", F.col("n.ord").alias("ord"), (F.col("n.spec.text") == F.concat(F.lit("Line "), (true_row + 1).cast("string"))).alias("ok"))
    both = confidences.join(ok, ["page_key", "ord"])
    return both.groupBy(F.least(F.lit(9), F.floor(F.round("conf_row", 6) * 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("right"))


def type_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many particles of each type became which; both with page_key, ord, type."""
    both = before.select("page_key", "ord", F.col("type").alias("was")).join(after.select("page_key", "ord", "type"), ["page_key", "ord"])
    return both.groupBy("was", F.col("type").alias("now")).agg(F.count(F.lit(1)).alias("n"))


def _place(x: Column, y: Column) -> Column:
    return F.struct(F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))


def receipt_levels(words: DataFrame, bound: DataFrame) -> DataFrame:
    """Receipts: for each true line with a value, whether a number of it is bound (presence), bound to a word of its own
    line (spatial), to one of its key (bond), and has the line's whole value (value); by category, with false finds.

    words: page_key, ord, text, x, y, line_idx, is_key, category. Returns category, tp of the four levels, lines; the row
    without category counts the finds at no true value.
    """
    facts = bound.select("page_key", F.explode("facts").alias("f")).select("page_key", _place(F.col("f.x"), F.col("f.y")).alias("at"), "f.entity", "f.spec", "f.value")
    facts = facts.groupBy("page_key", "at").agg(F.max(F.struct("entity", "spec", "value")).alias("f")).select("page_key", "at", "f.*")
    lines = words.groupBy("page_key", "line_idx", "category").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_key") == 1, F.struct("ord", "text")))).alias("ks"),
        F.sort_array(F.collect_list(F.when(F.col("is_key") != 1, F.struct(F.col("ord"), F.col("text"), _place(F.col("x"), F.col("y")).alias("at"))))).alias("vs"),
    ).filter(F.size("vs") > 0)
    values = lines.select("page_key", "line_idx", F.posexplode("vs").alias("k", "v")).select("page_key", "line_idx", "k", "v.at")
    hits = values.join(facts, ["page_key", "at"]).groupBy("page_key", "line_idx").agg(F.min(F.struct("k", "entity", "spec", "value")).alias("h"))
    named = words.select("page_key", F.lower("text").alias("name"), "line_idx").groupBy("page_key", "name").agg(F.collect_set("line_idx").alias("on"))
    out = lines.join(hits, ["page_key", "line_idx"], "left")
    for side in ("entity", "spec"):
        other = named.select(F.col("page_key").alias("__page"), F.col("name").alias(f"{side}_name"), F.col("on").alias(f"{side}_on"))
        out = out.join(other, (F.lower(f"h.{side}") == F.col(f"{side}_name")) & (F.col("page_key") == F.col("__page")), "left").drop("__page")
    found = F.col("h").isNotNull()
    words_in = lambda c: F.split(F.lower(c), " ")
    keys = F.split(F.lower(F.array_join(F.transform("ks", lambda k: k["text"]), " ")), " ")
    bond = found & (F.size("ks") > 0) & (F.arrays_overlap(keys, words_in(F.col("h.entity"))) | F.arrays_overlap(keys, words_in(F.col("h.spec"))))
    spatial = found & (F.coalesce(F.array_contains("entity_on", F.col("line_idx")), F.lit(False)) | F.coalesce(F.array_contains("spec_on", F.col("line_idx")), F.lit(False)))
    value = bond & (F.trim("h.value") == F.array_join(F.transform("vs", lambda v: v["text"]), " "))
    levels = out.groupBy("category").agg(F.count(F.lit(1)).alias("lines"), F.count_if(spatial).alias("spatial"), F.count_if(found).alias("presence"), F.count_if(bond).alias("bond"), F.count_if(value).alias("value"))
    false = facts.join(values.select("page_key", "at").distinct(), ["page_key", "at"], "left_anti").agg(F.count(F.lit(1)).alias("lines"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("spatial", "presence", "bond", "value")]
    return levels.unionByName(false.select(F.lit(None).cast("string").alias("category"), "lines", *zero))


def category_rollup(levels: DataFrame) -> DataFrame:
    """Levels by category and by the part of its name before the point, with recall."""
    rows = levels.filter("category is not null").withColumn("family", F.substring_index("category", ".", 1))
    out = rows.rollup("family", "category").agg(*[F.sum(c).alias(c) for c in ("lines", "spatial", "presence", "bond", "value")])
    return out.withColumn("recall", F.col("spatial") / F.col("lines"))


def link_levels(words: DataFrame, links: DataFrame, bound: DataFrame) -> DataFrame:
    """Forms: for each true link, whether a number of its answer is bound to any question (spatial) and to its own (bond),
    and whether it has a number at all.

    words: page_key, text, x, y, type, entity_id, label; links: page_key, from_id, to_id. Returns page_key and counts.
    """
    facts = bound.select("page_key", F.explode("facts").alias("f")).select("page_key", _place(F.col("f.x"), F.col("f.y")).alias("at"), F.struct(F.lower("f.entity").alias("e"), F.lower("f.spec").alias("s")).alias("f"))
    facts = facts.groupBy("page_key", "at").agg(F.max("f").alias("f"))
    w = words.withColumn("at", _place(F.col("x"), F.col("y")))
    reached = w.select("page_key", F.col("entity_id").alias("to_id"), "ord", "at", "type").join(facts, ["page_key", "at"], "left")
    answers = reached.groupBy("page_key", "to_id").agg(F.min(F.when(F.col("f").isNotNull(), F.struct("ord", "f"))).alias("h"), F.max((F.col("type") == "NUMERIC").cast("int")).alias("numeric"))
    names = w.select("page_key", F.lower("text").alias("name"), "entity_id", (F.col("label") == "question").alias("q")).groupBy("page_key", "name").agg(F.collect_set("entity_id").alias("ids"), F.max("q").alias("q"))
    out = links.join(answers, ["page_key", "to_id"], "left")
    for side in ("e", "s"):
        other = names.select(F.col("page_key").alias("__page"), F.col("name").alias(f"{side}_name"), F.col("ids").alias(f"{side}_ids"), F.col("q").alias(f"{side}_q"))
        out = out.join(other, (F.col(f"h.f.{side}") == F.col(f"{side}_name")) & (F.col("page_key") == F.col("__page")), "left").drop("__page")
    yes = lambda c: F.coalesce(c, F.lit(False))
    found = F.col("h").isNotNull()
    spatial = found & (yes(F.col("e_q")) | yes(F.col("s_q")))
    bond = found & (yes(F.array_contains("e_ids", F.col("from_id"))) | yes(F.array_contains("s_ids", F.col("from_id"))))
    return out.groupBy("page_key").agg(F.count(F.lit(1)).alias("links"), F.count_if(spatial).alias("spatial"), F.count_if(bond).alias("bond"), F.count_if(~found & (F.coalesce("numeric", F.lit(0)) == 0)).alias("unreachable"))


def field_presence(words: DataFrame, truth: DataFrame, bound: DataFrame) -> DataFrame:
    """Known fields of a page (page_key, field, value): words that match, whether one is a number, whether one is bound.

    A total matches as a whole, a date in part from four characters on, any other field by its words of three or more.
    """
    at = bound.select("page_key", F.explode("facts").alias("f")).select("page_key", _place(F.col("f.x"), F.col("f.y")).alias("at"), F.lit(True).alias("bound")).distinct()
    w = words.select("page_key", normalised(F.col("text")).alias("w"), "type", _place(F.col("x"), F.col("y")).alias("at")).join(at, ["page_key", "at"], "left")
    fields = truth.filter("value <> ''").withColumns({"v": normalised(F.col("value")), "parts": F.filter(F.transform(F.split("value", r"\s+"), normalised), lambda p: F.length(p) >= 3)})
    v, x = F.col("v"), F.col("w")
    match = F.when(F.col("field") == "total", x == v).when(F.col("field") == "date", (F.length(x) >= 4) & (v.contains(x) | x.contains(v))).otherwise((F.length(x) >= 3) & F.array_contains("parts", x))
    both = fields.join(w, "page_key").filter(match).groupBy("page_key", "field").agg(F.count(F.lit(1)).alias("matched"), F.max(F.col("type") == "NUMERIC").alias("reachable"), F.max(F.coalesce("bound", F.lit(False))).alias("present"))
    out = fields.select("page_key", "field").join(both, ["page_key", "field"], "left")
    return out.select("page_key", "field", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.coalesce("reachable", F.lit(False)).alias("reachable"), F.coalesce("present", F.lit(False)).alias("present"))


def label_purity(words: DataFrame, bound: DataFrame) -> DataFrame:
    """Labelled words (page_key, x, y, type, label): how many of each label are numbers and are bound."""
    at = bound.select("page_key", F.explode("facts").alias("f")).select("page_key", _place(F.col("f.x"), F.col("f.y")).alias("at"), F.lit(True).alias("bound")).distinct()
    w = words.withColumn("at", _place(F.col("x"), F.col("y"))).join(at, ["page_key", "at"], "left")
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("type") == "NUMERIC").alias("numeric"), F.count_if("bound").alias("bonded"))


def entity_purity(words: DataFrame, bound: DataFrame) -> DataFrame:
    """For each page: bound words that have the most frequent label of their entity, and bound words."""
    at = bound.select("page_key", F.explode("facts").alias("f")).select("page_key", _place(F.col("f.x"), F.col("f.y")).alias("at"), "f.entity")
    n = words.withColumn("at", _place(F.col("x"), F.col("y"))).join(at, ["page_key", "at"]).groupBy("page_key", "entity", "label").agg(F.count(F.lit(1)).alias("n"))
    best = n.withColumn("best", F.max("n").over(Window.partitionBy("page_key", "entity"))).groupBy("page_key", "entity").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return best.groupBy("page_key").agg(F.sum("best").alias("correct"), F.sum("n").alias("total"))


def scores(counts: DataFrame) -> DataFrame:
    """Summed counts of boundaries -> precision, recall, f1 and accuracy."""
    s = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "total")])
    return s.withColumn("s", f1(F.col("tp"), F.col("fp"), F.col("fn"))).select("tp", "fp", "tn", "fn", "total", "s.precision", "s.recall", "s.f1", ((F.col("tp") + F.col("tn")) / F.col("total")).alias("accuracy"))


def bounded_zones(ps: Column) -> Column:
    """Column boundaries that several lines agree on: gaps above the page's natural threshold, in runs nearer than 30,
    with two votes or 15 in a hundred lines; their means."""
    from .grid import _mean, _runs, gaps_of

    lines = lists(rows_of(ps))
    gaps = F.filter(F.flatten(F.transform(F.filter(lines, lambda r: F.size(r) >= 2), lambda r: gaps_of(_by(r, "x0")))), lambda g: g["g"] > 0)

    def of(w: Column) -> Column:
        cut = lambda t: F.array_sort(F.transform(F.filter(w["gaps"], lambda g: g["g"] > t), lambda g: g["at"]))
        runs = let(natural_threshold(F.transform(w["gaps"], lambda g: g["g"])), lambda t: _runs(cut(t), F.lit(30.0)))
        return F.transform(F.filter(runs, lambda c: F.size(c) >= F.greatest(F.lit(2.0), w["n"] * 0.15)), _mean)

    return let(F.struct(gaps.alias("gaps"), F.size(lines).alias("n")), of)


def grid_rows(rows: DataFrame, row_method: str) -> DataFrame:
    """page_key and the number of rows by a method, on columns by ratio."""
    return gridded(rows, "n_rows", row_method=row_method)
