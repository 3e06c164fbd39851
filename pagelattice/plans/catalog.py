"""Registered queries: every operator over whole driver tables, rendered to pages where it needs places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, typing
from ..operators import alignment, assemble, diffusion, evaluate, field, grid, gridding, sense
from ..sources import rendered
from . import catalogue

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    from . import files

    return _QUERIES | files.queries()


def oracle_sql() -> dict[str, str]:
    from .file_oracles import sql as of_files
    from .oracles import sql

    return sql() | of_files()


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid_words(spark: SparkSession, d: str) -> DataFrame:
    return rendered.grid_words(_table(spark, d, "lineitem"))


def grid_particles(spark: SparkSession, d: str) -> DataFrame:
    return typing.particles(grid_words(spark, d))


def grid_pages(spark: SparkSession, d: str) -> DataFrame:
    return sense.pages(grid_particles(spark, d))


def grid_sensed(spark: SparkSession, d: str) -> DataFrame:
    return sense.sensed(grid_pages(spark, d))


def grid_bound(spark: SparkSession, d: str) -> DataFrame:
    return field.bonds(grid_sensed(spark, d))


def grid_truth(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their true rows and columns."""
    n = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_key")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((89.0 + 30 * i).alias("ymin"), (119.0 + 30 * i).alias("ymax")))
    cols = F.array(*[F.struct(F.lit(140.0 + 100 * k).alias("xmin"), F.lit(240.0 + 100 * k).alias("xmax")) for k in range(4)])
    return n.select("page_key", rows.alias("rows"), cols.alias("columns"))


def truth_pages(spark: SparkSession, d: str) -> DataFrame:
    """Typed pages, without titles and headings, beside their truth."""
    body = grid_particles(spark, d).filter("ord > 4")
    return sense.pages(body).join(grid_truth(spark, d), "page_key")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Strings of all sorts made from parts: p_partkey, k, text."""
    size = F.col("p_size").cast("string")
    made = [F.col("p_name"), F.col("code"), F.concat(size, F.lit(" kW")), F.concat(F.lit("("), size, F.lit(")")), F.concat(F.lit("(1"), size, F.lit(")")), rendered.fixed(F.col("p_retailprice"), 2), F.concat(size, F.lit("x840x"), size), F.concat(F.lit("-"), size, F.lit("~43")), F.concat(F.lit("R4"), F.lpad(size, 2, "0"), F.lit("A")), F.concat(size, F.lit("N~/50/380")), F.concat(F.lit("pag. "), size), F.concat(size, F.lit("B")), F.concat(F.lit("www."), F.col("p_type")), F.concat(F.lit("[Dati] peso "), size)]
    made += [F.lit(x) for x in ("°C.", "-", "dB(A)", "Specifications", "COP", "sound pressure level", "Condizionamento", "3,14", "  ", "0", "m", "%", "hp", "dB", "kPa", "l/s", "kBTU/h")]
    codes = rendered.model_codes(_table(spark, d, "part"))
    both = _table(spark, d, "part").join(codes, "p_partkey")
    return both.select("p_partkey", F.posexplode(F.array(*made)).alias("k", "text"))


@query
def typify(spark, d):
    """The whole cascade with all brands' patterns, and without vocabulary."""
    every = typing.patterns_of()
    return samples(spark, d).select("p_partkey", "k", "text", typing.type_of(F.col("text"), every).alias("type"), typing.type_of(F.col("text"), domain=False).alias("plain_type"))


@query
def typify_base(spark, d):
    return samples(spark, d).select("p_partkey", "k", typing.base_type_of(F.col("text")).alias("type"))


@query
def z_norm(spark, d):
    return samples(spark, d).select("p_partkey", "k", F.round(typing.magnitude(F.col("text")), 6).alias("z"))


@query
def brand_detect(spark, d):
    return rendered.model_codes(_table(spark, d, "part")).select("p_partkey", "code", typing.brand_of(F.col("code")).alias("brand"))


@query
def node_type(spark, d):
    return rendered.model_codes(_table(spark, d, "part")).select("p_partkey", typing.node_type_of(F.col("code")).alias("node_type"))


@query
def section_strip(spark, d):
    s = typing.label_and_section(F.col("text"))
    return samples(spark, d).select("p_partkey", "k", s["section"].alias("section"), s["label"].alias("label"))


@query
def normalise(spark, d):
    return samples(spark, d).select("p_partkey", "k", typing.normalised(F.col("text")).alias("normalised"))


@query
def text_page_types(spark, d):
    """Types of all words of all documents, by language."""
    docs = _table(spark, d, "documents")
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+"), F.lit(0))).alias("text"))
    counted = words.groupBy("lang", "text").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("lang", typing.type_of(F.col("text")).alias("type")).agg(F.sum("n").alias("n"))


@query
def page_words(spark, d):
    return grid_words(spark, d)


@query
def particle_types(spark, d):
    return grid_particles(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def natural_threshold(spark, d):
    return _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_key")).agg(F.collect_list("l_quantity").alias("g")).select("page_key", expr.natural_threshold(F.col("g")).alias("threshold"))


@query
def spacings(spark, d):
    ps = F.col("ps")
    return grid_pages(spark, d).select("page_key", sense.row_spacing(ps).alias("rows"), sense.row_spacing_all(ps).alias("rows_all"), sense.col_spacing_all(ps).alias("cols_all"), sense.row_spacing_plain(ps).alias("rows_plain"))


@query
def crystal(spark, d):
    return grid_pages(spark, d).select("page_key", F.explode(sense.crystal(F.col("ps"))).alias("boundary"))


@query
def page_params(spark, d):
    p = grid_bound(spark, d)
    return p.select("page_key", *[F.round(f"params.{c}", 6).alias(c) for c in ("sigma_y", "sigma_x", "lambda_z")])


@query
def rows_fold(spark, d):
    return grid_pages(spark, d).select("page_key", F.explode(sense.rows_of(F.col("ps"))).alias("p")).select("page_key", "p.ord", "p.g")


@query
def cols_fold(spark, d):
    return grid_pages(spark, d).select("page_key", F.explode(sense.columns_of(F.col("ps"))).alias("p")).select("page_key", "p.ord", "p.g")


@query
def detected_columns(spark, d):
    return sense.found_columns(grid_pages(spark, d)).select("page_key", F.explode("cols").alias("c")).select("page_key", F.round("c.x", 6).alias("x"), "c.y_min", "c.y_max", "c.count")


@query
def sensed_types(spark, d):
    return sense.unpacked(grid_sensed(spark, d)).select("page_key", "ord", "text", "type")


@query
def sensing_counts(spark, d):
    return grid_sensed(spark, d).select("page_key", F.size("cols").alias("columns"), "headers", "row_labels", "specs", "sections", "proofread")


@query
def phi_bonds(spark, d):
    b = field.bond_rows(grid_bound(spark, d))
    return b.select("page_key", "ord", "value", "spec", "heading", "unit", *[F.round(c, 4).alias(c) for c in ("phi_spec", "phi_col", "phi_unit")])


@query
def facts(spark, d):
    return field.fact_rows(grid_bound(spark, d)).drop("x", "y")


@query
def unmapped(spark, d):
    return field.unmapped(grid_bound(spark, d)).select("page_key", "ord", "value")


@query
def confidence_top2(spark, d):
    c = field.confidence(grid_bound(spark, d))
    return c.select("page_key", "ord", "spec", "heading", F.round("conf_row", 4).alias("conf_row"), F.round("conf_col", 4).alias("conf_col"))


def _bounded(spark, d) -> DataFrame:
    zoned = expr.staged(grid_sensed(spark, d), zones=evaluate.bounded_zones(F.col("ps")))
    return field.bonds(zoned, zones="zones")


@query
def bounded_bonds(spark, d):
    """Bonds whose headings must lie in their number's zone."""
    return field.bond_rows(_bounded(spark, d)).select("page_key", "ord", "spec", "heading")


@query
def bond_compare(spark, d):
    """Free against bounded extraction."""
    return field.compared(field.fact_rows(grid_bound(spark, d)), field.fact_rows(_bounded(spark, d)))


@query
def soft_headings(spark, d):
    """Plain text as headings by the share of numbers below it, for a few settings: facts and headings named."""
    pages = grid_sensed(spark, d)
    out = []
    for factor, sure, least in ((1.0, 3, 0.1), (1.5, 3, 0.1), (1.0, 5, 0.3)):
        rows = field.fact_rows(field.bonds(pages, soft=(factor, sure, least)))
        out.append(rows.agg(F.lit(f"{factor}/{sure}/{least}").alias("setting"), F.count(F.lit(1)).alias("facts"), F.count_if(F.col("entity") != "UNKNOWN").alias("named")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _results(spark, d) -> DataFrame:
    return assemble.page_results(grid_sensed(spark, d))


@query
def page_class(spark, d):
    return _results(spark, d).select("page_key", "page_type", "mapped", "unmapped", "entities", "total_specs", "n_text", "n_data")


@query
def health(spark, d):
    return assemble.health(grid_bound(spark, d)).groupBy("colour").agg(F.count(F.lit(1)).alias("pages"), F.sum("numeric").alias("numeric"), F.sum("mapped").alias("mapped"))


@query
def rag_chunks(spark, d):
    s = grid_sensed(spark, d)
    return assemble.chunks(s, assemble.page_results(s))


@query
def fingerprints(spark, d):
    fp = assemble.fingerprint(F.col("headings"))
    return grid_bound(spark, d).select("page_key", fp["col_type"].alias("col_type"), F.array_join(fp["labels"], ",").alias("labels"))


def _in_documents(results: DataFrame) -> DataFrame:
    return results.withColumns({"doc_id": F.floor(F.col("page_key") / 12), "page": (F.col("page_key") % 12 + 1).cast("int")})


@query
def cross_page(spark, d):
    """Documents of twelve orders a document: which page each table went to, and how many facts it has then."""
    m = assemble.merged_pages(_in_documents(_results(spark, d)))
    return m.select("doc_id", "page", "base", F.size("facts").cast("long").alias("n_facts"))


@query
def graph_nodes(spark, d):
    n = assemble.graph_nodes(field.fact_rows(grid_bound(spark, d)), "hitachi", "orders")
    return n.select("id", "type", "name", F.size("properties").cast("long").alias("n_properties"), "page_key")


@query
def sql_rows(spark, d):
    return assemble.sql_rows(assemble.graph_nodes(field.fact_rows(grid_bound(spark, d)), "hitachi", "orders"))


@query
def column_counts(spark, d):
    pages = expr.staged(grid_pages(spark, d), typed=grid.column_count_typed(F.col("ps")))
    return gridding.gridded(pages, "n_cols", "jump_cols", keep=("typed",)).select("page_key", F.col("n_cols").alias("ratio"), F.col("jump_cols").alias("maxjump"), "typed")


@query
def row_counts(spark, d):
    pages = expr.staged(grid_pages(spark, d), plain=grid.row_count_plain(F.col("ps")))
    return gridding.gridded(pages, "jump_rows", keep=("plain",)).select("page_key", F.col("jump_rows").alias("maxjump"), "plain")


def _splits(method: str) -> Query:
    def run(spark, d):
        return grid.splits_of(grid_pages(spark, d), method).select("page_key", F.explode("splits").alias("split"))

    return run


for _name, _method in (("ratio", "ratio"), ("ratio_crystal", "ratio+crystal"), ("max_crystal", "max+crystal"), ("adaptive_crystal", "adaptive+crystal"), ("natural", "natural"), ("maxjump", "maxjump")):
    _QUERIES[f"col_splits_{_name}"] = _splits(_method)


def _row_splits(method: str) -> Query:
    def run(spark, d):
        return gridding.gridded(grid_pages(spark, d), "row_splits", row_method=method).select("page_key", F.explode("row_splits").alias("split"))

    return run


for _method in ("fixed", "natural", "consensus"):
    _QUERIES[f"row_splits_{_method}"] = _row_splits(_method)


@query
def rows_density(spark, d):
    """Rows after sparse ones went to their neighbours."""
    return grid.grids(grid_pages(spark, d)).select("page_key", F.size(grid.dense_rows(F.col("rowed"), F.col("splits"))).alias("n_rows"))


@query
def spanning_cells(spark, d):
    """Receipts' predicted cells with those joined that look like one."""
    words = typing.particles(rendered.receipt_words(_table(spark, d, "orders"), _table(spark, d, "customer")))
    pages = gridding.gridded(sense.pages(words), "cells")
    return pages.select("page_key", F.explode(grid.joined_cells(F.col("cells"))).alias("c")).select("page_key", "c.row", F.array_join(F.transform("c.cols", lambda x: x.cast("string")), ",").alias("cols"), "c.text")


@query
def pred_cells(spark, d):
    return gridding.gridded(grid_pages(spark, d), "cells").select("page_key", F.explode("cells").alias("c")).select("page_key", "c.row", "c.col", "c.text")


def _spanned(spark, d) -> DataFrame:
    """Truth with one span over the first two columns of the first row."""
    box = F.struct(F.lit(140.0).alias("xmin"), F.lit(89.0).alias("ymin"), F.lit(340.0).alias("xmax"), F.lit(119.0).alias("ymax"))
    return grid_truth(spark, d).withColumn("spans", F.array(box))


@query
def truth_cells(spark, d):
    c = grid.truth_cells(_spanned(spark, d))
    return c.select("page_key", F.array_join(F.transform("row_nums", lambda r: r.cast("string")), ",").alias("row_nums"), F.array_join(F.transform("col_nums", lambda r: r.cast("string")), ",").alias("col_nums"))


@query
def structure_scores(spark, d):
    s = evaluate.structure(truth_pages(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("top", "top_precision", "top_recall")})


@query
def structure_strata(spark, d):
    s = evaluate.strata(evaluate.structure(truth_pages(spark, d)))
    return s.withColumns({c: F.round(c, 6) for c in ("top", "col_exact", "row_exact")})


@query
def grid_similarity(spark, d):
    """Topology and content scores against truth with a span: alignment by dynamic programming, in Python."""
    cells = lambda rows: F.sort_array(F.collect_list(F.struct("row_nums", "col_nums", "text")))
    truth = grid.truth_cells(_spanned(spark, d))
    values = grid_words(spark, d).filter("col_idx is not null").select("page_key", "row_idx", "col_idx", "text")
    hit = (truth["page_key"] == values["page_key"]) & F.array_contains("row_nums", F.col("row_idx")) & F.array_contains("col_nums", F.col("col_idx"))
    named = truth.join(values, hit, "left").select(truth["page_key"], "row_nums", "col_nums", F.coalesce("text", F.lit("")).alias("t"), "col_idx")
    named = named.groupBy("page_key", "row_nums", "col_nums").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "t"))), lambda s: s["t"]), " ").alias("text"))
    t = named.groupBy("page_key").agg(cells(named).alias("truth"))
    body = sense.pages(grid_particles(spark, d).filter("ord > 4 and x0 > 100"))
    found = gridding.gridded(body, "cells").select("page_key", F.transform("cells", lambda c: F.struct(F.array(c["row"]).alias("row_nums"), F.array(c["col"]).alias("col_nums"), c["text"].alias("text"))).alias("found"))
    out = alignment.grid_similarity(t.join(found, "page_key"))
    return out.select("page_key", F.round("top", 6).alias("top"), F.round("content", 6).alias("content"))


def _boundary(axis: str, method: str = "gap") -> Query:
    return lambda spark, d: evaluate.boundaries(truth_pages(spark, d), axis, method)


_QUERIES |= {"boundary_x": _boundary("x"), "boundary_x_nn": _boundary("x", "gap+nn"), "boundary_x_crystal": _boundary("x", "gap+crystal"), "boundary_y": _boundary("y"), "boundary_both": _boundary("both")}


@query
def boundary_scores(spark, d):
    s = evaluate.scores(evaluate.boundaries(truth_pages(spark, d), "x", "gap+crystal"))
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")})


@query
def bond_accuracy(spark, d):
    a = evaluate.bond_accuracy(grid_bound(spark, d), grid_truth(spark, d))
    return a.withColumns({c: F.round(c, 6) for c in ("col_acc", "row_acc", "cell_acc", "coverage")})


@query
def k_sweep(spark, d):
    return evaluate.k_sweep(truth_pages(spark, d))


@query
def conf_bins(spark, d):
    b = grid_bound(spark, d)
    return evaluate.confidence_bins(field.confidence(b), b, grid_truth(spark, d))


@query
def type_distribution(spark, d):
    before = grid_particles(spark, d).select("page_key", "ord", "type")
    return evaluate.type_shift(before, sense.unpacked(grid_sensed(spark, d)))


def _receipts(spark, d) -> tuple[DataFrame, DataFrame]:
    words = typing.particles(rendered.receipt_words(_table(spark, d, "orders"), _table(spark, d, "customer")))
    return words, field.bonds(sense.sensed(sense.pages(words)))


@query
def receipt_levels(spark, d):
    return evaluate.receipt_levels(*_receipts(spark, d))


@query
def receipt_rollup(spark, d):
    r = evaluate.category_rollup(evaluate.receipt_levels(*_receipts(spark, d)))
    return r.withColumn("recall", F.round("recall", 6))


@query
def link_eval(spark, d):
    """Receipts as forms: keys are questions, values their answers."""
    words, bound = _receipts(spark, d)
    forms = words.withColumns({"entity_id": F.col("ord"), "label": F.when(F.col("is_key") == 1, "question").otherwise("answer")})
    links = words.filter("is_key = 1").select("page_key", F.col("ord").alias("from_id"), (F.col("ord") + 1).alias("to_id"))
    counted = evaluate.link_levels(forms, links, bound)
    return counted.agg(*[F.sum(c).alias(c) for c in ("links", "spatial", "bond", "unreachable")])


@query
def field_presence(spark, d):
    words, bound = _receipts(spark, d)
    value = words.filter("is_key = 0 and line_idx in (0, 2, 4)").select("page_key", F.element_at(F.create_map(F.lit(0), F.lit("company"), F.lit(2), F.lit("date"), F.lit(4), F.lit("total")), F.col("line_idx")).alias("field"), F.col("text").alias("value"))
    got = evaluate.field_presence(words, value, bound)
    return got.groupBy("field").agg(F.count(F.lit(1)).alias("receipts"), F.sum("matched").alias("matched"), F.count_if("reachable").alias("reachable"), F.count_if("present").alias("present"))


@query
def label_purity(spark, d):
    words, bound = _receipts(spark, d)
    return evaluate.label_purity(words.withColumn("label", F.substring_index("category", ".", 1)), bound)


@query
def entity_purity(spark, d):
    words, bound = _receipts(spark, d)
    got = evaluate.entity_purity(words.withColumn("label", F.substring_index("category", ".", 1)), bound)
    return got.agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))


@query
def adjacency(spark, d):
    return diffusion.neighbour_rows(grid_pages(spark, d))


@query
def diffusion_types(spark, d):
    out = sense.unpacked(diffusion.diffused(grid_pages(spark, d)).select("page_key", "ps"))
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def diffusion_far_types(spark, d):
    out = sense.unpacked(diffusion.diffused_far(grid_pages(spark, d)).select("page_key", "ps"))
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def catalogue_stats(spark, d):
    """A whole catalogue run over rendered pages, twelve a document, without its files."""
    words = grid_words(spark, d).withColumns({"doc_id": F.floor(F.col("page_key") / 12), "page": (F.col("page_key") % 12 + 1).cast("int")})
    return catalogue.run(words, "hitachi")["stats"]


@query
def iou(spark, d):
    """Intersection over union of each value's box with its true cell's."""
    w = grid_words(spark, d).filter("col_idx is not null")
    box = F.array("x0", "y0", "x1", "y1")
    cell = F.array(140.0 + 100 * F.col("col_idx"), 89.0 + 30 * F.col("row_idx"), 240.0 + 100 * F.col("col_idx"), 119.0 + 30 * F.col("row_idx"))
    return w.select("page_key", "ord", F.round(expr.iou(box, cell), 6).alias("iou"))
