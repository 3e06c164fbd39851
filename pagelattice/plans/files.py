"""Registered queries over files: every reader on contents made from whole driver tables, every sink written and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typing
from ..operators import assemble, evaluate, field, grid, sense
from ..sources import adapters, rendered, sinks, written
from .catalog import _table, grid_bound, grid_particles, grid_truth, grid_words, truth_pages

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_WORD = ("page_key", "ord", "text", "x0", "y0", "x1", "y1", "size")


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    return rendered.receipt_words(_table(spark, d, "orders"), _table(spark, d, "customer"))


@query
def src_word_lists(spark, d):
    return adapters.word_lists(written.word_lists(grid_words(spark, d))).select(*_WORD)


@query
def src_plain_words(spark, d):
    return adapters.plain_words(written.word_lists(grid_words(spark, d)))


@query
def src_base_words(spark, d):
    return adapters.plain_words(written.word_lists(grid_words(spark, d)), typed=True)


@query
def src_truth_xml(spark, d):
    t = adapters.truth(written.truth_xml(grid_truth(spark, d)))
    kinds = {"table": F.array("table_box"), "header": F.array("header_box"), "row": F.col("rows"), "column": F.col("columns"), "span": F.col("spans")}

    def named(kind: str):
        return lambda b, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), *[b[x].alias(x) for x in ("xmin", "ymin", "xmax", "ymax")])

    boxes = F.flatten(F.array(*[F.transform(c, named(k)) for k, c in kinds.items()]))
    return t.select("page_key", "width", "height", F.explode(boxes).alias("b")).select("page_key", "width", "height", "b.*")


@query
def src_receipts(spark, d):
    return adapters.receipts(written.receipts(_receipts(spark, d))).select(*_WORD, "line_idx", "is_key", "category", "group_id")


@query
def src_receipt_truth(spark, d):
    return adapters.receipt_truth(adapters.receipts(written.receipts(_receipts(spark, d))))


@query
def src_forms(spark, d):
    return adapters.forms(written.forms(_receipts(spark, d))).select(*_WORD, "entity_id", "label")


@query
def src_form_links(spark, d):
    return adapters.form_links(written.forms(_receipts(spark, d))).select("page_key", "from_id", "to_id", "from_label", "to_label", "from_text", "to_text")


@query
def src_box_lines(spark, d):
    return adapters.box_lines(written.box_lines(_receipts(spark, d))).select(*_WORD)


@query
def src_box_particles(spark, d):
    return typing.particles(adapters.box_lines(written.box_lines(_receipts(spark, d)))).select("page_key", "ord", "text", "x", "y", "type")


@query
def src_labelled_lines(spark, d):
    return adapters.labelled_lines(written.labelled_lines(grid_words(spark, d))).select(*_WORD, "label")


@query
def src_labelled_particles(spark, d):
    p = typing.particles(adapters.labelled_lines(written.labelled_lines(grid_words(spark, d))))
    return p.groupBy("label", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def src_pairs(spark, d):
    """Words of every second order, truth of every third: what has both, clipped to its table's box."""
    words, truth = adapters.pairs(grid_particles(spark, d).filter("page_key % 2 = 0"), adapters.truth(written.truth_xml(grid_truth(spark, d).filter("page_key % 3 = 0"))))
    return adapters.clipped(words, truth).groupBy("page_key").agg(F.count(F.lit(1)).alias("words"))


@query
def src_files(spark, d):
    """A file for each nation's customers, found by name and read line by line."""
    to = written.folder(spark, "customers")
    lines = _table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.concat_ws(",", F.lit("0,0,60,0,60,12,0,12"), "c_name").alias("value"))
    lines.repartition("nation").write.partitionBy("nation").text(to)
    found = adapters.discovered(spark, f"{to}/nation=*/*.txt")
    whole = spark.read.text(found, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"/nation=(\d+)/", 1).cast("int").alias("page_key"), F.col("value").alias("content"))
    rows = whole.select("page_key", F.posexplode(F.split("content", r"\r?\n")).alias("ord", "value"))
    return adapters.box_lines(rows).groupBy("page_key").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first"), F.max("text").alias("last"))


@query
def src_batches(spark, d):
    """A file for each type of parts below its brand's folder, and below one of no known brand."""
    to = written.folder(spark, "batches")
    brand = typing.brand_of(F.col("code"))
    codes = rendered.model_codes(_table(spark, d, "part")).join(_table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    files = codes.select(F.coalesce(brand, F.lit("nobody")).alias("brand"), F.regexp_replace(F.split("p_type", " ")[0], r"\W", "").alias("name")).distinct()

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            for b, n in zip(pdf["brand"], pdf["name"], strict=True):
                where, path = fs.FileSystem.from_uri(f"{to}/brands/{b}/input")
                where.create_dir(path, recursive=True)
                with where.open_output_stream(f"{path}/{n}.pdf") as f:
                    f.write(b"%PDF-1.4\n")
            yield pd.DataFrame({"n": [len(pdf)]})

    files.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return adapters.batches(spark, to).select("brand", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("name"))


@query
def sink_graph(spark, d):
    to = written.folder(spark, "graph")
    sinks.write_graph(assemble.graph_nodes(field.fact_rows(grid_bound(spark, d)), "hitachi", "orders"), to)
    return spark.read.json(to).filter("catalog = 'orders'").select("id", "type", "name", "page_key")


@query
def sink_rows(spark, d):
    to = written.folder(spark, "rows")
    sinks.write_rows(assemble.sql_rows(assemble.graph_nodes(field.fact_rows(grid_bound(spark, d)), "hitachi", "orders")), to)
    return spark.read.schema("model string, header string, value string, unit string, page long, section string").json(to)


@query
def sink_metrics(spark, d):
    """Scores of each page as JSON, read back."""
    to = written.folder(spark, "metrics")
    sinks.write_rows(evaluate.structure(truth_pages(spark, d)), to)
    return spark.read.json(to).select("page_key", *[F.col(c).cast("int").alias(c) for c in ("gt_rows", "pred_rows", "pred_cols")], F.round("top", 6).alias("top"), "col_exact", "row_exact")


@query
def sink_markdown(spark, d):
    """Each supplier's lines as chunks: pages are orders, sections the days of shipping."""
    to = written.folder(spark, "text")
    nth = F.row_number().over(sinks.Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"))
    chunks = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"), nth.alias("chunk"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("section"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))
    sinks.write_markdown(chunks, to)
    return spark.read.text(to, wholetext=True).select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace("value", r"\n$", "").alias("text"))


@query
def brand_patterns(spark, d):
    """A part's code by each brand's own patterns: as a model and as a size."""
    codes = rendered.model_codes(_table(spark, d, "part"))
    brands = F.explode(F.array(*[F.struct(F.lit(b).alias("brand"), typing.matches(F.col("code"), typing.patterns_of(b), "model").alias("model"), typing.matches(F.col("code"), typing.patterns_of(b), "size").alias("size")) for b in ("hitachi", "daikin", "toshiba", "mitsubishi", "midea")]))
    return codes.select("p_partkey", brands.alias("b")).select("p_partkey", "b.*")


@query
def fragments(spark, d):
    """Model codes torn into pieces of three letters, put together again, beside a word that is too far away."""
    code = rendered.model_codes(_table(spark, d, "part"))
    n = F.ceil(F.length("code") / 3).cast("int")
    pieces = code.select("p_partkey", "code", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("ord", "k")).select(F.col("p_partkey").alias("page_key"), "ord", F.substring("code", F.col("k") * 3 + 1, F.lit(3)).alias("text"), (40.0 + 20 * F.col("k")).alias("x0"))
    far = code.select(F.col("p_partkey").alias("page_key"), F.lit(99).alias("ord"), F.lit("kW").alias("text"), F.lit(500.0).alias("x0"))
    words = pieces.unionByName(far).select("page_key", "ord", "text", "x0", F.lit(50.0).alias("y0"), (F.col("x0") + 18).alias("x1"), F.lit(62.0).alias("y1"), F.lit(10.0).alias("size"))
    merged = adapters.fragments_merged(typing.particles(words.filter("trim(text) <> ''"), typing.patterns_of("hitachi"), True), typing.patterns_of("hitachi"))
    return merged.filter("ord <> 99 and type <> 'TEXT'").select("page_key", "ord", "text", "type", "x0", "x1")


@query
def page_particles(spark, d):
    """Words of a page all the way to sensed particles, with a brand's patterns: counts of types by page."""
    typed = typing.particles(grid_words(spark, d), typing.patterns_of("hitachi"), True)
    out = sense.unpacked(sense.sensed(sense.pages(adapters.fragments_merged(typed, typing.patterns_of("hitachi")))))
    return out.groupBy("page_key").agg(F.count_if(F.col("type") == "NUMERIC").alias("numeric"), F.count(F.lit(1)).alias("n"))


@query
def size_averages(spark, d):
    """Accuracies over all pages, each page weighing as much as it has bonds."""
    return evaluate.weighted(evaluate.bond_accuracy(grid_bound(spark, d), grid_truth(spark, d))).withColumns({c: F.round(c, 6) for c in ("col_acc", "row_acc", "cell_acc")})


@query
def word_pairs(spark, d):
    """Neighbours in lines: whether the truth and the lines' natural thresholds part them, pairs in short lines too."""
    return evaluate.word_pairs(truth_pages(spark, d))


@query
def sparse_columns(spark, d):
    """How tables' predicted columns are off: direction and size, with the worst tables' scores."""
    return evaluate.column_errors(evaluate.structure(truth_pages(spark, d)))


@query
def score_histogram(spark, d):
    """Grid scores by tenths."""
    return evaluate.histogram(evaluate.structure(truth_pages(spark, d)), "top")


@query
def worst_tables(spark, d):
    """The twenty tables of the lowest score."""
    return evaluate.structure(truth_pages(spark, d)).select("page_key", "gt_rows", "gt_cols", "pred_rows", "pred_cols", F.round("top", 6).alias("top")).orderBy("top", "page_key").limit(20)


@query
def fixed_against_jump(spark, d):
    """Numbers of columns by the fixed ratio and by the largest jump, held against the truth."""
    return evaluate.fixed_against_jump(truth_pages(spark, d))
