"""Files of the known shapes, made from tables: what the readers are tried on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors see; without that setting, a local session has its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="pagelattice-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _listed(rows: DataFrame, by: Column, *order: str) -> Column:
    """The rows' structs as a list, in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, by.alias("v")))), lambda s: s["v"])


def word_lists(words: DataFrame) -> DataFrame:
    """page_key, content: a page's words as [{text, bbox}], a blank one last."""
    w = F.struct("text", F.array("x0", "y0", "x1", "y1").alias("bbox"))
    blank = F.struct(F.lit("  ").alias("text"), F.array(*[F.lit(float(k)) for k in range(4)]).alias("bbox"))
    return words.groupBy("page_key").agg(F.to_json(F.concat(_listed(words, w, "ord"), F.array(blank))).alias("content"))


def truth_xml(truth: DataFrame) -> DataFrame:
    """page_key, content: rows and columns of truth as XML, the last ones first, two table boxes of which the last counts."""
    box = lambda name, *at: F.concat(F.lit(f"<object><name>{name}</name><bndbox><xmin>"), at[0], F.lit("</xmin><ymin>"), at[1], F.lit("</ymin><xmax>"), at[2], F.lit("</xmax><ymax>"), at[3], F.lit("</ymax></bndbox></object>"))
    said = lambda *at: [(a if isinstance(a, Column) else F.lit(a)).cast("string") for a in at]
    rows = F.reverse(F.transform("rows", lambda r: box("table row", *said(30.0, r["ymin"], 540.0, r["ymax"]))))
    cols = F.reverse(F.transform("columns", lambda c: box("table column", *said(c["xmin"], 44.0, c["xmax"], 500.0))))
    last = F.element_at("rows", -1)["ymax"]
    head = F.array(box("table", *said(1.0, 2.0, 3.0, 4.0)), box("table column header", *said(30.0, 44.0, 540.0, 56.0)), box("table spanning cell", *said(140.0, 89.0, 340.0, 119.0)))
    every = F.concat(head, rows, cols, F.array(box("table", *said(30.0, 44.0, 540.0, last))))
    return truth.select("page_key", F.concat(F.lit("<annotation><size><width>600</width><height>800</height></size>"), F.array_join(every, ""), F.lit("</annotation>")).alias("content"))


def _quad() -> Column:
    at = {"x1": "x0", "y1": "y0", "x2": "x1", "y2": "y0", "x3": "x1", "y3": "y1", "x4": "x0", "y4": "y1"}
    return F.struct(*[F.col(c).alias(k) for k, c in at.items()])


def receipts(words: DataFrame) -> DataFrame:
    """page_key, content: receipts' words (line_idx, is_key, category) as lines of words with corners."""
    word = F.struct("text", "is_key", _quad().alias("quad"))
    lines = words.groupBy("page_key", "line_idx", "category").agg(_listed(words, word, "ord").alias("words"))
    line = F.struct("category", F.col("line_idx").alias("group_id"), "words")
    return lines.groupBy("page_key").agg(F.to_json(F.struct(_listed(lines, line, "line_idx").alias("valid_line"))).alias("content"))


def forms(words: DataFrame) -> DataFrame:
    """page_key, content: receipts' words as entities of a form: keys are questions that link to their answers, each link
    twice, and each entity to one that isn't there; an answer has a word without extent too."""
    box = F.array("x0", "y0", "x1", "y1")
    word = F.struct("text", box.alias("box"))
    flat = F.struct(F.lit("flat").alias("text"), F.array("x0", "y0", "x0", "y1").alias("box"))
    other = F.when(F.col("is_key") == 1, F.col("ord") + 1).otherwise(F.col("ord") - 1)
    pair = F.when(F.col("is_key") == 1, F.array("ord", other)).otherwise(F.array(other, "ord"))
    entity = F.struct(
        F.col("ord").alias("id"), F.when(F.col("is_key") == 1, "question").otherwise("answer").alias("label"), "text",
        F.array(pair, F.reverse(pair), F.array(F.col("ord"), F.lit(99))).alias("linking"), F.when(F.col("is_key") == 1, F.array(word)).otherwise(F.array(word, flat)).alias("words"),
    )
    return words.groupBy("page_key").agg(F.to_json(F.struct(_listed(words, entity, "ord").alias("form"))).alias("content"))


def box_lines(words: DataFrame) -> DataFrame:
    """page_key, ord, value: a word's corners and text between commas; the text of a key has a comma itself, and each page
    has a line that isn't one."""
    at = [F.col(c).cast("int").cast("string") for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")]
    text = F.when(F.col("is_key") == 1, F.concat(F.col("text"), F.lit(", it says"))).otherwise(F.col("text"))
    rows = words.select("page_key", "ord", F.concat_ws(",", *at, text).alias("value"))
    return rows.unionByName(words.filter("ord = 0").select("page_key", F.lit(99).alias("ord"), F.lit("1,2,x,4,5,6,7,8,not a line").alias("value")))


def labelled_lines(words: DataFrame) -> DataFrame:
    """page_key, ord, value: ten fields between tabs; each page has a short line too."""
    at = [F.col(c).cast("int").cast("string") for c in ("x0", "y0", "x1", "y1")]
    label = F.when(F.col("col_idx").isNotNull(), "table").otherwise("paragraph")
    rows = words.select("page_key", "ord", F.concat_ws("\t", F.col("text"), *at, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("Times"), label).alias("value"))
    return rows.unionByName(words.filter("ord = 0").select("page_key", F.lit(9999).alias("ord"), F.lit("too\tshort").alias("value")))
