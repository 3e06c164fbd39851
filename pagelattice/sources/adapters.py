"""Words and truth from files of known shapes: word lists, layout truth, receipts, forms, labelled pages, PDFs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let, staged, stripped

WORDS_JSON = "array<struct<text:string,bbox:array<double>>>"
RECEIPT_JSON = "struct<valid_line:array<struct<category:string,group_id:int,words:array<struct<text:string,is_key:int,quad:struct<x1:double,y1:double,x2:double,y2:double,x3:double,y3:double,x4:double,y4:double>>>>>>"
FORM_JSON = "struct<form:array<struct<id:int,label:string,text:string,linking:array<array<int>>,words:array<struct<text:string,box:array<double>>>>>>"
TRUTH_XML = "size struct<width:double,height:double>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
_STEM = r"([^/]+?)(?:_words)?\.[A-Za-z]+$"


def stem(path: Column) -> Column:
    """A file's name without folder, ending and the mark of word lists: what files of one page share."""
    return F.regexp_extract(path, _STEM, 1)


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """page_key and content of each file."""
    return spark.read.text(pattern, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("page_key"), F.col("value").alias("content"))


def _size(kept: DataFrame) -> DataFrame:
    return kept.filter(stripped(F.col("text")) != "")


def word_lists(raw: DataFrame) -> DataFrame:
    """[{text, bbox}] -> words; blank ones are left out, the font counts as 10."""
    w = raw.select("page_key", F.posexplode(F.from_json("content", WORDS_JSON)).alias("ord", "w"))
    box = lambda k: F.get(F.col("w.bbox"), k)
    return _size(w.select("page_key", "ord", F.col("w.text").alias("text"), box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"), F.lit(10.0).alias("size")))


def plain_words(raw: DataFrame, typed: bool = False) -> DataFrame:
    """[{text, bbox}] -> particles with their width and height. Without types all are UNKNOWN and even blank words stay, in a
    font of 10; with the base types blank ones are left out, texts end after 80 characters and no font is known."""
    from ..functions.typing import base_type_of

    w = raw.select("page_key", F.posexplode(F.from_json("content", WORDS_JSON)).alias("ord", "w"))
    x0, y0, x1, y1 = (F.get(F.col("w.bbox"), k) for k in range(4))
    places = [((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")]
    if not typed:
        return w.select("page_key", "ord", F.col("w.text").alias("text"), *places, (x1 - x0).alias("w"), (y1 - y0).alias("h"), F.lit(10.0).alias("size"), F.lit("UNKNOWN").alias("type"))
    text = stripped(F.col("w.text"))
    return w.filter(text != "").select("page_key", "ord", F.substring(text, 1, 80).alias("text"), *places, F.lit(0.0).alias("size"), base_type_of(F.col("w.text")).alias("type"))


def truth(raw: DataFrame) -> DataFrame:
    """Layout truth in XML -> page_key, table_box, header_box, rows by their top, columns by their left edge, spans."""
    doc = raw.select("page_key", F.from_xml("content", F.lit(f"struct<{TRUTH_XML.replace('size struct', 'size:struct').replace(', object array', ',object:array')}>")).alias("d"))
    objects = F.col("d.object")
    named = lambda name: F.transform(F.filter(objects, lambda o: o["name"] == name), lambda o: o["bndbox"])
    by = lambda boxes, key: F.transform(F.sort_array(F.transform(boxes, lambda b, i: F.struct(b[key].alias("k"), i.alias("i"), b.alias("b")))), lambda s: s["b"])
    last = lambda name: F.element_at(F.concat(F.array(F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>")), named(name)), -1)
    return doc.select("page_key", F.col("d.size.width").alias("width"), F.col("d.size.height").alias("height"), last("table").alias("table_box"), last("table column header").alias("header_box"), by(named("table row"), "ymin").alias("rows"), by(named("table column"), "xmin").alias("columns"), named("table spanning cell").alias("spans"))


def clipped(words: DataFrame, tables: DataFrame, margin: float = 2.0) -> DataFrame:
    """Particles inside their table's box; a page without a box keeps all."""
    b = tables.select("page_key", "table_box")
    inside = (F.col("y0") >= F.col("table_box.ymin") - margin) & (F.col("y1") <= F.col("table_box.ymax") + margin) & (F.col("x") >= F.col("table_box.xmin") - margin) & (F.col("x1") <= F.col("table_box.xmax") + margin)
    return words.join(b, "page_key").filter(F.col("table_box").isNull() | inside).drop("table_box")


def receipts(raw: DataFrame) -> DataFrame:
    """Receipts' words with their line, whether they are keys, category and group; boxes from their corners."""
    line = raw.select("page_key", F.posexplode(F.from_json("content", RECEIPT_JSON)["valid_line"]).alias("line_idx", "l"))
    w = line.select("page_key", "line_idx", F.col("l.category").alias("category"), F.coalesce("l.group_id", F.lit(-1)).alias("group_id"), F.posexplode("l.words").alias("k", "w"))
    q = lambda c: F.col(f"w.quad.{c}")
    out = w.select("page_key", (F.col("line_idx") * 10000 + F.col("k")).alias("ord"), F.col("w.text").alias("text"), F.least(q("x1"), q("x4")).alias("x0"), F.least(q("y1"), q("y2")).alias("y0"), F.greatest(q("x2"), q("x3")).alias("x1"), F.greatest(q("y3"), q("y4")).alias("y1"), "line_idx", F.coalesce("w.is_key", F.lit(0)).alias("is_key"), "category", "group_id")
    return _size(out.withColumn("size", F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))))


def receipt_truth(words: DataFrame) -> DataFrame:
    """Receipts' words -> what each line says: the words of its key and those of its value, if it has any of a value."""
    said = lambda is_key: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("is_key") == 1) == is_key, F.struct("ord", "text")))), lambda w: w["text"]), " ")
    lines = words.groupBy("page_key", "line_idx").agg(F.first("category").alias("category"), F.first("group_id").alias("group_id"), said(True).alias("key"), said(False).alias("value"), F.count_if(F.col("is_key") != 1).alias("n"))
    return lines.filter("n > 0").drop("n")


def forms(raw: DataFrame) -> DataFrame:
    """Forms' words with their entity and its label; words without extent are left out."""
    e = raw.select("page_key", F.posexplode(F.from_json("content", FORM_JSON)["form"]).alias("e_no", "e"))
    w = e.select("page_key", "e_no", F.col("e.id").alias("entity_id"), F.coalesce("e.label", F.lit("other")).alias("label"), F.posexplode("e.words").alias("k", "w"))
    box = lambda k: F.get(F.col("w.box"), k)
    out = w.select("page_key", (F.col("e_no") * 10000 + F.col("k")).alias("ord"), F.col("w.text").alias("text"), box(0).alias("x0"), box(1).alias("y0"), box(2).alias("x1"), box(3).alias("y1"), "entity_id", "label")
    return _size(out.withColumn("size", F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")))).filter("x1 > x0 and y1 > y0")


def form_links(raw: DataFrame) -> DataFrame:
    """Links between a form's entities: each pair once, as it first stands, if both its ends exist."""
    e = raw.select("page_key", F.posexplode(F.from_json("content", FORM_JSON)["form"]).alias("e_no", "e"))
    pairs = e.select("page_key", "e_no", F.posexplode("e.linking").alias("k", "l")).select("page_key", "e_no", "k", F.get("l", 0).alias("from_id"), F.get("l", 1).alias("to_id"))
    one = pairs.groupBy("page_key", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.min(F.struct("e_no", "k", "from_id", "to_id")).alias("l"))
    one = one.select("page_key", "l.from_id", "l.to_id")
    ends = e.select("page_key", F.col("e.id").alias("id"), F.coalesce("e.label", F.lit("other")).alias("label"), F.coalesce("e.text", F.lit("")).alias("text")).dropDuplicates(["page_key", "id"])
    named = lambda side: ends.select("page_key", F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("text").alias(f"{side}_text"))
    return one.join(named("from"), ["page_key", "from_id"]).join(named("to"), ["page_key", "to_id"])


def box_lines(lines: DataFrame) -> DataFrame:
    """Lines 'x1,y1,...,x4,y4,text' (page_key, ord, value) -> words; the text keeps its commas; what isn't whole numbers
    or has no extent is left out."""
    parts = F.split(stripped(F.col("value")), ",", 9)
    xs, ys = ([F.get(F.col("c"), 2 * k + o) for k in range(4)] for o in (0, 1))
    rows = lines.select("page_key", "ord", F.transform(F.slice(parts, 1, 8), lambda p: F.trim(p).try_cast("int")).alias("c"), F.get(parts, 8).alias("text")).filter(F.size("c") == 8).filter(~F.exists("c", lambda v: v.isNull()))
    out = rows.select("page_key", "ord", stripped(F.coalesce("text", F.lit(""))).alias("text"), *[f(*v).cast("double").alias(n) for f, v, n in ((F.least, xs, "x0"), (F.least, ys, "y0"), (F.greatest, xs, "x1"), (F.greatest, ys, "y1"))])
    return _size(out.withColumn("size", F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")))).filter("x1 > x0 and y1 > y0")


def labelled_lines(lines: DataFrame) -> DataFrame:
    """Lines of ten fields between tabs (word, box, colour, font, label) -> words with their label."""
    rows = staged(lines.select("page_key", "ord", "value"), f=F.split("value", "\t")).filter(F.size("f") >= 10)
    out = rows.select("page_key", "ord", F.get("f", 0).alias("text"), *[F.get("f", k).try_cast("int").cast("double").alias(n) for k, n in ((1, "x0"), (2, "y0"), (3, "x1"), (4, "y1"))], stripped(F.get("f", 9)).alias("label"))
    return _size(out.withColumn("size", F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")))).filter("x1 > x0 and y1 > y0")


def file_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """page_key, ord and value of each line of text files; ord follows the lines of a file."""
    whole = files(spark, pattern)
    return whole.select("page_key", F.posexplode(F.split("content", r"\r?\n")).alias("ord", "value")).filter("value <> ''")


def pairs(words: DataFrame, tables: DataFrame, limit: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Words and truth of the pages that have both; with a limit, those first by a seeded hash."""
    keys = words.select("page_key").distinct().join(tables.select("page_key").distinct(), "page_key")
    if limit:
        keys = keys.orderBy(F.xxhash64("page_key", F.lit(seed)), "page_key").limit(limit)
    return words.join(keys, "page_key", "left_semi"), tables.join(keys, "page_key", "left_semi")


def discovered(spark: SparkSession, pattern: str, n: int = 0) -> list[str]:
    """The files of a pattern in order of their names, the first n if n isn't 0; none at all is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(s.getPath()) for s in found or ())
    if not names:
        raise FileNotFoundError(pattern)
    return names[:n] if n else names


def batches(spark: SparkSession, root: str, brands: tuple[str, ...] | None = None) -> DataFrame:
    """brand, path of the files brands/<brand>/input/*.pdf below a folder, of known brands alone. No file is read."""
    from ..functions.vocabulary import BRANDS

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(f"{root}/brands").select("path")
    brand = F.regexp_extract("path", r"/brands/([^/]+)/input/[^/]+$", 1)
    return listed.select(brand.alias("brand"), "path").filter(F.col("brand").isin(*(brands or BRANDS)))


def pdf_words(spark: SparkSession, pattern: str) -> DataFrame:
    """Spans of PDF files as words, a task for each few files; needs PyMuPDF on the executors. A file that can't be read
    gives one row with its error, so that a batch goes on."""
    schema = "page_key string, doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, size double, error string"

    def decode(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    import fitz

                    with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                        for number, page in enumerate(doc, 1):
                            spans = [s for b in page.get_text("dict")["blocks"] if b.get("type") == 0 for line in b["lines"] for s in line["spans"]]
                            for k, s in enumerate(x for x in spans if x["text"].strip()):
                                rows.append((f"{path}#{number}", path, number, k, s["text"], *map(float, s["bbox"]), float(s["size"]), None))
                except Exception as e:  # a report of each file is what a batch gives
                    rows = [(path, path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(decode, schema)


def fragments_merged(words: DataFrame, patterns: dict | None = None, near_y: float = 2.0, near_x: float = 8.0) -> DataFrame:
    """Words torn into pieces of up to four characters put together again, line by line, where the whole has a type.

    A line begins at the first word more than near_y below the beginning of the last one. Particles in and out."""
    from ..functions.typing import type_of
    from ..operators.sense import PARTICLE, pages

    rows = pages(words)
    start = F.array().cast("array<struct<y:double,g:int>>")
    placed = F.array_sort(F.transform("ps", lambda p: F.struct(p["y0"].alias("y0"), p["x0"].alias("x0"), p["ord"].alias("ord"), p.alias("p"))))

    def lines(s: Column) -> Column:
        step = lambda acc, v: F.when((F.size(acc) > 0) & (F.abs(v["y0"] - F.element_at(acc, -1)["y"]) <= near_y), F.concat(acc, F.array(F.element_at(acc, -1)))).otherwise(F.concat(acc, F.array(F.struct(v["y0"].alias("y"), F.size(acc).alias("g")))))
        safe = lambda acc, v: F.when(F.size(acc) == 0, F.array(F.struct(v["y0"].alias("y"), F.lit(0).alias("g")))).otherwise(step(acc, v))
        return let(F.aggregate(s, start, safe), lambda g: F.transform(s, lambda v, i: F.struct(F.get(g, i)["g"].alias("g"), v["p"].alias("p"))))

    flat = rows.select("page_key", F.explode(let(placed, lines)).alias("v")).select("page_key", "v.g", "v.p.*")
    from pyspark.sql import Window

    order = Window.partitionBy("page_key", "g").orderBy("x0", "ord")
    short = F.length("text") <= 4
    glued = short & (F.length(F.lag("text").over(order)) <= 4) & (F.col("x0") - F.lag("x1").over(order) < near_x)
    runs = flat.withColumn("breaks", (~F.coalesce(glued, F.lit(False))).cast("int")).withColumn("run", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    packed = runs.groupBy("page_key", "g", "run").agg(F.sort_array(F.collect_list(F.struct("x0", "ord", F.struct(*PARTICLE).alias("p")))).alias("r"))
    text = F.array_join(F.transform("r", lambda v: v["p"]["text"]), "")
    packed = packed.withColumn("type", F.when(F.size("r") > 1, type_of(text, patterns, domain=True)).otherwise("TEXT"))
    first, last = F.get("r", 0)["p"], F.element_at("r", -1)["p"]
    y1 = F.array_max(F.transform("r", lambda v: v["p"]["y1"]))
    whole = F.struct(first["ord"].alias("ord"), F.substring(text, 1, 80).alias("text"), ((first["x0"] + last["x1"]) / 2).alias("x"), ((first["y0"] + y1) / 2).alias("y"), first["x0"].alias("x0"), first["y0"].alias("y0"), last["x1"].alias("x1"), y1.alias("y1"), first["size"].alias("size"), F.col("type").alias("type"))
    out = packed.withColumn("out", F.when(F.col("type") != "TEXT", F.array(whole)).otherwise(F.transform("r", lambda v: v["p"])))
    return out.select("page_key", F.posexplode("out").alias("k", "p"), "g", "run").select("page_key", "p.*").select("page_key", *PARTICLE)
