"""Pages of words with known truth, rendered from relational tables by projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a grid page: heading, column of lineitem, decimals; the unit printed behind it, if any.
GRID = (("Quantity", "l_quantity", 0, None), ("Price", "l_extendedprice", 2, None), ("Discount", "l_discount", 2, "%"), ("Tax", "l_tax", 2, None))
WORD = "struct<ord:int,text:string,x0:double,y0:double,size:double,row_idx:int,col_idx:int>"


def _half_up(value: Column) -> Column:
    """A number of no sign rounded to a whole one, halves upwards, as F.round does it by way of decimal numbers."""
    whole = F.floor(value)
    return whole + (value - whole).between(0.5, 1.0).cast("long")


def fixed(value: Column, decimals: int) -> Column:
    """A number with so many decimals, by whole hundredths, so that every engine prints the same."""
    if not decimals:
        n = _half_up(F.abs(value.cast("double")))
        return F.when(value < 0, -n).otherwise(n).cast("string")
    cents = _half_up(F.abs(value.cast("double") * 100))
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _word(ord_, text, x0, y0, size=10.0, row=None, col=None) -> Column:
    as_col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(as_col(ord_, "int").alias("ord"), as_col(text, "string").alias("text"), as_col(x0, "double").alias("x0"), as_col(y0, "double").alias("y0"), as_col(size, "double").alias("size"), as_col(row, "int").alias("row_idx"), as_col(col, "int").alias("col_idx"))


def _placed(rows: DataFrame) -> DataFrame:
    """page_key and a word -> words, six points a character and twelve (or the larger font) high."""
    return _boxed(rows.select("page_key", "w.*"))


def _boxed(w: DataFrame) -> DataFrame:
    return w.select("page_key", "ord", "text", "x0", "y0", (F.col("x0") + 6 * F.length("text")).alias("x1"), (F.col("y0") + F.greatest(F.lit(12.0), F.col("size"))).alias("y1"), "size", "row_idx", "col_idx")


def grid_words(lineitem: DataFrame) -> DataFrame:
    """A page for each order: a title, headings, and a line of label and values for each of its items, with the true row
    and column of each value. One exchange, by order.

    A row's words are told apart by their number alone, and looked up in short lists: an expression for each word and field
    makes methods that the JVM never compiles."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = lineitem.select(F.col("l_orderkey").alias("page_key"), nth.alias("r"), *[c for _, c, _, _ in GRID])
    head = [(F.concat(F.lit("Order "), F.col("page_key").cast("string")), 30.0, None)] + [(F.lit(name), 150.0 + 100 * k, None) for k, (name, _, _, _) in enumerate(GRID)]
    own = [(F.concat(F.lit("Line "), F.col("r").cast("string")), 30.0, None)]
    for k, (_, column, decimals, unit) in enumerate(GRID):
        own.append((fixed(F.col(column), decimals), 150.0 + 100 * k, k))
        if unit:
            own.append((F.lit(unit), 190.0 + 100 * k, None))
    words = head + own
    first = F.when(F.col("r") == 1, 0).otherwise(len(head))
    texts = F.slice(F.array(*[t for t, _, _ in words]), first + 1, len(words))
    found = rows.select("page_key", "r", F.posexplode(texts).alias("k", "text")).withColumn("k", F.col("k") + first)
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("k"))
    line, titled = F.col("r") - 1, F.col("k") < len(head)
    y0 = F.when(F.col("k") == 0, 10.0).when(titled, 44.0).otherwise(94.0 + 30 * line)
    return _boxed(found.select("page_key", (F.col("k") + F.when(titled, 0).otherwise(len(own) * line)).cast("int").alias("ord"), "text", at([x for _, x, _ in words], "double").alias("x0"), y0.alias("y0"), F.when(F.col("k") == 0, 16.0).otherwise(10.0).alias("size"), F.when(~titled, line).cast("int").alias("row_idx"), at([c for _, _, c in words], "int").alias("col_idx")))


def grid_truth(words: DataFrame) -> DataFrame:
    """The true grid of grid pages: page_key, rows (ymin, ymax), columns (xmin, xmax)."""
    sizes = words.groupBy("page_key").agg((F.max("row_idx") + 1).alias("n_rows"))
    rows = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda i: F.struct((89.0 + 30 * i).alias("ymin"), (119.0 + 30 * i).alias("ymax")))
    cols = F.array(*[F.struct(F.lit(140.0 + 100 * k).alias("xmin"), F.lit(240.0 + 100 * k).alias("xmax")) for k in range(len(GRID))])
    return sizes.select("page_key", rows.alias("rows"), cols.alias("columns"))


def text_words(documents: DataFrame) -> DataFrame:
    """A page for each document: its lines one below the other, each word where its characters stand."""
    lines = documents.select(F.col("doc_id").alias("page_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "s"))
    found = F.regexp_extract_all("s", F.lit(r"[^ \t-\r]+"), F.lit(0))
    lead = F.length("s") - F.length(F.regexp_replace("s", r"^[ \t-\r]+", ""))
    words = lines.select("page_key", "line", lead.alias("lead"), found.alias("ws")).select("page_key", "line", "lead", F.posexplode("ws").alias("k", "text"), "ws")
    before = F.aggregate(F.slice("ws", 1, F.col("k")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    w = _word(F.col("line") * 10000 + F.col("k"), F.col("text"), 6.0 * (F.col("lead") + before), 14.0 * F.col("line"), row=F.col("line"))
    return _placed(words.select("page_key", w.alias("w")))


def receipt_words(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """A receipt for each order: customer, date, status and total, each a line of key and value.
    Truth: line_idx, is_key and category."""
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = [
        ("menu.nm", "Customer", F.col("c_name")),
        ("menu.price", "Balance", fixed(F.col("c_acctbal"), 2)),
        ("date", "Date", F.date_format("o_orderdate", "yyyy-MM-dd")),
        ("sub_total.count", "Status", F.col("o_orderstatus")),
        ("total.total_price", "TOTAL", fixed(F.col("o_totalprice"), 2)),
    ]
    words = []
    for k, (category, key, value) in enumerate(lines):
        for is_key, text, x0 in ((1, F.lit(key), 40.0), (0, value, 200.0)):
            words.append(F.struct(F.lit(2 * k + 1 - is_key).alias("ord"), text.alias("text"), F.lit(x0).alias("x0"), F.lit(50.0 + 20 * k).alias("y0"), F.lit(k).alias("line_idx"), F.lit(is_key).alias("is_key"), F.lit(category).alias("category")))
    w = both.select(F.col("o_orderkey").alias("page_key"), F.explode(F.array(*words)).alias("w")).select("page_key", "w.*")
    return w.select("page_key", "ord", "text", "x0", "y0", (F.col("x0") + 6 * F.length("text")).alias("x1"), (F.col("y0") + 12).alias("y1"), F.lit(12.0).alias("size"), "line_idx", "is_key", "category")


def model_codes(part: DataFrame) -> DataFrame:
    """A model code for each part, of five brands and none in turn."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    two = F.lpad(size, 2, "0")
    code = F.when(k == 0, F.concat(F.lit("RAS-"), size, F.lit("FSXNME"))).when(k == 1, F.concat(F.lit("ftxm"), two, F.lit("R"))).when(k == 2, F.concat(F.lit("RAV-GM"), two, F.lit("1KRTP-E")))
    code = code.when(k == 3, F.concat(F.lit("MSZ-AP"), two, F.lit("VGK"))).when(k == 4, F.concat(F.lit("MHA-V"), size, F.lit("W"))).otherwise(F.col("p_name"))
    return part.select("p_partkey", code.alias("code"))
