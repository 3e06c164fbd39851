"""Small tables for tests."""

from pyspark.sql import functions as F

WORDS = "page_key long, ord int, text string, x0 double, y0 double, x1 double, y1 double, size double"


def words(spark, rows, page=1):
    """rows: text, centre x, centre y[, size] -> words twelve high and six a character wide."""
    out = []
    for k, (text, x, y, *size) in enumerate(rows):
        w = max(len(text), 1) * 3.0
        out.append((page, k, text, x - w, y - 6.0, x + w, y + 6.0, float(size[0]) if size else 10.0))
    return spark.createDataFrame(out, WORDS)


TABLE = [("Model-A", 150, 50), ("Model-B", 250, 50), ("COP", 50, 100), ("4.50", 150, 100), ("3.80", 250, 100), ("Peso", 50, 130), ("25", 150, 130), ("30", 250, 130), ("Potenza", 50, 160), ("10.5", 150, 160), ("12.0", 250, 160)]


def one(spark, value):
    """The value of a column expression over one row."""
    return spark.range(1).select(value.alias("v")).first()["v"]


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def boxes(spark, places, page=1, kind="TEXT"):
    """places: x0, y0, x1, y1 -> particles."""
    rows = [(page, k, f"w{k}", (a + c) / 2, (b + d) / 2, a, b, c, d, 10.0, kind) for k, (a, b, c, d) in enumerate([tuple(map(float, p)) for p in places])]
    return spark.createDataFrame(rows, "page_key long, ord int, text string, x double, y double, x0 double, y0 double, x1 double, y1 double, size double, type string")
