"""Queries stay in methods that the JVM compiles: above 8000 bytes of bytecode it interprets them for ever."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import one
from pagelattice.functions import expr, typing
from pagelattice.plans import catalog
from pagelattice.sources.rendered import fixed


def largest_method(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = df._jdf.queryExecution().explainString(mode)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["page_words", "src_labelled_lines"])
def test_methods_are_small(spark, small, plain_plans, name):
    assert largest_method(catalog.queries()[name](spark, small)) < 8000


def test_short_ways_give_what_the_long_ones_gave(spark):
    texts = ["", " ", "12", "12.", "1,5", "1.5.", "12\n", " kW ", "kW", "kw .", "Kg..", "x", "xx", "R410A", "R", "RPK-1", "Line 1", "pag. 3", "1.2.3", "(12)", "..x..x..", "-3~", "12B", "٣", "m²", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    long_way = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    assert df.filter(~expr.stripped(F.col("t")).eqNullSafe(long_way(F.col("t")))).count() == 0
    kinds = {r.t: r.v for r in df.select("t", typing.type_of(F.col("t"), domain=False).alias("v")).collect()}
    assert {t for t, v in kinds.items() if v == "NUMERIC"} == {"12", "12.", "1,5", "1.5.", "12\n", "1.2.3", "..x..x..", "-3~", "R410A", "٣"}
    assert {t for t, v in kinds.items() if v == "UNIT"} == {" kW ", "kW", "kw .", "Kg.."}


def test_halves_go_up(spark):
    by_decimals = lambda v: F.abs(F.round(v * 100)).cast("long")
    for v in (0.07, 1.005, 0.125, 0.295, 25455.12, 0.0, 1e9 + 0.335):
        cents = one(spark, by_decimals(F.lit(v)))
        assert one(spark, fixed(F.lit(v), 2)) == f"{cents // 100}.{cents % 100:02d}"
    assert [one(spark, fixed(F.lit(v), 0)) for v in (2.5, -2.5, 0.49999999999999994, 17.0)] == ["3", "-3", "0", "17"]
