"""Blocks of pages: a page among many gives what it gives alone, and plans stay small."""

import random

from helpers import TABLE, words
from pyspark.sql import functions as F

from pagelattice.functions.typing import particles
from pagelattice.operators import field, grid, gridding, sense

KINDS = ("TEXT", "NUMERIC", "SPEC_LABEL", "UNIT", "MODEL", "UNKNOWN")


def random_pages(spark, n=60):
    rnd, rows = random.Random(5), []
    for page in range(n):
        for k in range(rnd.choice((1, 4, 5, 9, 23, 60))):
            kind, x, y = rnd.choice(KINDS), 10.0 * rnd.randrange(30), 5.0 * rnd.randrange(30)
            rows.append((page, k, rnd.choice(("12", "3,5", "x")) if kind == "NUMERIC" else rnd.choice(("COP", "kW", "Aa")), x + 9, y + 6, x, y, x + 18, y + 12, 10.0, kind))
    return spark.createDataFrame(rows, "page_key long, ord int, text string, x double, y double, x0 double, y0 double, x1 double, y1 double, size double, type string")


def found(particles_):
    bound = field.bonds(sense.sensed(sense.pages(particles_)))
    return {r.page_key: r for r in bound.select("page_key", "ps", "params", "nums", "headings", "facts").collect()}


def test_a_page_among_many_is_as_alone(spark):
    rows = random_pages(spark).cache()
    every = found(rows)
    assert len(every) == 60 and sum(len(r.facts) for r in every.values()) > 40
    for page in (0, 7, 23, 41):
        assert found(rows.filter(F.col("page_key") == page))[page] == every[page]


def test_merged_labels_are_those_of_the_expression(spark):
    rows = sense.pages(random_pages(spark))
    want = {r.page_key: r.ps for r in rows.select("page_key", field.merged_labels(F.col("ps")).alias("ps")).collect()}
    got = {r.page_key: r.ps for r in field.bonds(rows).select("page_key", "ps").collect()}
    assert got == want


def test_plans_stay_small(spark):
    bound = field.bonds(sense.sensed(sense.pages(particles(words(spark, TABLE)))))
    assert len(bound._jdf.queryExecution().toString()) < 100_000


def test_null_places_are_near_nothing(spark):
    rows = sense.pages(particles(words(spark, TABLE))).select("page_key", F.concat("ps", F.array(F.struct(F.lit(99).alias("ord"), F.lit("7").alias("text"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "x0", "y0", "x1", "y1")], F.lit(10.0).alias("size"), F.lit("NUMERIC").alias("type")))).alias("ps"))
    assert field.fact_rows(field.bonds(sense.sensed(rows))).count() == 6


def test_grids_are_those_of_the_expressions(spark):
    rows = sense.pages(random_pages(spark).withColumn("y1", F.col("y0") + F.when(F.col("ord") % 3 == 0, 3.0).otherwise(4.5)))
    ps, splits = F.col("ps"), F.col("splits")
    for method in ("ratio", "ratio+crystal"):
        want = {r.page_key: r.v for r in rows.select("page_key", grid.col_splits(ps, method).alias("v")).collect()}
        assert {r.page_key: r.splits for r in grid.splits_of(rows, method).collect()} == want
    want = rows.withColumn("splits", grid.col_splits(ps, "ratio")).select("page_key", grid.row_splits(ps, splits, "natural").alias("n"), grid.predicted_cells(ps, splits).alias("c")).collect()
    assert {r.page_key: r.row_splits for r in gridding.gridded(rows, "row_splits", row_method="natural").collect()} == {r.page_key: r.n for r in want}
    assert {r.page_key: r.cells for r in gridding.gridded(rows, "cells").collect()} == {r.page_key: r.c for r in want}


def test_counts_and_columns_are_those_of_the_expressions(spark):
    rows, ps = sense.pages(random_pages(spark)), F.col("ps")
    want = rows.select("page_key", grid.count_universal(ps).alias("x"), grid.count_universal(ps, "y").alias("y"), grid.col_splits(ps, "maxjump").alias("s"), sense.detected_columns(ps).alias("c")).collect()
    got = {r.page_key: (r.jump_cols, r.jump_rows) for r in gridding.gridded(rows, "jump_cols", "jump_rows").collect()}
    assert got == {r.page_key: (r.x, r.y) for r in want}
    assert {r.page_key: r.splits for r in grid.splits_of(rows, "maxjump").collect()} == {r.page_key: r.s for r in want}
    assert {r.page_key: r.cols for r in sense.found_columns(rows).collect()} == {r.page_key: r.c for r in want}
