import pytest
from helpers import doubles, one
from pyspark.sql import functions as F

from pagelattice.functions import expr, typing
from pagelattice.functions import vocabulary as V


@pytest.mark.parametrize("gaps, want", [([1, 2, 3, 30, 35], 16.5), ([10, 11, 12, 13], 14.0), ([5, 15], 10.0), ([7], 7.0), ([], 10.0), ([0, 0, 0, 0], 1.0)])
def test_natural_threshold(spark, gaps, want):
    assert one(spark, expr.natural_threshold(doubles(gaps))) == want


def test_medians_and_modes(spark):
    assert one(spark, expr.median(doubles([3, 1, 2, 10]))) == 2.5
    assert one(spark, expr.upper_median(doubles([3, 1, 2, 10]))) == 3.0
    assert one(spark, expr.median(doubles([]))) is None
    assert one(spark, expr.first_mode(F.array(*map(F.lit, [3, 1, 1, 3, 2])))) == 3
    assert one(spark, expr.spacing(doubles([10, 10.4, 20, 30, 130]), 15.0)) == 10.0
    assert one(spark, expr.spacing(doubles([10, 20]), 15.0)) == 15.0


def test_clusters_join_the_first_group_that_is_near(spark):
    assert one(spark, expr.clusters(doubles([1, 2, 14, 16.5, 20, 50]), F.lit(15.0))) == [0, 0, 0, 0, 0, 1]
    assert one(spark, expr.clusters(doubles([]), F.lit(15.0))) == []


def test_scores(spark):
    assert one(spark, expr.fscore(F.lit(0.0), F.lit(0), F.lit(0)))["f"] == 1.0
    assert one(spark, expr.f1(F.lit(0), F.lit(0), F.lit(0)))["f1"] == 0.0
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    none = F.lit(None).cast("array<double>")
    assert one(spark, expr.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, expr.iou(none, none)) == 1.0 and one(spark, expr.iou(box(0, 0, 1, 1), none)) == 0.0


TYPES = {"42.5": "NUMERIC", "3,14": "NUMERIC", "-5~43": "NUMERIC", "204x840x840": "NUMERIC", "6.29/4.62": "NUMERIC", "R410A": "NUMERIC", "380~415": "NUMERIC", "3N~/50/380": "NUMERIC", "(123)": "NUMERIC", "kW": "UNIT", "dB(A)": "UNIT", "°C": "UNIT", "°C.": "UNIT", "-": "UNIT", "Hitachi": "TEXT", "Condizionamento": "TEXT", "(2)": "TEXT", "": "TEXT", "   ": "TEXT", "www.x.it": "TEXT", "pag. 12": "TEXT", "novità": "TEXT", "4 kW": "KW_HEADER", "Specifications": "SECTION", "COP": "SPEC_LABEL", "sound pressure level": "SPEC_LABEL", None: "TEXT"}


def test_types(spark):
    rows = spark.createDataFrame([(t, w) for t, w in TYPES.items()], "text string, want string")
    got = rows.select("text", "want", typing.type_of(F.col("text")).alias("got"), typing.type_of(F.col("text"), domain=False).alias("plain")).collect()
    assert [(r.text, r.got) for r in got if r.got != r.want] == []
    assert {r.plain for r in got} == {"NUMERIC", "UNIT", "TEXT"}


def test_brands(spark):
    rows = spark.createDataFrame([("RAS-8FSXNME",), ("FTXM25R",), ("ftxm25r",), ("50B",), ("Lorem ipsum dolor",)], "t string")
    assert [r[0] for r in rows.select(typing.brand_of(F.col("t"))).collect()] == ["hitachi", "daikin", "daikin", "daikin", None]
    every = typing.patterns_of()
    assert [r[0] for r in rows.select(typing.type_of(F.col("t"), every)).collect()] == ["MODEL", "MODEL", "MODEL", "SIZE_HEADER", "TEXT"]
    assert [len(V.BRANDS[b]["model"] + V.BRANDS[b]["model_any_case"]) for b in V.BRANDS] == [34, 37, 13, 28, 25]
    with pytest.raises(ValueError):
        typing.patterns_of("nobody")


def test_magnitudes(spark):
    rows = spark.createDataFrame([("4.50",), ("0",), ("",), ("abc",), ("3,14",), ("6.29/4.62",), ("- 12",)], "t string")
    got = [r[0] for r in rows.select(F.round(typing.magnitude(F.col("t")), 4)).collect()]
    assert got == [0.7404, 0.0, None, None, 0.6170, 0.8627, 1.1139]


def test_sections_and_nodes(spark):
    assert one(spark, typing.label_and_section(F.lit("[Dati]  Peso "))).asDict() == {"section": "Dati", "label": "Peso"}
    assert one(spark, typing.label_and_section(F.lit(" Peso"))).asDict() == {"section": "", "label": "Peso"}
    assert one(spark, typing.node_type_of(F.lit("RAS-4X"))) == "outdoor_unit"
    assert one(spark, typing.node_type_of(F.lit("unknown"))) == "product_unit"
    assert one(spark, typing.normalised(F.lit(" RM 12.50, Total!"))) == "rm 12.50 total"


def test_vocabulary_sizes():
    assert (len(V.UNITS), len(V.LABEL_WORDS), len(V.LABEL_PARTS), len(V.SECTION_WORDS), len(V.EXCLUDED), len(V.NODE_TYPES)) == (39, 74, 40, 18, 7, 45)
