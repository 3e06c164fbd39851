import pytest
from helpers import TABLE, boxes, words
from pyspark.sql import functions as F

from pagelattice.functions.typing import particles
from pagelattice.operators import assemble, field, grid, sense
from pagelattice.sources.adapters import fragments_merged


def pages(spark, rows):
    return sense.pages(particles(words(spark, rows)))


def test_the_small_table(spark):
    s = sense.sensed(pages(spark, TABLE))
    counts = s.select(F.size("cols").alias("cols"), "headers", "row_labels", "specs", "sections", "proofread").first()
    assert tuple(counts) == (2, 2, 3, 0, 0, 0)
    b = field.bonds(s)
    p = b.first()["params"]
    assert (p["sigma_y"], p["sigma_x"], round(p["lambda_z"], 4)) == (18.0, 50.0, 47.6924)
    got = [(r.entity, r.spec, r.value, r.unit, r.phi_spec, r.phi_col) for r in field.fact_rows(b).orderBy("spec_ord").collect()]
    assert got == [("Model-A", "COP", "4.50", None, 0.1171, 0.1018), ("Model-B", "COP", "3.80", None, 0.0842, 0.1018), ("Model-A", "Peso", "25", None, 0.1194, 0.0805), ("Model-B", "Peso", "30", None, 0.0847, 0.0805), ("Model-A", "Potenza", "10.5", None, 0.1192, 0.0686), ("Model-B", "Potenza", "12.0", None, 0.0847, 0.0686)]
    r = assemble.page_results(s).first()
    assert (r.page_type, r.mapped, r.unmapped, r.entities, r.total_specs) == ("technical", 6, 0, 2, 6)
    assert pages(spark, TABLE).select(grid.count_universal(F.col("ps"), "x", "fixed")).first()[0] == 3


def test_moving_a_page_changes_no_fact(spark):
    key = lambda rows: sorted((r.entity, r.spec, r.value, r.phi_spec) for r in field.fact_rows(field.bonds(sense.sensed(pages(spark, rows)))).collect())
    assert key(TABLE) == key([(t, x + 1000, y + 720) for t, x, y in TABLE])


def test_pages_without_enough(spark):
    few = [("a", 10, 10), ("12", 50, 10)]
    s = sense.sensed(pages(spark, few))
    assert s.select("headers", "specs", "proofread").first() == (0, 0, 0)
    assert field.fact_rows(field.bonds(s)).count() == 0
    empty = particles(words(spark, [("  ", 1, 1)]))
    assert empty.count() == 0 and sense.pages(empty).count() == 0


def test_sections_by_font(spark):
    rows = [("Heading", 50, 20, 20)] + [(f"word{k}", 50, 60 + 20 * k) for k in range(5)]
    s = sense.unpacked(sense.sensed(pages(spark, rows)))
    assert [r.text for r in s.filter("type = 'SECTION'").collect()] == ["Heading"]


def test_lonely_numbers_are_text_again(spark):
    rows = [("alpha", 400, 20), ("beta", 400, 50), ("gamma", 400, 80), ("delta", 400, 110), ("42", 100, 300), ("kW", 300, 500)]
    s = sense.sensed(pages(spark, rows))
    assert s.first()["proofread"] == 2
    assert {r.type for r in sense.unpacked(s).collect()} == {"TEXT"}


def test_labels_on_two_lines_become_one(spark):
    rows = [("Sound", 50, 100), ("pressure level", 60, 107), ("55", 200, 107), ("58", 300, 107), ("Weight", 50, 140), ("25", 200, 140), ("30", 300, 140)]
    typed = particles(words(spark, rows)).withColumn("type", F.when(F.col("x") < 100, "SPEC_LABEL").otherwise(F.col("type")))
    merged = sense.unpacked(sense.pages(typed).withColumn("ps", field.merged_labels(F.col("ps"))))
    assert [r.text for r in merged.filter("type = 'SPEC_LABEL'").orderBy("ord").collect()] == ["Weight", "Sound pressure level"]


def test_a_number_between_keeps_labels_apart(spark):
    base = [("Sound", 50, 100), ("level", 50, 108), ("Weight", 50, 160), ("1", 400, 160), ("2", 500, 160)]
    def labels(extra):
        typed = particles(words(spark, base + extra)).withColumn("type", F.when(F.col("x") < 100, "SPEC_LABEL").otherwise(F.col("type")))
        return sorted(r.text for r in sense.unpacked(sense.pages(typed).withColumn("ps", field.merged_labels(F.col("ps")))).filter("type = 'SPEC_LABEL'").collect())

    assert labels([]) == ["Sound level", "Weight"]
    assert labels([("7", 400, 104)]) == ["Sound", "Weight", "level"]


def test_of_two_numbers_the_stronger_stays(spark):
    rows = [("COP", 50, 100), ("4", 100, 100), ("5", 400, 100), ("Peso", 50, 130), ("6", 100, 130), ("7", 400, 130)]
    facts = {(r.entity, r.spec): r.value for r in field.fact_rows(field.bonds(sense.sensed(pages(spark, rows)))).collect()}
    assert facts == {("UNKNOWN", "COP"): "4", ("UNKNOWN", "Peso"): "6"}


def test_potential_falls_with_distance(spark):
    n = F.struct(F.lit(200.0).alias("x"), F.lit(100.0).alias("y"))
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit("SPEC_LABEL").alias("type"))
    phi = lambda o, axis="row": field.potential(n, o, axis, F.lit(6.0))
    near, far, right, off = spark.range(1).select(phi(at(150, 100)), phi(at(50, 100)), phi(at(250, 100)), phi(at(150, 130))).first()
    assert near > far > 0 and near == pytest.approx(1.5 * right) and off < 1e-8


def test_crystal(spark):
    ps = boxes(spark, [(x, y, x + 20, y + 10) for y in range(0, 100, 20) for x in (90, 190, 290)])
    rows = sense.pages(ps.withColumn("x", F.col("x") + 0.6 * (F.col("y0") / 20)))
    got = rows.select(sense.crystal(F.col("ps"))).first()[0]
    assert len(got) == 2 and abs(got[0] - 151) < 2 and abs(got[1] - 251) < 2
    assert sense.pages(boxes(spark, [(0, 0, 1, 1), (5, 5, 6, 6)])).select(sense.crystal(F.col("ps"))).first()[0] == []


def test_neighbour_evidence(spark):
    line = [(100 * k, 0, 100 * k + 20, 10) for k in range(3)]
    below = [(100 * k, 12, 100 * k + 20, 22) for k in range(3)]
    def evidence(places, n):
        rows = sense.pages(boxes(spark, places))
        return rows.select(sense.neighbour_evidence(F.slice("ps", 1, n), F.col("ps"))).first()[0]

    assert evidence(line + below, 3) == [True, True]
    assert evidence([(0, 0, 10, 10), (15, 0, 25, 10), (0, 20, 10, 30)], 2) == [False]
    assert evidence(line, 3) == [False, False] and evidence(line[:1], 1) == []


def test_row_counts(spark):
    count = lambda places: sense.pages(boxes(spark, places)).select(grid.count_universal(F.col("ps"), "y")).first()[0]
    assert count([(x, y, x + 20, y + 8) for y in range(100, 600, 100) for x in (0, 100, 200)]) == 5
    assert count([(x, y, x + 20, y + 8) for y in (100, 110, 120, 200, 210, 220) for x in (0, 100, 200)]) == 2
    assert count([(0, 0, 1, 1)]) == 1


def test_graph_and_rows(spark):
    facts = spark.createDataFrame([(1, "RAS-4X", 0, "[Dati] Peso", 0, "25", "kg"), (1, "RAS-4X", 0, "[Altro] Peso", 1, "30", None), (1, "RAS-4X", 0, "Peso", 2, "31", ""), (2, "X", 0, "COP", 0, "4", None)], "page_key long, entity string, entity_ord int, spec string, spec_ord int, value string, unit string")
    n = assemble.graph_nodes(facts, "hitachi", "cat")
    rows = {r.id: r for r in n.collect()}
    assert sorted(rows) == ["hitachi.outdoor_unit_0000", "hitachi.product_unit_0001"]
    assert sorted(rows["hitachi.outdoor_unit_0000"].properties) == ["Peso", "Peso_2", "Peso_altro"]
    flat = {(r.model, r.header): (r.value, r.unit, r.section) for r in assemble.sql_rows(n).collect()}
    assert flat[("RAS-4X", "Peso")] == ("25", "kg", "Dati") and flat[("RAS-4X", "Peso_2")] == ("31", "", "")


def _result(page, entities, labels=("A", "B"), kind="MODEL"):
    facts = [(e, 0, s, k, v, None, 0.0, 0.0, 0.1, 0.1) for k, (e, s, v) in enumerate(entities)]
    return (1, page, 5, facts, [(0.0, label, kind) for label in labels])


def test_cross_page(spark):
    schema = "doc_id long, page int, mapped int, facts array<struct<entity:string,entity_ord:int,spec:string,spec_ord:int,value:string,unit:string,x:double,y:double,phi_spec:double,phi_col:double>>, headings array<struct<x:double,label:string,type:string>>"
    rows = [_result(1, [("A", "COP", "1")]), _result(2, [("A", "COP", "2"), ("A", "EER", "3")], ("B",)), _result(3, [("C", "COP", "9")], ("Z",)), _result(8, [("A", "COP", "5")])]
    got = {r.page: r for r in assemble.merged_pages(spark.createDataFrame(rows, schema)).collect()}
    assert {p: r.base for p, r in got.items()} == {1: 1, 2: 1, 3: 3, 8: 8}
    assert [(f.entity, f.spec, f.value) for f in got[1].facts] == [("A", "COP", "1"), ("A", "EER", "3")] and got[2].facts == []
    apart = [_result(1, [("A", "COP", "1")]), _result(2, [("Q", "COP", "2")])]
    assert all(r.base == r.page and len(r.facts) == 1 for r in assemble.merged_pages(spark.createDataFrame(apart, schema)).collect())


def test_chunks(spark):
    rows = [("Intro line", 60, 20), ("Heading", 60, 60, 20), ("some words", 60, 100), ("x", 200, 100), ("more words", 60, 120), ("end", 60, 140)]
    got = [(r.section, r.text) for r in assemble.text_chunks(sense.sensed(pages(spark, rows))).orderBy("chunk").collect()]
    assert got[0] == ("GENERALE", "Intro line") and got[1][0] == "Heading" and "some words" in got[1][1] and " x" not in got[1][1]


def test_fragments(spark):
    rows = [("6", 103, 100), (",5", 112, 100), ("kW", 124, 100), ("far", 300, 100), ("Word", 103, 200)]
    got = [r.text for r in fragments_merged(particles(words(spark, rows))).orderBy("y0", "x0").collect()]
    assert got == ["6,5kW", "far", "Word"]
