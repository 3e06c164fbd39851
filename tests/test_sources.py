import json

from helpers import TABLE, words
from pyspark.sql import functions as F

from pagelattice.functions.typing import particles
from pagelattice.operators import alignment, diffusion, evaluate, field, grid, sense
from pagelattice.plans import catalog
from pagelattice.sources import adapters, sinks
from pagelattice.streaming.pages import page_facts

XML = """<annotation><size><width>300</width><height>200</height></size>
<object><name>table</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>300</xmax><ymax>200</ymax></bndbox></object>
<object><name>table row</name><bndbox><xmin>0</xmin><ymin>100</ymin><xmax>300</xmax><ymax>200</ymax></bndbox></object>
<object><name>table row</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>300</xmax><ymax>100</ymax></bndbox></object>
<object><name>table column</name><bndbox><xmin>150</xmin><ymin>0</ymin><xmax>300</xmax><ymax>200</ymax></bndbox></object>
<object><name>table column</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>150</xmax><ymax>200</ymax></bndbox></object>
<object><name>table spanning cell</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>300</xmax><ymax>100</ymax></bndbox></object></annotation>"""


def test_word_lists_and_truth(spark, tmp_path):
    (tmp_path / "t1_words.json").write_text(json.dumps([{"text": "12", "bbox": [1, 2, 3, 4]}, {"text": " ", "bbox": [0, 0, 1, 1]}, {"text": "Out", "bbox": [400, 2, 410, 4]}]))
    (tmp_path / "t1.xml").write_text(XML)
    w = adapters.word_lists(adapters.files(spark, str(tmp_path / "*_words.json")))
    t = adapters.truth(adapters.files(spark, str(tmp_path / "*.xml")))
    assert [(r.page_key, r.text, r.x1) for r in w.orderBy("ord").collect()] == [("t1", "12", 3.0), ("t1", "Out", 410.0)]
    r = t.first()
    assert [x.ymin for x in r.rows] == [0.0, 100.0] and [x.xmin for x in r["columns"]] == [0.0, 150.0] and len(r.spans) == 1 and r.table_box.xmax == 300.0
    assert [r.text for r in adapters.clipped(particles(w), t).collect()] == ["12"]
    cells = sorted((c.row_nums, c.col_nums) for c in grid.truth_cells(t).collect())
    assert cells == [([0], [0, 1]), ([1], [0]), ([1], [1])]
    a, b = adapters.pairs(w, t, limit=1)
    assert a.count() == 2 and b.count() == 1
    assert len(adapters.discovered(spark, str(tmp_path / "*"), 1)) == 1


def test_receipts_forms_boxes_labels(spark, tmp_path):
    quad = {"x1": 1, "y1": 2, "x2": 9, "y2": 2, "x3": 9, "y3": 8, "x4": 1, "y4": 8}
    (tmp_path / "r.json").write_text(json.dumps({"valid_line": [{"category": "total.price", "words": [{"text": "Total", "is_key": 1, "quad": quad}, {"text": "5", "quad": quad}]}]}))
    got = [(r.text, r.is_key, r.group_id, r.x0, r.y1) for r in adapters.receipts(adapters.files(spark, str(tmp_path / "r.json"))).orderBy("ord").collect()]
    assert got == [("Total", 1, -1, 1.0, 8.0), ("5", 0, -1, 1.0, 8.0)]
    form = {"form": [{"id": 0, "label": "question", "text": "Q", "linking": [[0, 1]], "words": [{"text": "Q", "box": [0, 0, 5, 5]}]}, {"id": 1, "label": "answer", "text": "7", "linking": [[0, 1], [1, 9]], "words": [{"text": "7", "box": [9, 0, 12, 5]}, {"text": "flat", "box": [1, 1, 1, 5]}]}]}
    (tmp_path / "f.json").write_text(json.dumps(form))
    raw = adapters.files(spark, str(tmp_path / "f.json"))
    assert [(r.text, r.entity_id) for r in adapters.forms(raw).orderBy("ord").collect()] == [("Q", 0), ("7", 1)]
    assert [(r.from_id, r.to_id, r.to_label) for r in adapters.form_links(raw).collect()] == [(0, 1, "answer")]
    (tmp_path / "b.csv").write_text("1,1,9,1,9,5,1,5,RM 1,200.00\nx,1,9,1,9,5,1,5,bad\n1,1,1,1,1,5,1,5,flat\n\n1,2,3\n")
    assert [r.text for r in adapters.box_lines(adapters.file_lines(spark, str(tmp_path / "b.csv"))).collect()] == ["RM 1,200.00"]
    (tmp_path / "d.txt").write_text("word\t1\t2\t9\t8\t0\t0\t0\tfont\tparagraph\nbad\t1\t2\tx\t8\t0\t0\t0\tfont\ttitle\nshort\t1\n")
    assert [(r.text, r.label) for r in adapters.labelled_lines(adapters.file_lines(spark, str(tmp_path / "d.txt"))).collect()] == [("word", "paragraph")]


def test_a_file_that_is_no_pdf_is_reported(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"no pdf")
    r = adapters.pdf_words(spark, str(tmp_path / "*.pdf")).collect()
    assert len(r) == 1 and r[0].error


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, 0, "S", "a"), (1, 1, 1, "T", "b"), (1, 2, 0, "S", "c")], "doc_id long, page int, chunk int, section string, text string")
    assert sinks.chunk_lines(chunks).first()["value"] == "<!-- page 1 -->\n\n## S\n\na\n\n## T\n\nb\n\n<!-- page 2 -->\n\n## S\n\nc"
    sinks.write_markdown(chunks, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() == 15
    sinks.write_rows(chunks, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 3


def test_grid_score():
    same = [["a", "b"], ["c", "d"]]
    assert alignment.grid_score(same, same, alignment.text_similarity) == (1.0, 1.0, 1.0)
    f, p, r = alignment.grid_score(same, [["a", "b"]], alignment.text_similarity)
    assert (p, r) == (1.0, 0.5) and abs(f - 2 / 3) < 1e-12
    assert alignment.text_similarity("", "") == 1.0 and alignment.text_similarity("ab", "") == 0.0 and alignment.text_similarity("abcd", "bcde") == 0.75
    assert alignment.box_similarity(None, None) == 1.0 and alignment.box_similarity([0, 0, 1, 1], None) == 0.0
    assert alignment.span_grid([([0], [0, 1]), ([1], [0])]) == [[[0, 0, 2, 1], [-1, 0, 1, 1]], [[0, 0, 1, 1], None]]


def test_joined_cells(spark):
    """Against a plain walk through each row: empty ones first, then reaching words, over all short rows of some texts."""
    import itertools

    def walked(texts):
        owner = list(range(len(texts)))
        for c in range(len(texts) - 1, 0, -1):
            if not texts[c].strip() and texts[c - 1].strip():
                owner[c] = c - 1
        for c in range(len(texts)):
            if owner[c] == c and "total" in texts[c].lower():
                after = max(k for k in range(len(texts)) if owner[k] == c) + 1
                if after < len(texts) and owner[after] == after and (not texts[after].strip() or texts[after].replace(".", "").isdigit()):
                    owner[after] = c
        return [([k for k in range(len(texts)) if owner[k] == c], texts[c]) for c in range(len(texts)) if owner[c] == c]

    rows = [r for n in (1, 2, 3, 4) for r in itertools.product(("", "a", "Total", "1.5"), repeat=n)]
    df = spark.createDataFrame([(k, [(0, c, t) for c, t in enumerate(r)]) for k, r in enumerate(rows)], "k int, cells array<struct<row:int,col:int,text:string>>")
    got = {r.k: [(list(c.cols), c.text) for c in r.j] for r in df.select("k", grid.joined_cells(F.col("cells")).alias("j")).collect()}
    assert got == {k: walked(r) for k, r in enumerate(rows)}


def test_dense_rows(spark):
    """Against a loop that starts anew after each merge."""
    import random

    def looped(rows, n_cols, least):
        rows = [list(r) for r in rows]
        while len(rows) > 1:
            k = next((k for k, r in enumerate(rows) if len({x for x, _ in r}) / n_cols < least), None)
            if k is None:
                break
            mid = [sorted(y for _, y in r)[len(r) // 2] for r in rows]
            to = min((j for j in (k - 1, k + 1) if 0 <= j < len(rows)), key=lambda j: (abs(mid[k] - mid[j]), j))
            rows[to] += rows.pop(k) if to < k else rows[k]
            if to > k:
                rows.pop(k)
        return sorted(len(r) for r in rows)

    rng, tables = random.Random(6), []
    for _ in range(60):
        at = 0.0
        tables.append([])
        for _ in range(rng.randrange(0, 7)):
            at += rng.choice([5.0, 9.0, 20.0])
            tables[-1].append([(rng.randrange(4), at + rng.choice([0.0, 1.0])) for _ in range(rng.randrange(1, 5))])
    data = [(k, [(float(100 * x + 50), y, g) for g, r in enumerate(t) for x, y in r]) for k, t in enumerate(tables)]
    df = spark.createDataFrame(data, "k int, rowed array<struct<x:double,y0:double,g:int>>").withColumn("splits", F.array(*[F.lit(100.0 * s) for s in (1, 2, 3)]))
    got = {r.k: sorted(len(x) for x in r.d) for r in df.select("k", grid.dense_rows(F.col("rowed"), F.col("splits"), 0.6).alias("d")).collect()}
    assert got == {k: looped(t, 4, 0.6) for k, t in enumerate(tables)}


def test_diffusion(spark):
    out = diffusion.diffused(sense.pages(particles(words(spark, TABLE))))
    kinds = {r.text: r.type for r in sense.unpacked(out.select("page_key", "ps")).collect()}
    assert kinds["COP"] == "SPEC_LABEL" and kinds["Model-A"] == "MODEL" and kinds["25"] == "NUMERIC"


def test_diffusion_by_chains(spark):
    rows = sense.pages(particles(words(spark, TABLE)))
    adj = rows.select(diffusion.numbers_below(diffusion.adjacency(F.col("ps")))).first()[0]
    assert adj == [3, 3, 0, 2, 2, 0, 1, 1, 0, 0, 0]
    kinds = {r.text: r.type for r in sense.unpacked(diffusion.diffused_far(rows).select("page_key", "ps")).collect()}
    assert kinds["COP"] == kinds["Peso"] == "SPEC_LABEL" and kinds["Model-B"] == "MODEL" and kinds["4.50"] == "NUMERIC"


def test_a_catalogue(spark, tmp_path):
    from pagelattice.plans import catalogue

    rows = TABLE + [(f"more words {k}", 500, 300 + 40 * k) for k in range(8)]
    pages = [words(spark, rows, page=k).withColumns({"doc_id": F.lit("d"), "page": F.lit(k)}) for k in (1, 2)]
    pages[0].unionByName(pages[1]).write.parquet(str(tmp_path / "in"))
    found = catalogue.run(spark.read.parquet(str(tmp_path / "in")), "hitachi", domain=False)
    s = found["stats"].first()
    assert (s.pages, s.technical, s.merged_pages, s.nodes, s.properties) == (2, 2, 1, 2, 6)
    assert found["rows"].count() == 6 and {r.page for r in found["rows"].collect()} == {1}
    catalogue.write(found, str(tmp_path))
    assert spark.read.json(str(tmp_path / "graph")).count() == 2 and spark.read.json(str(tmp_path / "rows")).count() == 6


def test_stream_equals_batch(spark, tmp_path):
    rows = sense.pages(particles(words(spark, TABLE)).unionByName(particles(words(spark, TABLE, page=2))))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = page_facts(stream).writeStream.format("memory").queryName("facts_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = field.fact_rows(field.bonds(sense.sensed(rows)))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(spark.table("facts_out")) == key(want) and want.count() == 12


def test_boundaries_on_rendered_pages(spark, small):
    b = evaluate.scores(catalog.queries()["boundary_x"](spark, small)).first()
    assert b.total > 0 and 0 < b.precision <= 1 and 0 < b.recall <= 1
    mapped = catalog.queries()["page_class"](spark, small).agg(F.sum("mapped"), F.sum("unmapped")).first()
    bonds = catalog.queries()["phi_bonds"](spark, small).agg(F.count("spec"), F.count_if(F.col("spec").isNull())).first()
    assert tuple(mapped) == tuple(bonds)


def test_streamed_tables_go_on_as_in_batch(spark, small, tmp_path):
    """Pages of documents, a trigger for each few pages in order, against the merging of whole documents."""
    from pagelattice.operators import assemble, sense
    from pagelattice.plans import catalog
    from pagelattice.streaming.pages import continued

    pages = catalog.grid_pages(spark, small).filter("page_key < 72").withColumns({"doc_id": F.floor(F.col("page_key") / 12), "page": (F.col("page_key") % 12 + 1).cast("int")})
    want = {(str(r.doc_id), r.page): r.base for r in assemble.merged_pages(assemble.page_results(sense.sensed(pages.drop("doc_id", "page"))).withColumns({"doc_id": F.floor(F.col("page_key") / 12), "page": (F.col("page_key") % 12 + 1).cast("int")})).collect()}
    for k in range(3):
        pages.filter(F.col("page").between(4 * k + 1, 4 * k + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    q = continued(stream).writeStream.format("memory").queryName("bases").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.doc_id, r.page): r.base for r in spark.table("bases").collect()} == want
