"""SQL for the queries over files, reports and evaluators: what the files were made from, said directly."""

from __future__ import annotations

from ..functions import vocabulary as V
from .oracles import ACCURACY, BODY, BOUND, CELLS, CODES, FACTS, PARTICLES, RECEIPTS, RESULTS, ROWS, SENSED, _any, _boundary, _brand, _fold, _gaps, _q, _row_votes, _strip, _threshold, _type, _words, sql as engine_sql

#: The base typing of a stripped text t.
BASE = engine_sql()["typify_base"].split("SELECT p_partkey, k, CASE", 1)[1].rsplit(" AS type", 1)[0]


def _scores(k_y: str = "0.1", columns: str = "") -> str:
    """sc(page_key, gr, pr, pc, top): the grid scores, with rows by a constant; columns by the ratio, or as given by bl."""
    votes = _row_votes("fixed").replace("* 0.1 AS t", f"* {k_y} AS t")
    if columns:
        votes = columns + ",\ncs AS (" + votes.split("\ncs AS (", 1)[1]
    return f"""WITH RECURSIVE {BODY},
{ROWS}, {votes}, {CELLS},
sz AS (SELECT rr.page_key, max(r) + 1 AS pr, any_value(len(coalesce(bl.cuts, []::DOUBLE[]))) + 1 AS pc, max(n) AS gr FROM rr LEFT JOIN bl USING (page_key) JOIN (SELECT l_orderkey AS page_key, count(*) AS n FROM lineitem GROUP BY 1) USING (page_key) GROUP BY rr.page_key HAVING count(*) >= 3),
sc0 AS (SELECT page_key, gr, pr, pc, least(gr, pr) * least(4, pc) / (pr * pc) AS pp, least(gr, pr) * least(4, pc) / (gr * 4) AS rec FROM sz WHERE pr <= 60 AND pc <= 35),
sc AS (SELECT page_key, gr, pr, pc, CASE WHEN pp + rec > 0 THEN 2 * pp * rec / (pp + rec) ELSE 0 END AS top FROM sc0)"""


#: Columns by the largest jump, as the list that the rows are found with.
JUMP = engine_sql()["col_splits_maxjump"].split(f"{ROWS}, ", 1)[1].rsplit("\nSELECT page_key, median(v) AS split", 1)[0] + """,
bl0 AS (SELECT page_key, median(v) AS split FROM bn JOIN nl USING (page_key) GROUP BY page_key, run, n HAVING count(*) >= greatest(2.0, n * 0.2)),
bl AS (SELECT page_key, list(split ORDER BY split) AS cuts FROM bl0 GROUP BY page_key)"""


#: Zones that several lines agree on, and the headings of a number's own zone.
ZONED = (
    _fold("rf", "(SELECT p.*, greatest(4.0, ra.v * 0.5) AS rt FROM p JOIN ra USING (page_key))", "y0", "rt")
    + f""",
{_gaps('rf', 'x')},
zg AS (SELECT page_key, list_sort(list(gap)) AS gs FROM gp WHERE gap > 0 GROUP BY page_key),
{_threshold('zt', 'zg', 'page_key')},
zn AS (SELECT page_key, count(DISTINCT g) AS n FROM rf GROUP BY page_key),
zc AS (SELECT gp.page_key, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY gp.page_key ORDER BY pos) < 30 THEN 0 ELSE 1 END AS b FROM gp JOIN zt USING (page_key) WHERE gap > 0 AND gap > t),
zr AS (SELECT page_key, pos, sum(b) OVER (PARTITION BY page_key ORDER BY pos, b DESC ROWS UNBOUNDED PRECEDING) AS run FROM zc),
zb AS (SELECT page_key, avg(pos) AS v FROM zr JOIN zn USING (page_key) GROUP BY page_key, run, n HAVING count(*) >= greatest(2.0, n * 0.15)),
zo AS (SELECT p.page_key, p.ord, count(zb.v) AS zone FROM p LEFT JOIN zb ON zb.page_key = p.page_key AND zb.v <= p.x GROUP BY 1, 2),
"""
    + BOUND.replace("o.type IN ('MODEL', 'SIZE_HEADER', 'KW_HEADER')),", "o.type IN ('MODEL', 'SIZE_HEADER', 'KW_HEADER') JOIN zo zno ON zno.page_key = n.page_key AND zno.ord = n.ord JOIN zo zho ON zho.page_key = o.page_key AND zho.ord = o.ord AND zho.zone = zno.zone),", 1)
)

#: Which page each table of a document of twelve pages goes on from.
MERGED = """hh AS (SELECT page_key, arg_min(type, ord) AS col_type, list(DISTINCT text) AS labels FROM sensed JOIN ok USING (page_key) WHERE type IN ('MODEL', 'SIZE_HEADER', 'KW_HEADER') GROUP BY page_key),
cp AS MATERIALIZED (SELECT pr.page_key, pr.page_key // 12 AS doc_id, (pr.page_key % 12 + 1)::INT AS page, col_type, labels, mapped, total_specs FROM pr LEFT JOIN hh USING (page_key)),
cd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM cp WHERE col_type IS NOT NULL AND mapped >= 3),
ct AS MATERIALIZED (SELECT a.doc_id, a.page, a.page_key, arg_max(b.page, b.k) AS to_page FROM cd a LEFT JOIN cd b ON b.doc_id = a.doc_id AND b.k BETWEEN a.k - 3 AND a.k - 1 AND a.page - b.page <= 3 AND a.col_type = b.col_type AND list_has_any(a.labels, b.labels) GROUP BY 1, 2, 3),
cb AS (SELECT doc_id, page, page_key, page AS base FROM ct WHERE to_page IS NULL UNION ALL SELECT ct.doc_id, ct.page, ct.page_key, cb.base FROM cb JOIN ct ON ct.doc_id = cb.doc_id AND ct.to_page = cb.page),
pel AS MATERIALIZED (SELECT page_key, list(DISTINCT entity) AS es FROM facts GROUP BY 1),
sh AS (SELECT DISTINCT m.doc_id, m.base FROM cb m JOIN cb f ON f.doc_id = m.doc_id AND f.page = m.base JOIN pel a ON a.page_key = m.page_key JOIN pel b ON b.page_key = f.page_key WHERE m.page <> m.base AND list_has_any(a.es, b.es)),
un AS (SELECT doc_id, base, count(DISTINCT (entity, spec)) AS n FROM cb JOIN sh USING (doc_id, base) JOIN facts USING (page_key) GROUP BY 1, 2)
SELECT cp.doc_id, cp.page, CASE WHEN un.base IS NULL THEN cp.page ELSE cb.base END AS base, CASE WHEN un.base IS NULL THEN cp.total_specs WHEN cb.base = cp.page THEN un.n ELSE 0 END::BIGINT AS n_facts
FROM cp LEFT JOIN cb USING (page_key) LEFT JOIN un ON un.doc_id = cp.doc_id AND un.base = cb.base"""

CHUNKS = r"""tl AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER tw) <= 3 THEN 0 ELSE 1 END AS b, row_number() OVER tw AS i FROM sensed WINDOW tw AS (PARTITION BY page_key ORDER BY y0, x0, ord)),
tg AS (SELECT *, sum(b) OVER (PARTITION BY page_key ORDER BY i ROWS UNBOUNDED PRECEDING) AS line FROM tl),
tt AS (SELECT page_key, line, left(arg_min(text, i) FILTER (WHERE type = 'SECTION'), 50) AS section, coalesce(trim(string_agg(text, ' ' ORDER BY x0, i) FILTER (WHERE type <> 'TEXT' OR length(text) > 2)), '') AS text FROM tg GROUP BY 1, 2),
tc AS (SELECT *, count(section) OVER (PARTITION BY page_key ORDER BY line ROWS UNBOUNDED PRECEDING) AS chunk FROM tt),
tx AS (SELECT page_key, chunk::INT AS chunk, 'text' AS type, coalesce(max(section), 'GENERALE') AS section, string_agg(text, E'
' ORDER BY line) FILTER (WHERE length(text) > 3) AS text FROM tc GROUP BY page_key, chunk),
te AS (SELECT page_key, entity, entity_ord, string_agg('- ' || spec || ': ' || value || CASE WHEN coalesce(unit, '') <> '' THEN ' ' || unit ELSE '' END, E'
' ORDER BY spec) AS ls FROM facts GROUP BY 1, 2, 3),
ta AS (SELECT page_key, string_agg('## ' || entity || E'
' || ls || E'
', E'
' ORDER BY entity_ord) AS text FROM te GROUP BY 1)
SELECT * FROM tx WHERE text IS NOT NULL UNION ALL SELECT page_key, 1000000, 'table', 'DATI TECNICI STRUTTURATI', ta.text FROM pr JOIN ta USING (page_key) WHERE mapped >= 3"""


def sql() -> dict[str, str]:
    grid = f"WITH RECURSIVE {PARTICLES}"
    facts = f"{grid},\n{SENSED},\n{BOUND},\n{FACTS}"
    receipts = f"WITH {RECEIPTS}"
    lines = "page_key, ord, text, x0, y0, x1, y1, size"
    #: A list that has a blank word last.
    words = f"WITH {_words()}"
    listed = "SELECT page_key, ord, text, x0, y0, x1, y1 FROM w UNION ALL SELECT page_key, max(ord) + 1, '  ', 0, 1, 2, 3 FROM w GROUP BY page_key"
    middle = "(x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, x0, y0, x1, y1"
    n_rows = "SELECT l_orderkey AS page_key, count(*) AS n FROM lineitem GROUP BY 1"
    part = "CASE WHEN p_partkey >= 0 THEN coalesce(CASE " + " ".join(f"WHEN {_brand('code', b, 'model')} OR {_brand('code', b, 'size')} THEN {_q(b)}" for b in V.BRANDS) + " END, 'nobody') END"
    hitachi = _type("t", True, ("hitachi",))
    out = {
        "src_word_lists": f"{words} SELECT {lines.replace('size', '10.0::DOUBLE AS size')} FROM w",
        "src_plain_words": f"{words} SELECT page_key, ord, text, {middle}, x1 - x0 AS w, y1 - y0 AS h, 10.0::DOUBLE AS size, 'UNKNOWN' AS type FROM ({listed})",
        "src_base_words": rf"{words}, u AS (SELECT *, {_strip('text')} AS t, regexp_replace(lower({_strip('text')}), '\.+$', '') AS tl FROM w) SELECT page_key, ord, left(t, 80) AS text, {middle}, 0.0::DOUBLE AS size, CASE{BASE} AS type FROM u",
        "src_truth_xml": f"""WITH n AS ({n_rows}), b AS (
  SELECT page_key, 'table' AS kind, 0 AS i, 30.0 AS xmin, 44.0 AS ymin, 540.0 AS xmax, 89.0 + 30 * n AS ymax FROM n
  UNION ALL SELECT page_key, 'header', 0, 30, 44, 540, 56 FROM n UNION ALL SELECT page_key, 'span', 0, 140, 89, 340, 119 FROM n
  UNION ALL SELECT page_key, 'row', i, 30, 89 + 30 * i, 540, 119 + 30 * i FROM (SELECT page_key, unnest(range(n)) AS i FROM n)
  UNION ALL SELECT page_key, 'column', i, 140 + 100 * i, 44, 240 + 100 * i, 500 FROM (SELECT page_key, unnest(range(4)) AS i FROM n))
SELECT page_key, 600.0::DOUBLE AS width, 800.0::DOUBLE AS height, kind, i::INT AS i, xmin::DOUBLE AS xmin, ymin::DOUBLE AS ymin, xmax::DOUBLE AS xmax, ymax::DOUBLE AS ymax FROM b""",
        "src_receipts": f"{receipts} SELECT page_key, (line_idx * 10000 + 1 - is_key)::INT AS ord, text, x0, y0, x1, y1, y1 - y0 AS size, line_idx, is_key, category, line_idx AS group_id FROM w",
        "src_receipt_truth": f"{receipts} SELECT k.page_key, k.line_idx, k.category, k.line_idx AS group_id, k.text AS key, v.text AS value FROM w k JOIN w v ON v.page_key = k.page_key AND v.ord = k.ord + 1 WHERE k.is_key = 1",
        "src_forms": f"{receipts} SELECT page_key, (ord * 10000)::INT AS ord, text, x0, y0, x1, y1, y1 - y0 AS size, ord AS entity_id, CASE WHEN is_key = 1 THEN 'question' ELSE 'answer' END AS label FROM w",
        "src_form_links": f"{receipts} SELECT k.page_key, k.ord AS from_id, v.ord AS to_id, 'question' AS from_label, 'answer' AS to_label, k.text AS from_text, v.text AS to_text FROM w k JOIN w v ON v.page_key = k.page_key AND v.ord = k.ord + 1 WHERE k.is_key = 1",
        "src_box_lines": f"{receipts} SELECT page_key, ord, CASE WHEN is_key = 1 THEN text || ', it says' ELSE text END AS text, x0, y0, x1, y1, y1 - y0 AS size FROM w",
        "src_box_particles": f"{receipts}, b AS (SELECT page_key, ord, x, y, CASE WHEN is_key = 1 THEN text || ', it says' ELSE text END AS text FROM p) SELECT page_key, ord, text, x, y, {_type('text', False, False)} AS type FROM b",
        "src_labelled_lines": f"{words} SELECT page_key, ord, text, x0, y0, x1, y1, y1 - y0 AS size, CASE WHEN col_idx IS NOT NULL THEN 'table' ELSE 'paragraph' END AS label FROM w",
        "src_labelled_particles": f"{words} SELECT CASE WHEN col_idx IS NOT NULL THEN 'table' ELSE 'paragraph' END AS label, {_type('text', False, False)} AS type, count(*) AS n FROM w GROUP BY 1, 2",
        "src_pairs": f"{grid}, n AS ({n_rows}) SELECT page_key, count(*) AS words FROM p JOIN n USING (page_key) WHERE page_key % 6 = 0 AND y0 >= 42 AND y1 <= 91 + 30 * n AND x >= 28 AND x1 <= 542 GROUP BY page_key",
        "src_files": "SELECT c_nationkey AS page_key, count(*) AS n, min(c_name) AS first, max(c_name) AS last FROM customer GROUP BY 1",
        "src_batches": f"WITH {CODES} SELECT DISTINCT {part} AS brand, regexp_replace(split_part(p_type, ' ', 1), '\\W', '', 'g') AS name FROM codes JOIN part USING (p_partkey) WHERE {part} <> 'nobody'",
        "sink_graph": engine_sql()["graph_nodes"].replace(", n AS n_properties, page_key FROM en", ", page_key FROM en"),
        "sink_rows": engine_sql()["sql_rows"],
        "sink_metrics": f"{_scores()} SELECT page_key, gr::INT AS gt_rows, pr::INT AS pred_rows, pc::INT AS pred_cols, round(top, 6) AS top, pc = 4 AS col_exact, pr = gr AS row_exact FROM sc",
        "sink_markdown": """WITH c AS (SELECT l_suppkey AS doc_id, l_orderkey AS page, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS chunk, l_shipdate::DATE::VARCHAR AS section, 'part ' || l_partkey AS text FROM lineitem),
b AS (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY doc_id ORDER BY page, chunk) IS DISTINCT FROM page THEN '<!-- page ' || page || E' -->\\n\\n' ELSE '' END || '## ' || section || E'\\n\\n' || text AS block FROM c)
SELECT doc_id, string_agg(block, E'\\n\\n' ORDER BY page, chunk) AS text FROM b GROUP BY doc_id""",
        "brand_patterns": f"WITH {CODES} " + " UNION ALL ".join(f"SELECT p_partkey, {_q(b)} AS brand, {_brand('code', b, 'model')} AS model, {_brand('code', b, 'size')} AS size FROM codes" for b in V.BRANDS),
        "fragments": rf"""WITH {CODES}, f AS (SELECT p_partkey AS page_key, unnest(range(ceil(length(code) / 3)::INT)) AS k, code FROM codes),
g AS (SELECT page_key, k, trim(substring(code, 3 * k + 1, 3)) AS t, 40.0 + 20 * k AS x0 FROM f),
gl AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY page_key ORDER BY k) = 1 THEN 0 ELSE 1 END AS b FROM g WHERE t <> ''),
gr AS (SELECT *, sum(b) OVER (PARTITION BY page_key ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM gl),
gm AS (SELECT page_key, run, count(*) AS n, min(k) AS ord, string_agg(t, '' ORDER BY k) AS t, min(x0) AS x0, max(x0) + 18 AS x1 FROM gr GROUP BY page_key, run),
whole AS (SELECT page_key, run, ord, t AS text, {hitachi} AS type, x0, x1, n FROM gm),
single AS (SELECT page_key, run, k AS ord, t AS text, {hitachi} AS type, x0, x0 + 18 AS x1 FROM gr),
every AS (SELECT page_key, ord, text, type, x0, x1 FROM whole WHERE n > 1 AND type <> 'TEXT' UNION ALL SELECT s.page_key, s.ord, s.text, s.type, s.x0, s.x1 FROM single s JOIN whole w USING (page_key, run) WHERE w.n = 1 OR w.type = 'TEXT')
SELECT page_key, ord::INT AS ord, text, type, x0::DOUBLE AS x0, x1::DOUBLE AS x1 FROM every WHERE type <> 'TEXT'""",
        "page_particles": f"WITH RECURSIVE {PARTICLES.replace(_type('text', False, False), _type('text', True, ('hitachi',)))},\n{SENSED} SELECT page_key, count(*) FILTER (WHERE type = 'NUMERIC') AS numeric, count(*) AS n FROM sensed GROUP BY page_key",
        "size_averages": f"{facts}, {ACCURACY} SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS pages, sum(n)::BIGINT AS n_bonds, round(sum(co) / sum(n), 6) AS col_acc, round(sum(ro) / sum(n), 6) AS row_acc, round(sum(ce) / sum(n), 6) AS cell_acc FROM ba",
        "word_pairs": f"""WITH RECURSIVE {BODY}, {ROWS}, {_gaps('rf', 'x')}, gt0 AS (SELECT * FROM gl), {_threshold('gt', 'gt0', 'page_key, g')},
mk AS (SELECT gp.page_key, least(3, greatest(0, ceil((gp.a - 190) / 100 - 0.5))) <> least(3, greatest(0, ceil((gp.b - 190) / 100 - 0.5))) AS t, len(gt.gs) >= 3 AND gt.t <= gt.gs[len(gt.gs)] AND gp.gap > gt.t AS p FROM gp JOIN gt USING (page_key, g)),
bc AS (SELECT page_key, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) AS total FROM mk GROUP BY page_key)
SELECT bc.*, words FROM bc JOIN (SELECT page_key, count(*) AS words FROM p GROUP BY 1) USING (page_key)""",
        "sparse_columns": f"{_scores()} SELECT (pc - 4)::INT AS off, count(*) AS pages, round(avg(top), 6) AS top FROM sc GROUP BY 1",
        "score_histogram": f"{_scores()} SELECT least(9, floor(round(top, 6) * 10))::INT AS bin, count(*) AS pages FROM sc GROUP BY 1",
        "worst_tables": f"{_scores()} SELECT page_key, gr::INT AS gt_rows, 4 AS gt_cols, pr::INT AS pred_rows, pc::INT AS pred_cols, round(top, 6) AS top FROM sc ORDER BY top, page_key LIMIT 20",
        "fixed_against_jump": f"WITH a AS ({_scores('0.05')} SELECT 'fixed' AS method, * FROM sc), b AS ({_scores('0.05', JUMP)} SELECT 'maxjump' AS method, * FROM sc) SELECT method, count(*) AS pages, round(avg(top), 6) AS top, round(avg((pc = 4)::INT), 6) AS col_exact, round(avg((pr = gr)::INT), 6) AS row_exact FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY method",
    }
    results = f"{facts},\n{RESULTS}"
    zoned = f"{grid},\n{SENSED},\n{ZONED}"
    places = "SELECT page_key, round(x, 1) AS kx, round(y, 1) AS ky, max((entity, spec)) AS f FROM facts GROUP BY 1, 2, 3"
    cells = f"WITH RECURSIVE {RECEIPTS}, {ROWS}, {_row_votes('fixed')}, {CELLS}, " + engine_sql()["pred_cells"].split(f"{CELLS}, ", 1)[1].rsplit(" SELECT cl.page_key", 1)[0]
    catalogue = PARTICLES.replace(_type("text", False, False), _type("text", True, ("hitachi",))).replace("AS type FROM w)", "AS type FROM w WHERE page_key IN (SELECT page_key FROM w GROUP BY page_key HAVING count(*) >= 15))")
    merged = MERGED.rsplit("\nSELECT cp.doc_id", 1)[0]
    near = _boundary("x")
    mk = near.split("mk AS (", 1)[1]
    return out | {
        "boundary_x_nn": f"""WITH RECURSIVE {near.split("mk AS (", 1)[0]}
nn AS (SELECT p.page_key, f.g, lag(p.x) OVER nw AS px, lag(p.y) OVER nw AS py, p.x AS qx, p.y AS qy, row_number() OVER nw AS i FROM p JOIN rf f USING (page_key, ord) WINDOW nw AS (PARTITION BY p.page_key, f.g ORDER BY p.x0, p.ord)),
po AS (SELECT p.page_key, p.x, p.y, f.g AS og FROM p JOIN rf f USING (page_key, ord)),
ev AS (SELECT nn.page_key, nn.g, nn.i, count(po.og) > 0 AS e FROM nn LEFT JOIN po ON po.page_key = nn.page_key AND po.og <> nn.g AND sqrt((px - po.x) * (px - po.x) + (py - po.y) * (py - po.y)) < sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) * 0.5 AND abs(py - po.y) > abs(px - po.x) WHERE i > 1 GROUP BY 1, 2, 3),
en AS (SELECT page_key, g, count(*) FILTER (WHERE e) >= count(*) * 0.5 AS enough FROM ev GROUP BY 1, 2),
mk AS ({mk.replace("gt.t <= gt.gs[len(gt.gs)] AND gp.gap > gt.t AS p", "CASE WHEN gt.t <= gt.gs[len(gt.gs)] THEN gp.gap > gt.t ELSE gp.gap > 1 AND en.enough AND ev.e END AS p").replace("JOIN nr USING (page_key) WHERE", "JOIN nr USING (page_key) JOIN en USING (page_key, g) JOIN ev ON ev.page_key = gp.page_key AND ev.g = gp.g AND ev.i = gp.i WHERE")}
SELECT * FROM bc""",
        "catalogue_stats": f"""WITH RECURSIVE {catalogue},
{SENSED},
{BOUND},
{FACTS},
{RESULTS},
{merged},
pgt AS (SELECT *, page_key // 12 AS doc_id, CASE WHEN particles < 5 THEN 'empty' WHEN mapped >= 3 AND n_text > 20 THEN 'mixed' WHEN mapped >= 3 THEN 'technical' WHEN n_text > 15 THEN 'narrative' ELSE 'empty' END AS page_type FROM pr),
mf AS (SELECT cb.doc_id, un.base AS page, f.entity, f.spec FROM un JOIN cb USING (doc_id, base) JOIN facts f USING (page_key)
  UNION SELECT pgt.doc_id, (pgt.page_key % 12 + 1)::INT, f.entity, f.spec FROM pgt JOIN facts f USING (page_key) LEFT JOIN cb USING (page_key) LEFT JOIN un ON un.doc_id = cb.doc_id AND un.base = cb.base WHERE pgt.page_type <> 'empty' AND un.base IS NULL),
nd AS (SELECT doc_id, count(DISTINCT (page, entity)) AS nodes, count(*) AS properties FROM mf GROUP BY 1),
mv AS (SELECT cb.doc_id, count(*) AS merged_pages FROM cb JOIN un USING (doc_id, base) WHERE cb.page <> cb.base GROUP BY 1),
pg AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE page_type = 'technical') AS technical, count(*) FILTER (WHERE page_type = 'mixed') AS mixed, count(*) FILTER (WHERE page_type = 'narrative') AS narrative, count(*) FILTER (WHERE page_type = 'empty') AS empty, sum(mapped)::BIGINT AS mapped, sum(unmapped)::BIGINT AS unmapped FROM pgt GROUP BY 1)
SELECT pg.*, coalesce(nodes, 0) AS nodes, coalesce(properties, 0) AS properties, coalesce(merged_pages, 0) AS merged_pages FROM pg LEFT JOIN nd USING (doc_id) LEFT JOIN mv USING (doc_id)""",
        "spanning_cells": f"""{cells},
pc AS (SELECT cl.page_key, cl.r::INT AS row, cl.c::INT AS col, coalesce(tx.text, '') AS text FROM cl LEFT JOIN tx ON tx.page_key = cl.page_key AND tx.r = cl.r AND tx.c = cl.c),
s1 AS (SELECT *, trim(text) = '' AND coalesce(trim(lag(text) OVER cw) <> '', false) AS follows, trim(text) = '' OR regexp_matches(replace(trim(text), '.', ''), '^[0-9]+$') AS loose, regexp_matches(lower(text), 'total|average|subtotal|sum|mean|median') AS reaches FROM pc WINDOW cw AS (PARTITION BY page_key, row ORDER BY col)),
s2 AS (SELECT *, coalesce(lead(follows) OVER cw, false) AS empty, loose AND NOT follows AND (coalesce(lag(reaches) OVER cw, false) OR (coalesce(lag(follows) OVER cw, false) AND coalesce(lag(reaches, 2) OVER cw, false))) AS taken FROM s1 WINDOW cw AS (PARTITION BY page_key, row ORDER BY col)),
s3 AS (SELECT *, CASE WHEN empty THEN coalesce(lead(taken, 2) OVER cw, false) ELSE coalesce(lead(taken) OVER cw, false) END AND reaches AS more FROM s2 WINDOW cw AS (PARTITION BY page_key, row ORDER BY col))
SELECT page_key, row, array_to_string(range(col, col + 1 + empty::INT + more::INT), ',') AS cols, text FROM s3 WHERE NOT follows AND NOT taken""",
        "cross_page": f"{results},\n{MERGED}",
        "rag_chunks": f"{results},\n{CHUNKS}",
        "bounded_bonds": f"{zoned} SELECT page_key, ord, spec, heading FROM bonds",
        "bond_compare": f"WITH a AS ({facts} {places}), b AS ({zoned},\n{FACTS} {places}) SELECT page_key, count(*) FILTER (WHERE a.f = b.f) AS same, count(*) FILTER (WHERE a.f <> b.f) AS different, count(*) FILTER (WHERE b.f IS NULL) AS only_a, count(*) FILTER (WHERE a.f IS NULL) AS only_b FROM a FULL JOIN b USING (page_key, kx, ky) GROUP BY page_key",
    }
