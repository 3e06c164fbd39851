"""The registered queries in DuckDB's SQL, built from common table expressions that say each step anew over rows."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import vocabulary as V

#: Fixed values, said here once more so that a wrong constant of the engine shows: units, attraction by type, and what the
#: rendered pages print.
UNITS = (
    "kw", "db(a)", "dba", "mm", "kg", "l", "l/h", "m3/h", "m³/h", "m", "inch", "a", "v", "hz", "mm²", "mm2", "°c", "w", "%", "ø", "pa", "hp", "m³/min", "m3/min", "hz/v", "°cbs", "°cbu",
    "-", "- / kg", "rpm", "bar", "kwh", "kw/h", "mpa", "cfm", "btu/h", "kcal/h", "g/h", "ml/h",
)
BASE_UNITS = ("kw", "w", "db", "db(a)", "dba", "kg", "mm", "v", "a", "hz", "kpa", "pa", "kwh", "l/h", "m³/h", "m3/h", "rpm", "l/s", "btu/h", "kbtu/h", "kcal/h", "mpa", "bar", "°c", "l")
ATTRACTION = {"SPEC_LABEL": 1.0, "SIZE_HEADER": 0.8, "MODEL": 0.6, "KW_HEADER": 0.8, "UNIT": 0.7, "NUMERIC": 0.3, "TEXT": -0.1, "SECTION": 0.0}
GRID = (("Quantity", "l_quantity", 0, None), ("Price", "l_extendedprice", 2, None), ("Discount", "l_discount", 2, "%"), ("Tax", "l_tax", 2, None))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items: Iterable[str]) -> str:
    return "(" + ", ".join(map(_q, items)) + ")"


def _any(text: str, patterns: Iterable[str], flags: str = "") -> str:
    patterns = tuple(patterns)
    return f"regexp_matches({text}, {_q(flags + '|'.join(f'(?:{p})' for p in patterns))})" if patterns else "false"


def _fixed(value: str, decimals: int) -> str:
    if not decimals:
        return f"round({value})::BIGINT::VARCHAR"
    cents = f"abs(round({value} * 100))::BIGINT"
    return f"(({cents} // 100)::VARCHAR || '.' || lpad(({cents} % 100)::VARCHAR, 2, '0'))"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _brand(text: str, brand: str, kind: str) -> str:
    return f"({_any(text, V.BRANDS[brand][kind])} OR {_any(text, V.BRANDS[brand][kind + '_any_case'], '(?i)')})"


def _type(text: str, domain: bool, brands: bool | tuple[str, ...]) -> str:
    t = _strip(f"coalesce({text}, '')")
    tl = rf"regexp_replace(lower({t}), '\.+$', '')"
    dense = rf"regexp_replace({tl}, '\s', '', 'g')"
    rules = [f"WHEN {t} = '' OR {_any(t, V.EXCLUDED, '(?i)')} THEN 'TEXT'"]
    if domain:
        if brands:
            rules += [f"WHEN {' OR '.join(_brand(t, b, k) for b in (V.BRANDS if brands is True else brands))} THEN '{n}'" for k, n in (("size", "SIZE_HEADER"), ("model", "MODEL"))]
        rules.append(rf"WHEN regexp_matches({t}, '^\d+[.,]?\d*\s*kW$') THEN 'KW_HEADER'")
    rules += [
        f"WHEN {_strip(tl)} IN {_list(UNITS)} THEN 'UNIT'",
        rf"WHEN regexp_matches({t}, '^\(\d{{1,2}}\)$') THEN 'TEXT'",
        rf"WHEN regexp_matches({dense}, '^[\d.,/\-()x×°%~+:]+$') AND regexp_matches({dense}, '\d') THEN 'NUMERIC'",
        rf"WHEN regexp_matches(replace({t}, ',', ''), '^[\d.]+x[\d.]+x[\d.]+$') THEN 'NUMERIC'",
        rf"WHEN regexp_matches({t}, '^-?\d+~|^\d+N?~/|^R\d{{3}}') THEN 'NUMERIC'",
    ]
    if domain:
        has = lambda words: rf"list_has_any(regexp_split_to_array({tl}, '\s+'), [{', '.join(map(_q, words))}])"
        rules += [f"WHEN {has(V.SECTION_WORDS)} AND length({t}) > 8 THEN 'SECTION'", f"WHEN {has(V.LABEL_WORDS)} THEN 'SPEC_LABEL'", f"WHEN length({t}) > 12 AND {_any(tl, V.LABEL_PARTS)} THEN 'SPEC_LABEL'"]
    return f"CASE {' '.join(rules)} ELSE 'TEXT' END"


def _z(text: str) -> str:
    v = rf"abs(try_cast(replace(regexp_extract(replace(coalesce({text}, ''), ' ', ''), '[-+]?\d+[.,]?\d*'), ',', '.') AS DOUBLE))"
    return f"CASE WHEN {v} < 0.001 THEN 0.0 ELSE log10({v} + 1) END"


CODES = """codes AS (
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'RAS-' || p_size || 'FSXNME' WHEN 1 THEN 'ftxm' || lpad(p_size::VARCHAR, 2, '0') || 'R'
    WHEN 2 THEN 'RAV-GM' || lpad(p_size::VARCHAR, 2, '0') || '1KRTP-E' WHEN 3 THEN 'MSZ-AP' || lpad(p_size::VARCHAR, 2, '0') || 'VGK'
    WHEN 4 THEN 'MHA-V' || p_size || 'W' ELSE p_name END AS code
  FROM part)"""

SAMPLES = f"""{CODES}, s AS (
  SELECT p_partkey, unnest(range(len(l)))::INT AS k, unnest(l) AS text FROM (
    SELECT p_partkey, [p_name, code, p_size || ' kW', '(' || p_size || ')', '(1' || p_size || ')', {_fixed('p_retailprice', 2)}, p_size || 'x840x' || p_size,
      '-' || p_size || '~43', 'R4' || lpad(p_size::VARCHAR, 2, '0') || 'A', p_size || 'N~/50/380', 'pag. ' || p_size, p_size || 'B', 'www.' || p_type,
      '[Dati] peso ' || p_size, '°C.', '-', 'dB(A)', 'Specifications', 'COP', 'sound pressure level', 'Condizionamento', '3,14', '  ', '0', 'm', '%', 'hp', 'dB', 'kPa', 'l/s', 'kBTU/h'] AS l
    FROM part JOIN codes USING (p_partkey)))"""


def _words() -> str:
    rows = ["SELECT l_orderkey AS page_key, 0 AS ord, 'Order ' || l_orderkey AS text, 30.0 AS x0, 10.0 AS y0, 16.0 AS size, NULL::INT AS row_idx, NULL::INT AS col_idx FROM li WHERE r = 1"]
    rows += [f"SELECT l_orderkey, {k + 1}, '{name}', {150 + 100 * k}, 44, 10, NULL, NULL FROM li WHERE r = 1" for k, (name, _, _, _) in enumerate(GRID)]
    y = "94 + 30 * (r - 1)"
    rows.append(f"SELECT l_orderkey, 5 + 6 * (r - 1), 'Line ' || r, 30, {y}, 10, r - 1, NULL FROM li")
    for k, (_, column, decimals, unit) in enumerate(GRID):
        rows.append(f"SELECT l_orderkey, {6 + k + (k > 2)} + 6 * (r - 1), {_fixed(column, decimals)}, {150 + 100 * k}, {y}, 10, r - 1, {k} FROM li")
        if unit:
            rows.append(f"SELECT l_orderkey, {7 + k} + 6 * (r - 1), '{unit}', {190 + 100 * k}, {y}, 10, r - 1, NULL FROM li")
    return f"""li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem),
w AS (SELECT page_key, ord::INT AS ord, text, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + 6 * length(text))::DOUBLE AS x1, (y0 + greatest(12.0, size))::DOUBLE AS y1, size::DOUBLE AS size, row_idx::INT AS row_idx, col_idx::INT AS col_idx
  FROM ({' UNION ALL '.join(rows)}))"""


PARTICLES = f"""{_words()},
p AS MATERIALIZED (SELECT page_key, ord, text, x0, y0, x1, y1, size, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, {_type('text', False, False)} AS type FROM w)"""


def _spacing(name: str, source: str, value: str, default: float) -> str:
    """name(page_key, v): usual distance of distinct rounded places."""
    return f"""{name}_d AS (SELECT DISTINCT page_key, round_even({value}, 0) AS v FROM {source}),
{name}_g AS (SELECT page_key, v - lag(v) OVER (PARTITION BY page_key ORDER BY v) AS g FROM {name}_d),
{name}_l AS (SELECT page_key, count(*) AS n, list_sort(list(g) FILTER (WHERE g IS NOT NULL)) AS gs FROM {name}_g GROUP BY page_key),
{name} AS (SELECT page_key, CASE WHEN n < 3 THEN {default} ELSE coalesce(list_median(list_filter(gs, lambda g: g > 0 AND g < gs[len(gs) // 2 + 1] * 2.5)), {default}) END AS v FROM {name}_l)"""


def _threshold(name: str, source: str, keys: str) -> str:
    """source(keys, gs: sorted list) -> name(keys, t)."""
    return f"""{name}_r AS (SELECT *, list_transform(range(1, len(gs)), lambda i: CASE WHEN gs[i] > 0 THEN gs[i + 1] / gs[i] ELSE 0.0 END) AS rs FROM {source}),
{name}_b AS (SELECT *, list_max(rs) AS best, list_position(rs, list_max(rs)) AS pos FROM {name}_r),
{name} AS (SELECT {keys}, gs, CASE WHEN len(gs) = 0 THEN 10.0 WHEN len(gs) < 3 THEN list_median(gs) WHEN best >= 1.5 THEN (gs[pos] + gs[pos + 1]) / 2 ELSE gs[len(gs)] + 1 END AS t FROM {name}_b)"""


def _fold(name: str, source: str, value: str, tolerance: str) -> str:
    """Greedy groups by running means of source(page_key, ord, tol, ...) in order of a value: name(page_key, ord, g)."""
    return f"""{name}_i AS (SELECT page_key, ord, {value} AS v, {tolerance} AS tol, row_number() OVER (PARTITION BY page_key ORDER BY {value}, ord) AS k FROM {source}),
{name}_f AS (
  SELECT page_key, 0::BIGINT AS k, []::DOUBLE[] AS s, []::INT[] AS n, NULL::INT AS ord, NULL::INT AS g FROM (SELECT DISTINCT page_key FROM {name}_i)
  UNION ALL
  SELECT page_key, k, CASE WHEN pos = 0 THEN list_append(s, v) ELSE list_transform(range(1, len(s) + 1), lambda j: CASE WHEN j = pos THEN s[j] + v ELSE s[j] END) END,
    CASE WHEN pos = 0 THEN list_append(n, 1) ELSE list_transform(range(1, len(n) + 1), lambda j: CASE WHEN j = pos THEN n[j] + 1 ELSE n[j] END) END,
    ord, (CASE WHEN pos = 0 THEN len(s) ELSE pos - 1 END)::INT
  FROM (SELECT f.page_key, i.k, f.s, f.n, i.v, i.ord, coalesce(list_position(list_transform(range(1, len(f.s) + 1), lambda j: abs(f.s[j] / f.n[j] - i.v) < i.tol), true), 0) AS pos
    FROM {name}_f f JOIN {name}_i i ON i.page_key = f.page_key AND i.k = f.k + 1)),
{name} AS (SELECT page_key, ord, g FROM {name}_f WHERE ord IS NOT NULL)"""


SPACINGS = ",\n".join([_spacing("rs", "(SELECT * FROM p WHERE type = 'NUMERIC')", "y0", 15.0), _spacing("ra", "p", "y0", 15.0), _spacing("ca", "p", "x0", 30.0)])
ROWS = f"{SPACINGS},\n" + _fold("rf", "(SELECT p.*, greatest(4.0, ra.v * 0.5) AS rt FROM p JOIN ra USING (page_key))", "y0", "rt")
COLS = f"{SPACINGS},\n" + _fold("cf", "(SELECT p.*, greatest(8.0, ca.v * 0.5) AS ct FROM p JOIN ca USING (page_key))", "x0", "ct")

#: Columns of typed particles, on pages of five particles or more.
COLUMNS = (
    _fold("df", "(SELECT * FROM p WHERE type IN ('NUMERIC', 'SPEC_LABEL', 'MODEL', 'MODEL_CODE', 'UNIT', 'SECTION', 'SIZE_HEADER', 'KW_HEADER'))", "x", "15.0")
    + """,
dc0 AS (SELECT df.page_key, g, sum(x ORDER BY x, ord) / count(*) AS x, min(y0) AS y_min, max(y0) AS y_max, count(*)::INT AS count, count(DISTINCT round_even(y0, 0)) AS lines
  FROM df JOIN p USING (page_key, ord) GROUP BY df.page_key, g),
dc AS (SELECT page_key, x, y_min, y_max, count FROM dc0 WHERE count >= 3 AND lines >= 2)"""
)


def _greedy(name: str, seeds: str, candidates: str) -> str:
    """Seeds(page_key, k from 1) take in turn their best candidate not yet taken; candidates(page_key, k, ord, score):
    highest score, then lowest ord. name(page_key, ord)."""
    return f"""{name}_c AS (SELECT page_key, k, list(ord ORDER BY score DESC, ord) AS os FROM ({candidates}) GROUP BY page_key, k),
{name}_s AS (SELECT s.page_key, s.k, coalesce(c.os, []::INT[]) AS os FROM ({seeds}) s LEFT JOIN {name}_c c ON c.page_key = s.page_key AND c.k = s.k),
{name}_f AS (
  SELECT page_key, 0::BIGINT AS k, []::INT[] AS taken FROM (SELECT DISTINCT page_key FROM {name}_s)
  UNION ALL
  SELECT f.page_key, s.k, CASE WHEN len(list_filter(s.os, lambda o: NOT list_contains(f.taken, o))) > 0 THEN list_append(f.taken, list_filter(s.os, lambda o: NOT list_contains(f.taken, o))[1]) ELSE f.taken END
  FROM {name}_f f JOIN {name}_s s ON s.page_key = f.page_key AND s.k = f.k + 1),
{name}_l AS (SELECT page_key, arg_max(taken, k) AS taken FROM {name}_f GROUP BY page_key),
{name} AS (SELECT page_key, unnest(taken) AS ord FROM {name}_l)"""


SENSED = ",\n".join(
    [
        SPACINGS,
        COLUMNS,
        "dck AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY x, y_min, y_max, count) AS k FROM dc)",
        _greedy("hd", "SELECT page_key, k FROM dck", "SELECT c.page_key, c.k, t.ord, t.y0 AS score FROM dck c JOIN p t ON t.page_key = c.page_key AND t.type = 'TEXT' AND t.y0 < c.y_min AND c.y_min - t.y0 < 60 AND abs(t.x - c.x) < 30"),
        "p1 AS (SELECT p.* REPLACE (CASE WHEN hd.ord IS NOT NULL THEN 'MODEL' ELSE type END AS type) FROM p LEFT JOIN hd USING (page_key, ord))",
        "tb AS (SELECT page_key, min(y_min) AS low, max(y_max) AS high, min(x) AS first FROM dc GROUP BY page_key)",
        _fold("lf", "(SELECT p1.* FROM p1 JOIN tb USING (page_key) WHERE type = 'TEXT' AND x0 < first - 15.0 AND y0 >= low - 20 AND y0 <= high + 20)", "x0", "12.0"),
        """lg AS (SELECT page_key, g, count(*) AS n FROM lf GROUP BY page_key, g HAVING count(*) >= 3),
lb AS (SELECT page_key, arg_max(g, (n, -g)) AS g FROM lg GROUP BY page_key),
p2 AS (SELECT p1.* REPLACE (CASE WHEN lb.g IS NOT NULL THEN 'SPEC_LABEL' ELSE type END AS type) FROM p1 LEFT JOIN lf USING (page_key, ord) LEFT JOIN lb ON lb.page_key = lf.page_key AND lb.g = lf.g),
st AS (SELECT page_key, greatest(5.0, least(coalesce(rs.v, 15.0) * 0.6, 25.0)) AS tol FROM (SELECT DISTINCT page_key FROM p2) LEFT JOIN rs USING (page_key)),
nk AS (SELECT page_key, ord, x0, y0, row_number() OVER (PARTITION BY page_key ORDER BY ord) AS k FROM p2 WHERE type = 'NUMERIC')""",
        _greedy("sp", "SELECT page_key, k FROM nk", "SELECT n.page_key, n.k, t.ord, t.x1 AS score FROM nk n JOIN st USING (page_key) JOIN p2 t ON t.page_key = n.page_key AND t.type = 'TEXT' AND abs(t.y0 - n.y0) < st.tol AND t.x1 < n.x0 AND n.x0 - t.x1 < 300"),
        """spn AS (SELECT page_key FROM sp GROUP BY page_key HAVING count(*) >= 2),
p3 AS (SELECT p2.* REPLACE (CASE WHEN sp.ord IS NOT NULL AND spn.page_key IS NOT NULL THEN 'SPEC_LABEL' ELSE type END AS type) FROM p2 LEFT JOIN sp USING (page_key, ord) LEFT JOIN spn USING (page_key)),
fm AS (SELECT page_key, median(size) AS m FROM p WHERE size > 0 GROUP BY page_key HAVING count(*) >= 5),
p4 AS (SELECT p3.* REPLACE (CASE WHEN type = 'TEXT' AND size > m * 1.3 AND length(text) > 3 AND length(text) < 60 THEN 'SECTION' ELSE type END AS type) FROM p3 LEFT JOIN fm USING (page_key)),
pt AS (SELECT page_key, greatest(12.0, coalesce(rs.v, 15.0) * 0.7) AS tol FROM (SELECT DISTINCT page_key FROM p4) LEFT JOIN rs USING (page_key)),
lone AS (SELECT n.page_key, n.ord FROM p4 n JOIN pt USING (page_key) WHERE n.type = 'NUMERIC'
  AND NOT EXISTS (SELECT 1 FROM dc c WHERE c.page_key = n.page_key AND abs(n.x - c.x) < 20)
  AND NOT EXISTS (SELECT 1 FROM p4 s JOIN pt q ON q.page_key = s.page_key WHERE s.page_key = n.page_key AND s.type = 'SPEC_LABEL' AND abs(s.y0 - n.y0) < q.tol)
  AND NOT EXISTS (SELECT 1 FROM p4 m JOIN pt q ON q.page_key = m.page_key WHERE m.page_key = n.page_key AND m.type = 'NUMERIC' AND m.ord <> n.ord AND abs(m.y0 - n.y0) < q.tol)),
orphan AS (SELECT u.page_key, u.ord FROM p4 u WHERE u.type = 'UNIT' AND EXISTS (SELECT 1 FROM p4 m WHERE m.page_key = u.page_key AND m.type = 'NUMERIC')
  AND NOT EXISTS (SELECT 1 FROM p4 m JOIN pt q ON q.page_key = m.page_key WHERE m.page_key = u.page_key AND m.type = 'NUMERIC' AND abs(m.y0 - u.y0) < q.tol)),
wrong AS (SELECT * FROM lone UNION SELECT * FROM orphan),
sensed AS (SELECT p4.* REPLACE (CASE WHEN wrong.ord IS NOT NULL THEN 'TEXT' ELSE type END AS type) FROM p4 LEFT JOIN wrong USING (page_key, ord))""",
    ]
)


def _attraction(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {w}::DOUBLE" for k, w in ATTRACTION.items()) + " ELSE 0.0 END"


def _phi(axis: str, weight: str, sigma: str, dz: str = "0.0") -> str:
    off, before = ("(n.y - o.y)", "o.x < n.x") if axis == "row" else ("(n.x - o.x)", "o.y < n.y")
    return f"{weight} * exp(-({off} * {off}) / ({sigma} * {sigma})) * CASE WHEN {before} THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END / pow(greatest(sqrt((n.x - o.x) * (n.x - o.x) + (n.y - o.y) * (n.y - o.y) + ({dz}) * ({dz})), 1.0), 0.5)"


#: On these pages labels are never close enough to be merged: their lines are 30 apart.
BOUND = f"""num AS (SELECT *, {_z('text')} AS z, row_number() OVER (PARTITION BY page_key ORDER BY ord) AS k FROM sensed WHERE type = 'NUMERIC'),
yg AS (SELECT page_key, y - lag(y) OVER (PARTITION BY page_key ORDER BY y) AS g FROM num),
xg AS (SELECT page_key, x - lag(x) OVER (PARTITION BY page_key, round_even(y / 10, 0) ORDER BY x) AS g FROM num),
ygl AS (SELECT page_key, list_sort(list(g) FILTER (WHERE g > 3 AND g < 50)) AS gs FROM yg GROUP BY page_key),
xgl AS (SELECT page_key, list_sort(list(g) FILTER (WHERE g > 10 AND g < 150)) AS gs FROM xg GROUP BY page_key),
ncount AS (SELECT page_key, count(*) FILTER (WHERE type = 'NUMERIC') AS n, count(*) FILTER (WHERE type IN ('SPEC_LABEL', 'MODEL', 'SIZE_HEADER', 'KW_HEADER')) AS anchors FROM sensed GROUP BY page_key),
sig AS (SELECT ncount.page_key, n, anchors, CASE WHEN n < 3 THEN 6.0::DOUBLE ELSE greatest(4.0, least(coalesce(ygl.gs[len(ygl.gs) // 2 + 1] * 0.6, 6.0), 20.0)) END AS sigma_y,
  CASE WHEN n < 3 THEN 30.0::DOUBLE ELSE greatest(15.0, least(coalesce(xgl.gs[len(xgl.gs) // 2 + 1] * 0.5, 30.0), 60.0)) END AS sigma_x
  FROM ncount LEFT JOIN ygl USING (page_key) LEFT JOIN xgl USING (page_key)),
zl AS (SELECT num.page_key, list_sort(list(z)) AS zs FROM num JOIN sig USING (page_key) WHERE z IS NOT NULL GROUP BY num.page_key, round_even(y / (sigma_y * 2), 0) HAVING count(*) >= 3),
zi AS (SELECT page_key, zs[3 * len(zs) // 4 + 1] - zs[len(zs) // 4 + 1] AS iqr FROM zl),
zm AS (SELECT page_key, list_sort(list(iqr)) AS gs FROM zi WHERE iqr > 0.01 AND iqr < 2.0 GROUP BY page_key),
par AS (SELECT sig.*, CASE WHEN zm.gs IS NULL THEN 50.0::DOUBLE ELSE greatest(10.0, least(sigma_y / zm.gs[len(zm.gs) // 2 + 1], 500.0)) END AS lambda_z FROM sig LEFT JOIN zm USING (page_key)),
sz AS (SELECT s.page_key, s.ord, list_sort(list(n.z)) AS zs FROM sensed s JOIN par USING (page_key) JOIN num n ON n.page_key = s.page_key AND n.z IS NOT NULL AND n.y >= s.y - par.sigma_y * 3 AND n.y <= s.y + par.sigma_y * 3 WHERE s.type = 'SPEC_LABEL' GROUP BY s.page_key, s.ord),
spec AS (SELECT s.*, sz.zs[len(sz.zs) // 2 + 1] AS z FROM sensed s LEFT JOIN sz USING (page_key, ord) WHERE s.type = 'SPEC_LABEL'),
ok AS (SELECT * FROM par WHERE n >= 2 AND anchors > 0),
bs AS (SELECT n.page_key, n.ord, o.ord AS o, o.text, {_phi('row', '1.0::DOUBLE', 'ok.sigma_y', 'coalesce(ok.lambda_z * (n.z - o.z), 0.0)')} AS phi FROM num n JOIN ok USING (page_key) JOIN spec o ON o.page_key = n.page_key),
bh AS (SELECT n.page_key, n.ord, o.ord AS o, o.text, {_phi('col', f"({_attraction('o.type')})", 'ok.sigma_x')} AS phi FROM num n JOIN ok USING (page_key) JOIN sensed o ON o.page_key = n.page_key AND o.type IN ('MODEL', 'SIZE_HEADER', 'KW_HEADER')),
bu AS (SELECT n.page_key, n.ord, o.ord AS o, o.text, {_phi('row', '0.7::DOUBLE', 'ok.sigma_y')} AS phi FROM num n JOIN ok USING (page_key) JOIN sensed o ON o.page_key = n.page_key AND o.type = 'UNIT'),
rks AS (SELECT *, row_number() OVER (PARTITION BY page_key, ord ORDER BY phi DESC, o) AS rk FROM bs WHERE phi > 0),
rkh AS (SELECT *, row_number() OVER (PARTITION BY page_key, ord ORDER BY phi DESC, o) AS rk FROM bh WHERE phi > 0),
rku AS (SELECT *, row_number() OVER (PARTITION BY page_key, ord ORDER BY phi DESC, o) AS rk FROM bu WHERE phi > 0),
bonds AS (SELECT n.page_key, n.ord, n.k, n.text AS value, n.x, n.y, s.text AS spec, h.text AS heading, u.text AS unit, s.phi AS phi_spec, h.phi AS phi_col, u.phi AS phi_unit, s2.phi AS second_spec, h2.phi AS second_col
  FROM num n JOIN ok USING (page_key) LEFT JOIN rks s ON s.page_key = n.page_key AND s.ord = n.ord AND s.rk = 1 LEFT JOIN rkh h ON h.page_key = n.page_key AND h.ord = n.ord AND h.rk = 1 LEFT JOIN rku u ON u.page_key = n.page_key AND u.ord = n.ord AND u.rk = 1
  LEFT JOIN rks s2 ON s2.page_key = n.page_key AND s2.ord = n.ord AND s2.rk = 2 LEFT JOIN rkh h2 ON h2.page_key = n.page_key AND h2.ord = n.ord AND h2.rk = 2)"""

FACTS = """fi AS (SELECT *, coalesce(heading, 'UNKNOWN') AS entity, row_number() OVER (PARTITION BY page_key, coalesce(heading, 'UNKNOWN'), spec ORDER BY k) AS nth FROM bonds WHERE spec IS NOT NULL),
ff AS (
  SELECT page_key, entity, spec, nth, value, unit, x, y, round(phi_spec, 4) AS phi_spec, round(coalesce(phi_col, 0.0), 4) AS phi_col FROM fi WHERE nth = 1
  UNION ALL
  SELECT f.page_key, f.entity, f.spec, i.nth, CASE WHEN i.phi_spec > f.phi_spec THEN i.value ELSE f.value END, CASE WHEN i.phi_spec > f.phi_spec THEN i.unit ELSE f.unit END,
    CASE WHEN i.phi_spec > f.phi_spec THEN i.x ELSE f.x END, CASE WHEN i.phi_spec > f.phi_spec THEN i.y ELSE f.y END,
    CASE WHEN i.phi_spec > f.phi_spec THEN round(i.phi_spec, 4) ELSE f.phi_spec END, CASE WHEN i.phi_spec > f.phi_spec THEN round(coalesce(i.phi_col, 0.0), 4) ELSE f.phi_col END
  FROM ff f JOIN fi i ON i.page_key = f.page_key AND i.entity = f.entity AND i.spec = f.spec AND i.nth = f.nth + 1),
fl AS (SELECT page_key, entity, spec, arg_max(struct_pack(value := value, unit := unit, x := x, y := y, phi_spec := phi_spec, phi_col := phi_col), nth) AS f FROM ff GROUP BY page_key, entity, spec),
fk AS (SELECT page_key, entity, spec, min(k) AS k FROM fi GROUP BY page_key, entity, spec),
fe AS (SELECT page_key, entity, min(k) AS ek FROM fi GROUP BY page_key, entity),
facts AS MATERIALIZED (SELECT fl.page_key, fl.entity, (dense_rank() OVER (PARTITION BY fl.page_key ORDER BY ek) - 1)::INT AS entity_ord, fl.spec, (row_number() OVER (PARTITION BY fl.page_key ORDER BY fk.k) - 1)::INT AS spec_ord,
  f.value, f.unit, f.x, f.y, f.phi_spec, f.phi_col FROM fl JOIN fk USING (page_key, entity, spec) JOIN fe USING (page_key, entity))"""

RESULTS = """pr AS MATERIALIZED (SELECT c.page_key, c.particles, c.n_text, c.n_data, coalesce(b.mapped, 0) AS mapped, coalesce(b.unmapped, 0) AS unmapped, coalesce(f.entities, 0) AS entities, coalesce(f.total_specs, 0) AS total_specs
  FROM (SELECT page_key, count(*) AS particles, count(*) FILTER (WHERE type IN ('TEXT', 'SECTION')) AS n_text, count(*) FILTER (WHERE type IN ('NUMERIC', 'UNIT')) AS n_data FROM sensed GROUP BY page_key) c
  LEFT JOIN (SELECT page_key, count(spec) AS mapped, count(*) - count(spec) AS unmapped FROM bonds GROUP BY page_key) b USING (page_key)
  LEFT JOIN (SELECT page_key, count(DISTINCT entity) AS entities, count(*) AS total_specs FROM facts GROUP BY page_key) f USING (page_key))"""

#: Particles of values and labels alone, beside the truth.
BODY = PARTICLES.replace("AS type FROM w)", "AS type FROM w WHERE ord > 4)")


def _gaps(group: str, axis: str) -> str:
    """Steps of lines (of columns): gp(page_key, g, i, gap, pos, a, b, left, right) and their lines gl(page_key, g, gs, size)."""
    low, high = f"{axis}0", f"{axis}1"
    return f"""gp0 AS (SELECT p.*, f.g, row_number() OVER lw AS i, lag({high}) OVER lw AS prev, lag({axis}) OVER lw AS prev_c, count(*) OVER (PARTITION BY p.page_key, f.g) AS size
  FROM p JOIN {group} f USING (page_key, ord) WINDOW lw AS (PARTITION BY p.page_key, f.g ORDER BY {low}, ord)),
gp AS (SELECT page_key, g, size, i, {low} - prev AS gap, (prev + {low}) / 2 AS pos, prev AS l, {low} AS r, prev_c AS a, {axis} AS b FROM gp0 WHERE size >= 2 AND i > 1),
gl AS (SELECT page_key, g, any_value(size) AS size, coalesce(list_sort(list(gap) FILTER (WHERE gap > 0)), []::DOUBLE[]) AS gs FROM gp GROUP BY page_key, g)"""


def _boundary(axis: str) -> str:
    group, chain = ("rf", ROWS) if axis == "x" else ("cf", COLS)
    near = (lambda c: f"least(3, greatest(0, ceil(({c} - 190) / 100 - 0.5)))") if axis == "x" else (lambda c: f"least(n_rows - 1, greatest(0, ceil(({c} - 104) / 30.0 - 0.5)))")
    least = "true" if axis == "x" else "n_rows >= 2"
    return f"""{BODY},
{chain},
{_gaps(group, axis)},
gt0 AS (SELECT * FROM gl WHERE len(gs) >= 3),
{_threshold('gt', 'gt0', 'page_key, g')},
nr AS (SELECT l_orderkey AS page_key, count(*) AS n_rows FROM lineitem GROUP BY 1),
mk AS (SELECT gp.page_key, {near('gp.a')} <> {near('gp.b')} AS t, gt.t <= gt.gs[len(gt.gs)] AND gp.gap > gt.t AS p FROM gp JOIN gt USING (page_key, g) JOIN nr USING (page_key) WHERE {least}),
bc AS (SELECT page_key, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) AS total FROM mk GROUP BY page_key)"""


def _ratio_votes(k: str = "0.3") -> str:
    return f"""{_gaps('rf', 'x')},
wd AS (SELECT p.page_key, f.g, avg(x1 - x0) AS m FROM p JOIN rf f USING (page_key, ord) GROUP BY p.page_key, f.g),
vt AS (SELECT gp.page_key, gp.g, any_value(gp.size) AS size, count(*) FILTER (WHERE gap > m * {k}) + 1 AS n, list(pos ORDER BY i) FILTER (WHERE gap > m * {k}) AS cuts FROM gp JOIN wd USING (page_key, g) GROUP BY gp.page_key, gp.g),
vc AS (SELECT page_key, n, count(*) AS c, min(g) AS first FROM vt GROUP BY page_key, n),
md AS (SELECT page_key, arg_max(n, (c, -first)) AS n, max(c) AS c, sum(c) AS votes, max(n) AS most FROM vc GROUP BY page_key)"""


CRYSTAL = (
    """cg AS (SELECT page_key, x - lag(x) OVER cw AS g, (x + lag(x) OVER cw) / 2 AS pos, count(*) OVER (PARTITION BY page_key) AS n FROM p WINDOW cw AS (PARTITION BY page_key ORDER BY x)),
cgl AS (SELECT page_key, list_sort(list(g)) AS gs FROM cg WHERE g > 0.5 AND n >= 4 GROUP BY page_key HAVING count(*) >= 3),
"""
    + _threshold("ct", "cgl", "page_key")
    + """,
cry AS (SELECT cg.page_key, cg.pos FROM cg JOIN ct USING (page_key) WHERE cg.g > 0.5 AND cg.g > ct.t)"""
)

def _cuts(name: str, target: str = "md.n") -> str:
    """The boundaries of the largest line that voted for the target."""
    return f"{name} AS (SELECT vt.page_key, arg_max(cuts, (size, -g)) AS cuts FROM vt JOIN md ON md.page_key = vt.page_key AND {target} = vt.n WHERE {target} > 1 GROUP BY vt.page_key)"


def _row_votes(method: str) -> str:
    """On columns by ratio: rl(page_key, cuts), the boundaries between rows."""
    base = f"""{_ratio_votes()},
{_cuts('bl')},
cs AS (SELECT p.*, len(list_filter(coalesce(bl.cuts, []::DOUBLE[]), lambda s: p.x > s)) AS c FROM p LEFT JOIN bl USING (page_key)),
hg0 AS (SELECT *, y0 - lag(y1) OVER hw AS gap, (lag(y1) OVER hw + y0) / 2 AS mid, count(*) OVER (PARTITION BY page_key, c) AS csize FROM cs WINDOW hw AS (PARTITION BY page_key, c ORDER BY y0, ord)),
hh AS (SELECT page_key, c, greatest(3.0, least(avg(y1 - y0) FILTER (WHERE y1 > y0), 30.0)) * 0.1 AS t FROM cs GROUP BY page_key, c),
hg AS (SELECT hg0.*, hh.t FROM hg0 JOIN hh USING (page_key, c) WHERE csize >= 2)"""
    if method == "consensus":
        return f"""{base},
act AS (SELECT page_key, count(DISTINCT c) AS n FROM hg GROUP BY page_key HAVING count(DISTINCT c) >= 2),
mp AS (SELECT hg.page_key, mid, c, ord, act.n, mid - lag(mid) OVER (PARTITION BY hg.page_key ORDER BY mid, c, ord) AS step, greatest(3.0, ra.v * 0.4) AS tol FROM hg JOIN act USING (page_key) JOIN ra USING (page_key) WHERE gap > t),
mr AS (SELECT *, sum(CASE WHEN step < tol THEN 0 ELSE 1 END) OVER (PARTITION BY page_key ORDER BY mid, c, ord ROWS UNBOUNDED PRECEDING) AS run FROM mp),
rs1 AS (SELECT page_key, run, avg(mid) AS split FROM mr GROUP BY page_key, run, n HAVING count(*) >= greatest(2, floor(n * 0.4)))"""
    if method == "natural":
        votes = f"""kl AS (SELECT page_key, c, any_value(csize) AS csize, list_sort(coalesce(list(gap) FILTER (WHERE gap > 0.5), []::DOUBLE[])) AS gs FROM hg GROUP BY page_key, c),
{_threshold('kt', 'kl', 'page_key, c, csize')},
rv AS (SELECT hg.page_key, hg.c, any_value(hg.csize) AS csize, count(*) FILTER (WHERE gap > 0.5 AND gap > kt.t AND len(kt.gs) >= 2) + 1 AS n, list(mid ORDER BY y0, ord) FILTER (WHERE gap > 0.5 AND gap > kt.t AND len(kt.gs) >= 2) AS cuts FROM hg JOIN kt USING (page_key, c) GROUP BY hg.page_key, hg.c)"""
    else:
        votes = "rv AS (SELECT page_key, c, any_value(csize) AS csize, count(*) FILTER (WHERE gap > t) + 1 AS n, list(mid ORDER BY y0, ord) FILTER (WHERE gap > t) AS cuts FROM hg GROUP BY page_key, c)"
    return f"""{base},
{votes},
rvc AS (SELECT page_key, n, count(*) AS k, min(c) AS first FROM rv GROUP BY page_key, n),
rm AS (SELECT page_key, arg_max(n, (k, -first)) AS n FROM rvc GROUP BY page_key),
rl AS (SELECT rv.page_key, arg_max(cuts, (csize, -c)) AS cuts FROM rv JOIN rm ON rm.page_key = rv.page_key AND rm.n = rv.n WHERE rm.n > 1 GROUP BY rv.page_key)"""


#: Particles with their row r and column c.
CELLS = """rr0 AS (SELECT cs.*, CASE WHEN rl.cuts IS NULL THEN rf.g ELSE len(list_filter(rl.cuts, lambda s: cs.y0 > s)) END AS r0, CASE WHEN rl.cuts IS NULL THEN cs.y0 ELSE 0 END AS o0 FROM cs LEFT JOIN rl USING (page_key) JOIN rf USING (page_key, ord)),
rr AS (SELECT *, dense_rank() OVER (PARTITION BY page_key ORDER BY r0) - 1 AS r FROM rr0)"""

RECEIPTS = (
    f"""rw AS (
  SELECT o_orderkey AS page_key, unnest(range(10))::INT AS ord, unnest(['Customer', c_name, 'Balance', {_fixed('c_acctbal', 2)}, 'Date', strftime(o_orderdate, '%Y-%m-%d'), 'Status', o_orderstatus, 'TOTAL', {_fixed('o_totalprice', 2)}]) AS text
  FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT page_key, ord, text, (CASE WHEN ord % 2 = 0 THEN 40 ELSE 200 END)::DOUBLE AS x0, (50 + 20 * (ord // 2))::DOUBLE AS y0, (CASE WHEN ord % 2 = 0 THEN 40 ELSE 200 END + 6 * length(text))::DOUBLE AS x1, (62 + 20 * (ord // 2))::DOUBLE AS y1, 12.0::DOUBLE AS size,
  (ord // 2)::INT AS line_idx, (1 - ord % 2)::INT AS is_key, ['menu.nm', 'menu.price', 'date', 'sub_total.count', 'total.total_price'][ord // 2 + 1] AS category FROM rw),
p AS MATERIALIZED (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, {_type('text', False, False)} AS type FROM w)"""
)
PLACES = """pl0 AS (SELECT page_key, round(x, 1) AS px, round(y, 1) AS py, max((entity, spec, value)) AS f FROM facts GROUP BY 1, 2, 3),
pl AS (SELECT page_key, px, py, f[1] AS entity, f[2] AS spec, f[3] AS value FROM pl0),
wp AS (SELECT *, round(x, 1) AS px, round(y, 1) AS py, split_part(category, '.', 1) AS label FROM p)"""

ACCURACY = """ba0 AS (SELECT page_key, entity, spec, spec_ord, CASE WHEN x >= 140 AND x <= 540 THEN greatest(0, least(3, ceil((x - 240) / 100)))::INT ELSE -1 END AS c, CASE WHEN y >= 89 AND y <= 89 + 30 * n THEN greatest(0, least(n - 1, ceil((y - 119) / 30.0)))::INT ELSE -1 END AS r
  FROM facts JOIN (SELECT l_orderkey AS page_key, count(*) AS n FROM lineitem GROUP BY 1) USING (page_key)),
ec AS (SELECT page_key, entity, c, count(*) AS k, min(spec_ord) AS first FROM ba0 WHERE c >= 0 GROUP BY 1, 2, 3),
em AS (SELECT page_key, entity, arg_max(c, (k, -first)) AS c FROM ec GROUP BY 1, 2),
sr AS (SELECT page_key, spec, r, count(*) AS k, min(spec_ord) AS first FROM ba0 WHERE r >= 0 GROUP BY 1, 2, 3),
sm AS (SELECT page_key, spec, arg_max(r, (k, -first)) AS r FROM sr GROUP BY 1, 2),
ba AS (SELECT ba0.page_key, count(*) AS n, count(*) FILTER (WHERE ba0.c >= 0 AND em.c = ba0.c) AS co, count(*) FILTER (WHERE ba0.r >= 0 AND sm.r = ba0.r) AS ro, count(*) FILTER (WHERE ba0.c >= 0 AND em.c = ba0.c AND ba0.r >= 0 AND sm.r = ba0.r) AS ce
  FROM ba0 LEFT JOIN em USING (page_key, entity) LEFT JOIN sm USING (page_key, spec) GROUP BY ba0.page_key)"""


def sql() -> dict[str, str]:
    grid = f"WITH RECURSIVE {PARTICLES}"
    sensed = f"{grid},\n{SENSED}"
    bound = f"{sensed},\n{BOUND}"
    facts = f"{bound},\n{FACTS}"
    results = f"{facts},\n{RESULTS}"
    rows = f"{grid},\n{ROWS}"
    out = {
        "typify": f"WITH {SAMPLES} SELECT p_partkey, k, text, {_type('text', True, True)} AS type, {_type('text', False, False)} AS plain_type FROM s",
        "typify_base": rf"WITH {SAMPLES}, u AS (SELECT p_partkey, k, {_strip('text')} AS t, regexp_replace(lower({_strip('text')}), '\.+$', '') AS tl FROM s) SELECT p_partkey, k, CASE WHEN tl IN {_list(BASE_UNITS)} THEN 'UNIT' WHEN regexp_matches(regexp_replace(tl, '\s', '', 'g'), '^[\d.,/\-()x×°%~+:]+$') AND regexp_matches(tl, '\d') OR regexp_matches(t, '^R\d{{3}}') THEN 'NUMERIC' ELSE 'TEXT' END AS type FROM u",
        "z_norm": f"WITH {SAMPLES} SELECT p_partkey, k, round({_z('text')}, 6) AS z FROM s",
        "brand_detect": f"WITH {CODES} SELECT p_partkey, code, CASE {' '.join(f'WHEN {_brand("code", b, "model")} OR {_brand("code", b, "size")} THEN {_q(b)}' for b in V.BRANDS)} END AS brand FROM codes",
        "node_type": f"WITH {CODES} SELECT p_partkey, CASE {' '.join(f'WHEN regexp_matches(code, {_q(r)}) THEN {_q(t)}' for r, t in V.NODE_TYPES)} ELSE 'product_unit' END AS node_type FROM codes",
        "section_strip": rf"WITH {SAMPLES} SELECT p_partkey, k, CASE WHEN regexp_matches(text, '^\[([^\]]*)\]\s*(.*)') THEN trim(regexp_extract(text, '^\[([^\]]*)\]\s*(.*)', 1)) ELSE '' END AS section, CASE WHEN regexp_matches(text, '^\[([^\]]*)\]\s*(.*)') THEN trim(regexp_extract(text, '^\[([^\]]*)\]\s*(.*)', 2)) ELSE trim(text) END AS label FROM s",
        "normalise": rf"WITH {SAMPLES} SELECT p_partkey, k, trim(regexp_replace(lower(text), '[^\pL\pN_\s.]', '', 'g')) AS normalised FROM s",
        "page_words": f"WITH {_words()} SELECT * FROM w",
        "particle_types": f"{grid} SELECT type, count(*) AS n FROM p GROUP BY type",
        "natural_threshold": f"WITH g AS (SELECT l_orderkey AS page_key, list_sort(list(l_quantity)) AS gs FROM lineitem GROUP BY 1), {_threshold('t', 'g', 'page_key')} SELECT page_key, t AS threshold FROM t",
        "spacings": f"{grid}, {SPACINGS}, pd AS (SELECT DISTINCT page_key, round(y0, 1) AS v FROM p), pg AS (SELECT page_key, v - lag(v) OVER (PARTITION BY page_key ORDER BY v) AS g FROM pd), pm AS (SELECT page_key, coalesce(median(g) FILTER (WHERE g > 1.0), 10.0) AS v FROM pg GROUP BY page_key) SELECT page_key, coalesce(rs.v, 15.0) AS rows, ra.v AS rows_all, ca.v AS cols_all, pm.v AS rows_plain FROM ra JOIN ca USING (page_key) JOIN pm USING (page_key) LEFT JOIN rs USING (page_key)",
        "crystal": f"{grid}, {CRYSTAL} SELECT page_key, pos AS boundary FROM cry",
        "page_params": f"{bound} SELECT page_key, round(sigma_y, 6) AS sigma_y, round(sigma_x, 6) AS sigma_x, round(lambda_z, 6) AS lambda_z FROM par",
        "rows_fold": f"{rows} SELECT page_key, ord, g FROM rf",
        "cols_fold": f"{grid}, {COLS} SELECT page_key, ord, g FROM cf",
        "detected_columns": f"{grid}, {COLUMNS} SELECT page_key, round(x, 6) AS x, y_min, y_max, count FROM dc",
        "sensed_types": f"{sensed} SELECT page_key, ord, text, type FROM sensed",
        "sensing_counts": f"{sensed} SELECT page_key, count(DISTINCT dc.x) FILTER (WHERE dc.x IS NOT NULL)::INT AS columns, coalesce(any_value(h.n), 0)::INT AS headers, coalesce(any_value(l.n), 0)::INT AS row_labels, coalesce(any_value(s.n), 0)::INT AS specs, coalesce(any_value(e.n), 0)::INT AS sections, coalesce(any_value(x.n), 0)::INT AS proofread FROM (SELECT DISTINCT page_key FROM p) LEFT JOIN dc USING (page_key) LEFT JOIN (SELECT page_key, count(*) AS n FROM hd GROUP BY 1) h USING (page_key) LEFT JOIN (SELECT lf.page_key, count(*) AS n FROM lf JOIN lb ON lb.page_key = lf.page_key AND lb.g = lf.g GROUP BY 1) l USING (page_key) LEFT JOIN (SELECT page_key, count(*) AS n FROM sp JOIN spn USING (page_key) GROUP BY 1) s USING (page_key) LEFT JOIN (SELECT page_key, count(*) AS n FROM p4 WHERE type = 'SECTION' GROUP BY 1) e USING (page_key) LEFT JOIN (SELECT page_key, count(*) AS n FROM wrong GROUP BY 1) x USING (page_key) GROUP BY page_key",
        "phi_bonds": f"{bound} SELECT page_key, ord, value, spec, heading, unit, round(phi_spec, 4) AS phi_spec, round(phi_col, 4) AS phi_col, round(phi_unit, 4) AS phi_unit FROM bonds",
        "facts": f"{facts} SELECT page_key, entity, entity_ord, spec, spec_ord, value, unit, phi_spec, phi_col FROM facts",
        "unmapped": f"{bound} SELECT page_key, ord, value FROM bonds WHERE spec IS NULL",
        "confidence_top2": f"{bound} SELECT page_key, ord, spec, heading, round(1 - coalesce(second_spec, 0.0) / phi_spec, 4) AS conf_row, round(1 - coalesce(second_col, 0.0) / phi_col, 4) AS conf_col FROM bonds WHERE phi_spec > 0 AND phi_col > 0",
        "page_class": f"{results} SELECT page_key, CASE WHEN particles < 5 THEN 'empty' WHEN mapped >= 3 AND n_text > 20 THEN 'mixed' WHEN mapped >= 3 THEN 'technical' WHEN n_text > 15 THEN 'narrative' ELSE 'empty' END AS page_type, mapped::INT AS mapped, unmapped::INT AS unmapped, entities::INT AS entities, total_specs::INT AS total_specs, n_text::INT AS n_text, n_data::INT AS n_data FROM pr",
        "health": f"{results}, hn AS (SELECT page_key, count(*) AS numeric FROM num GROUP BY 1), hc AS (SELECT coalesce(numeric, 0) AS numeric, mapped FROM pr LEFT JOIN hn USING (page_key)) SELECT CASE WHEN numeric < 3 THEN 'SKIP' WHEN mapped / numeric > 0.6 THEN 'GREEN' WHEN mapped / numeric > 0.3 THEN 'YELLOW' WHEN mapped / numeric > 0.1 THEN 'ORANGE' ELSE 'RED' END AS colour, count(*) AS pages, sum(numeric)::BIGINT AS numeric, sum(mapped)::BIGINT AS mapped FROM hc GROUP BY 1",
        "fingerprints": f"{bound}, hh AS (SELECT page_key, arg_min(type, ord) AS col_type, array_to_string(list_sort(list(DISTINCT text)), ',') AS labels FROM sensed JOIN ok USING (page_key) WHERE type IN ('MODEL', 'SIZE_HEADER', 'KW_HEADER') GROUP BY page_key) SELECT ncount.page_key, col_type, labels FROM ncount LEFT JOIN hh USING (page_key)",
        "graph_nodes": f"{facts}, en AS (SELECT page_key, entity_ord, entity, count(*) AS n FROM facts GROUP BY 1, 2, 3) SELECT 'hitachi.product_unit_' || lpad((row_number() OVER (ORDER BY page_key, entity_ord) - 1)::VARCHAR, greatest(4, length((row_number() OVER (ORDER BY page_key, entity_ord) - 1)::VARCHAR))::INT, '0') AS id, 'product_unit' AS type, entity AS name, n AS n_properties, page_key FROM en",
        "sql_rows": f"{facts} SELECT entity AS model, spec AS header, value, coalesce(unit, '') AS unit, page_key AS page, '' AS section FROM facts",
        "boundary_x": f"WITH RECURSIVE {_boundary('x')} SELECT * FROM bc",
        "boundary_y": f"WITH RECURSIVE {_boundary('y')} SELECT * FROM bc",
        "col_splits_ratio": f"{rows}, {_ratio_votes()}, bl AS (SELECT vt.page_key, arg_max(cuts, (size, -g)) AS cuts FROM vt JOIN md ON md.page_key = vt.page_key AND md.n = vt.n WHERE md.n > 1 GROUP BY vt.page_key) SELECT page_key, unnest(cuts) AS split FROM bl",
        "col_splits_max_crystal": f"{rows}, {_ratio_votes()}, {CRYSTAL}, bl AS (SELECT vt.page_key, arg_max(cuts, (size, -g)) AS cuts FROM vt JOIN md ON md.page_key = vt.page_key AND md.most = vt.n WHERE md.most > 1 GROUP BY vt.page_key), rs2 AS (SELECT page_key, list(pos ORDER BY pos) AS cuts FROM cry JOIN md USING (page_key) WHERE most <= 1 GROUP BY page_key HAVING count(*) <= 20) SELECT page_key, unnest(cuts) AS split FROM (SELECT * FROM bl UNION ALL SELECT * FROM rs2)",
        "col_splits_ratio_crystal": f"{rows}, {_ratio_votes()}, {CRYSTAL}, bl AS (SELECT vt.page_key, arg_max(cuts, (size, -g)) AS cuts FROM vt JOIN md ON md.page_key = vt.page_key AND md.n = vt.n WHERE md.n > 1 GROUP BY vt.page_key), rs2 AS (SELECT page_key, list(pos ORDER BY pos) AS cuts FROM cry JOIN md USING (page_key) WHERE md.n <= 1 GROUP BY page_key HAVING count(*) <= 20) SELECT page_key, unnest(cuts) AS split FROM (SELECT * FROM bl UNION ALL SELECT * FROM rs2)",
        "col_splits_adaptive_crystal": f"{rows}, {_ratio_votes()}, {CRYSTAL}, tg AS (SELECT md.page_key, CASE WHEN md.c / md.votes >= 0.7 THEN md.n ELSE coalesce(max(vc.n) FILTER (WHERE vc.n > md.n AND vc.c >= 2), md.most) END AS n FROM md JOIN vc USING (page_key) GROUP BY md.page_key, md.n, md.c, md.votes, md.most), bl AS (SELECT vt.page_key, arg_max(cuts, (size, -g)) AS cuts FROM vt JOIN tg ON tg.page_key = vt.page_key AND tg.n = vt.n WHERE tg.n > 1 GROUP BY vt.page_key), rs2 AS (SELECT page_key, list(pos ORDER BY pos) AS cuts FROM cry JOIN tg USING (page_key) WHERE tg.n <= 1 GROUP BY page_key HAVING count(*) <= 20) SELECT page_key, unnest(cuts) AS split FROM (SELECT * FROM bl UNION ALL SELECT * FROM rs2)",
        "col_splits_natural": f"{rows}, {_gaps('rf', 'x')}, {CRYSTAL}, {_threshold('gt', 'gl', 'page_key, g')}, nj AS (SELECT page_key, g, CASE WHEN len(gs) >= 3 AND t <= gs[len(gs)] THEN t END AS t FROM gt), ng AS (SELECT gp.*, CASE WHEN nj.t IS NULL THEN EXISTS (SELECT 1 FROM cry WHERE cry.page_key = gp.page_key AND gp.l < cry.pos AND cry.pos < gp.r) ELSE gap > nj.t END AS cut FROM gp JOIN nj USING (page_key, g)), vt AS (SELECT page_key, g, any_value(size) AS size, count(*) FILTER (WHERE cut) + 1 AS n, list(pos ORDER BY i) FILTER (WHERE cut) AS cuts FROM ng GROUP BY page_key, g), vc AS (SELECT page_key, n, count(*) AS c, min(g) AS first FROM vt GROUP BY page_key, n), md AS (SELECT page_key, arg_max(n, (c, -first)) AS n FROM vc GROUP BY page_key), bl AS (SELECT vt.page_key, arg_max(cuts, (size, -g)) AS cuts FROM vt JOIN md ON md.page_key = vt.page_key AND md.n = vt.n WHERE md.n > 1 GROUP BY vt.page_key) SELECT page_key, unnest(cuts) AS split FROM bl",
        "type_distribution": f"{sensed} SELECT p.type AS was, s.type AS now, count(*) AS n FROM p JOIN sensed s USING (page_key, ord) GROUP BY 1, 2",
        "truth_cells": "WITH n AS (SELECT l_orderkey AS page_key, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT page_key, unnest(range(n)) AS r FROM n) SELECT page_key, r::VARCHAR AS row_nums, c AS col_nums FROM (SELECT page_key, r, unnest(CASE WHEN r = 0 THEN ['0,1', '2', '3'] ELSE ['0', '1', '2', '3'] END) AS c FROM c)",
        "iou": f"WITH {_words()}, b AS (SELECT *, greatest(0.0, least(x1, 240 + 100 * col_idx) - greatest(x0, 140 + 100 * col_idx)) * greatest(0.0, least(y1, 119 + 30 * row_idx) - greatest(y0, 89 + 30 * row_idx)) AS i, (x1 - x0) * (y1 - y0) + 3000.0 AS s FROM w WHERE col_idx IS NOT NULL) SELECT page_key, ord, round(i / (s - i), 6) AS iou FROM b",
        "conf_bins": f"{bound} SELECT least(9, floor(round(1 - coalesce(second_spec, 0.0) / phi_spec, 6) * 10))::INT AS bin, count(*) AS n, count(*) FILTER (WHERE spec = 'Line ' || (floor((y - 89) / 30) + 1)::INT) AS right FROM bonds WHERE phi_spec > 0 AND phi_col > 0 GROUP BY 1",
        "adjacency": f"""{grid}, pd AS (SELECT DISTINCT page_key, round(y0, 1) AS v FROM p), pg AS (SELECT page_key, v - lag(v) OVER (PARTITION BY page_key ORDER BY v) AS g FROM pd), pm AS (SELECT page_key, coalesce(median(g) FILTER (WHERE g > 1.0), 10.0) AS v FROM pg GROUP BY page_key),
{_fold('af', '(SELECT p.*, greatest(4.0, pm.v * 0.5) AS rt FROM p JOIN pm USING (page_key))', 'y0', 'rt')},
lr AS (SELECT p.page_key, p.ord, lag(p.ord) OVER (PARTITION BY p.page_key, g ORDER BY x0, p.ord) AS "left", lead(p.ord) OVER (PARTITION BY p.page_key, g ORDER BY x0, p.ord) AS "right" FROM p JOIN af USING (page_key, ord)),
ab AS (SELECT a.page_key, a.ord, arg_min(b.ord, (a.y0 - b.y0, -b.ord)) AS o FROM p a JOIN p b ON b.page_key = a.page_key AND a.y0 - b.y0 > 0 AND a.y0 - b.y0 <= 100 AND abs(a.x - b.x) < 30 GROUP BY 1, 2),
be AS (SELECT a.page_key, a.ord, arg_min(b.ord, (b.y0 - a.y0, b.ord)) AS o FROM p a JOIN p b ON b.page_key = a.page_key AND b.y0 - a.y0 > 0 AND b.y0 - a.y0 <= 100 AND abs(a.x - b.x) < 30 GROUP BY 1, 2)
SELECT lr.page_key, lr.ord, "left", "right", ab.o AS above, be.o AS below FROM lr LEFT JOIN ab USING (page_key, ord) LEFT JOIN be USING (page_key, ord)""",
    }
    body = f"WITH RECURSIVE {BODY},\n{ROWS}"
    receipts = f"WITH RECURSIVE {RECEIPTS},\n{SENSED},\n{BOUND},\n{FACTS},\n{PLACES}"
    crystal_x = _boundary("x").replace("mk AS (", f"{CRYSTAL},\nmk AS (").replace("gt.t <= gt.gs[len(gt.gs)] AND gp.gap > gt.t AS p", "CASE WHEN gt.t <= gt.gs[len(gt.gs)] THEN gp.gap > gt.t ELSE EXISTS (SELECT 1 FROM cry WHERE cry.page_key = gp.page_key AND gp.l < cry.pos AND cry.pos < gp.r) END AS p")
    y_only = _boundary("y")
    out |= {
        "boundary_x_crystal": f"WITH RECURSIVE {crystal_x} SELECT * FROM bc",
        "boundary_scores": f"WITH RECURSIVE {crystal_x}, t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn, sum(total)::BIGINT AS total FROM bc) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / total, 6) AS accuracy FROM t",
        "boundary_both": f"WITH bx AS (WITH RECURSIVE {_boundary('x')} SELECT * FROM bc), byy AS (WITH RECURSIVE {y_only} SELECT * FROM bc) SELECT page_key, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn, sum(total)::BIGINT AS total FROM (SELECT * FROM bx UNION ALL SELECT * FROM byy) GROUP BY page_key",
        "row_splits_fixed": f"{rows}, {_row_votes('fixed')} SELECT page_key, unnest(cuts) AS split FROM rl",
        "row_splits_natural": f"{rows}, {_row_votes('natural')} SELECT page_key, unnest(cuts) AS split FROM rl",
        "row_splits_consensus": f"{rows}, {_row_votes('consensus')} SELECT page_key, split FROM rs1",
        "pred_cells": f"{rows}, {_row_votes('fixed')}, {CELLS}, sz AS (SELECT rr.page_key, max(r) + 1 AS n_rows, any_value(len(coalesce(bl.cuts, []::DOUBLE[]))) + 1 AS n_cols FROM rr LEFT JOIN bl USING (page_key) GROUP BY rr.page_key), cl AS (SELECT page_key, r, unnest(range(n_cols)) AS c FROM (SELECT page_key, n_cols, unnest(range(n_rows)) AS r FROM sz)), tx AS (SELECT page_key, r, c, string_agg(text, ' ' ORDER BY o0, ord) AS text FROM rr GROUP BY page_key, r, c) SELECT cl.page_key, cl.r::INT AS row, cl.c::INT AS col, coalesce(tx.text, '') AS text FROM cl LEFT JOIN tx ON tx.page_key = cl.page_key AND tx.r = cl.r AND tx.c = cl.c",
        "structure_scores": f"{body}, {_row_votes('fixed')}, {CELLS}, sz AS (SELECT rr.page_key, max(r) + 1 AS pr, any_value(len(coalesce(bl.cuts, []::DOUBLE[]))) + 1 AS pc, max(n) AS gr FROM rr LEFT JOIN bl USING (page_key) JOIN (SELECT l_orderkey AS page_key, count(*) AS n FROM lineitem GROUP BY 1) USING (page_key) GROUP BY rr.page_key HAVING count(*) >= 3), sc AS (SELECT page_key, gr, pr, pc, least(gr, pr) * least(4, pc) / (pr * pc) AS pp, least(gr, pr) * least(4, pc) / (gr * 4) AS rec FROM sz) SELECT page_key, gr::INT AS gt_rows, 4 AS gt_cols, pr::INT AS pred_rows, pc::INT AS pred_cols, round(CASE WHEN pp + rec > 0 THEN 2 * pp * rec / (pp + rec) ELSE 0 END, 6) AS top, round(pp, 6) AS top_precision, round(rec, 6) AS top_recall, pc = 4 AS col_exact, pr = gr AS row_exact FROM sc",
        "bond_accuracy": f"{facts}, {ACCURACY}, mp2 AS (SELECT page_key, count(spec) AS m, count(*) AS n FROM bonds GROUP BY 1) SELECT s.page_key, coalesce(ba.n, 0)::INT AS n_bonds, round(coalesce(co / ba.n, 0), 6) AS col_acc, round(coalesce(ro / ba.n, 0), 6) AS row_acc, round(coalesce(ce / ba.n, 0), 6) AS cell_acc, round(CASE WHEN ba.n > 0 THEN mp2.m / mp2.n ELSE 0 END, 6) AS coverage FROM (SELECT DISTINCT page_key FROM p) s LEFT JOIN ba USING (page_key) LEFT JOIN mp2 USING (page_key)",
        "k_sweep": f"WITH RECURSIVE {BODY}, {ROWS}, {_gaps('rf', 'x')}, wd AS (SELECT p.page_key, f.g, avg(x1 - x0) AS m FROM p JOIN rf f USING (page_key, ord) GROUP BY p.page_key, f.g), ks AS (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5])::DOUBLE AS k), vt AS (SELECT gp.page_key, gp.g, ks.k, any_value(size) AS size, count(*) FILTER (WHERE gap > m * k) + 1 AS n FROM gp JOIN wd USING (page_key, g), ks GROUP BY gp.page_key, gp.g, ks.k), vc AS (SELECT page_key, k, n, count(*) AS c, min(g) AS first FROM vt GROUP BY page_key, k, n), md AS (SELECT page_key, k, arg_max(n, (c, -first)) AS n FROM vc GROUP BY page_key, k) SELECT k, count(*) AS pages, count(*) FILTER (WHERE n = 4) AS exact FROM md GROUP BY k",
        "text_page_types": f"WITH x AS (SELECT lang, unnest(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS text FROM documents), c AS (SELECT lang, text, count(*) AS n FROM x GROUP BY 1, 2) SELECT lang, {_type('text', True, False)} AS type, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2",
        "label_purity": f"{receipts} SELECT label, count(*) AS total, count(*) FILTER (WHERE wp.type = 'NUMERIC') AS numeric, count(pl.page_key) AS bonded FROM wp LEFT JOIN pl ON pl.page_key = wp.page_key AND pl.px = wp.px AND pl.py = wp.py GROUP BY label",
        "entity_purity": f"{receipts}, lc AS (SELECT facts.page_key, facts.entity, label, count(*) AS n FROM facts JOIN wp ON wp.page_key = facts.page_key AND wp.px = round(facts.x, 1) AND wp.py = round(facts.y, 1) GROUP BY 1, 2, 3), be AS (SELECT page_key, entity, max(n) AS best, sum(n) AS n FROM lc GROUP BY 1, 2) SELECT sum(best)::BIGINT AS correct, sum(n)::BIGINT AS total FROM be",
        "link_eval": f"{receipts}, nm AS (SELECT page_key, lower(text) AS name, list(DISTINCT ord) AS ids, max((is_key = 1)::INT) = 1 AS q FROM p GROUP BY 1, 2), lk AS (SELECT k.page_key, k.ord AS from_id, v.type = 'NUMERIC' AS numeric, pl.entity, pl.spec FROM wp k JOIN wp v ON v.page_key = k.page_key AND v.ord = k.ord + 1 LEFT JOIN pl ON pl.page_key = v.page_key AND pl.px = v.px AND pl.py = v.py WHERE k.is_key = 1) SELECT count(*) AS links, count(*) FILTER (WHERE spec IS NOT NULL AND (coalesce(e.q, false) OR coalesce(s.q, false))) AS spatial, count(*) FILTER (WHERE spec IS NOT NULL AND (coalesce(list_contains(e.ids, from_id), false) OR coalesce(list_contains(s.ids, from_id), false))) AS bond, count(*) FILTER (WHERE spec IS NULL AND NOT numeric) AS unreachable FROM lk LEFT JOIN nm e ON e.page_key = lk.page_key AND e.name = lower(lk.entity) LEFT JOIN nm s ON s.page_key = lk.page_key AND s.name = lower(lk.spec)",
        "field_presence": f"{receipts}, nw AS (SELECT wp.*, trim(regexp_replace(lower(text), '[^\\pL\\pN_\\s.]', '', 'g')) AS nt, pl.page_key IS NOT NULL AS bound FROM wp LEFT JOIN pl ON pl.page_key = wp.page_key AND pl.px = wp.px AND pl.py = wp.py), fv AS (SELECT page_key, CASE line_idx WHEN 0 THEN 'company' WHEN 2 THEN 'date' ELSE 'total' END AS field, nt AS v FROM nw WHERE is_key = 0 AND line_idx IN (0, 2, 4)), fm2 AS (SELECT fv.page_key, fv.field, count(*) AS matched, bool_or(nw.type = 'NUMERIC') AS reachable, bool_or(bound) AS present FROM fv JOIN nw ON nw.page_key = fv.page_key AND CASE fv.field WHEN 'total' THEN nw.nt = v WHEN 'date' THEN length(nw.nt) >= 4 AND (contains(v, nw.nt) OR contains(nw.nt, v)) ELSE length(nw.nt) >= 3 AND nw.nt = v END GROUP BY 1, 2) SELECT fv.field, count(*) AS receipts, sum(coalesce(matched, 0))::BIGINT AS matched, count(*) FILTER (WHERE reachable) AS reachable, count(*) FILTER (WHERE present) AS present FROM fv LEFT JOIN fm2 USING (page_key, field) GROUP BY 1",
        "column_counts": f"{rows}, {_ratio_votes()}, al AS (SELECT page_key, list_sort(list(gap)) AS gs FROM gp WHERE gap > 0 GROUP BY page_key), {_threshold('gg', 'al', 'page_key')}, {_threshold('lt', 'gl', 'page_key, g')}, ws AS (SELECT p.page_key, f.g, median(x1 - x0) FILTER (WHERE x1 > x0) AS mw FROM p JOIN rf f USING (page_key, ord) GROUP BY 1, 2), th AS (SELECT lt.page_key, lt.g, len(lt.gs) AS np, CASE WHEN len(lt.gs) >= 3 THEN CASE WHEN lt.t <= lt.gs[len(lt.gs)] THEN lt.t WHEN gg.t <= lt.gs[len(lt.gs)] THEN gg.t WHEN list_median(lt.gs) > coalesce(mw, 10.0) * 0.5 THEN lt.gs[1] - 0.1 ELSE lt.gs[len(lt.gs)] + 1 END ELSE gg.t END AS t FROM lt JOIN gg USING (page_key) JOIN ws USING (page_key, g)), mv AS (SELECT gp.page_key, gp.g, CASE WHEN any_value(np) = 0 THEN 1 ELSE count(*) FILTER (WHERE gap > th.t) + 1 END AS n FROM gp JOIN th USING (page_key, g) GROUP BY 1, 2), mc AS (SELECT page_key, n, count(*) AS c, min(g) AS first FROM mv GROUP BY 1, 2), mj AS (SELECT page_key, arg_max(n, (c, -first)) AS n FROM mc GROUP BY 1), tx0 AS (SELECT page_key, x, ord, CASE WHEN x - lag(x) OVER (PARTITION BY page_key ORDER BY x, ord) < 20 THEN 0 ELSE 1 END AS b FROM p WHERE type IN ('NUMERIC', 'SPEC_LABEL', 'MODEL', 'SIZE_HEADER', 'KW_HEADER', 'UNIT')), tx1 AS (SELECT page_key, sum(b) OVER (PARTITION BY page_key ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS run FROM tx0), tx2 AS (SELECT page_key, run, count(*) AS c FROM tx1 GROUP BY 1, 2), ty AS (SELECT page_key, count(*) FILTER (WHERE c >= 2) AS n FROM tx2 GROUP BY 1) SELECT md.page_key, md.n::INT AS ratio, mj.n::INT AS maxjump, coalesce(ty.n, 0)::INT AS typed FROM md JOIN mj USING (page_key) LEFT JOIN ty USING (page_key)",
    }
    out["row_counts"] = f"""{grid}, {COLS}, {_gaps('cf', 'y')}, al AS (SELECT page_key, list_sort(list(gap)) AS gs FROM gp WHERE gap > 0 GROUP BY page_key), {_threshold('gg', 'al', 'page_key')}, {_threshold('lt', 'gl', 'page_key, g')},
ws AS (SELECT p.page_key, f.g, median(y1 - y0) FILTER (WHERE y1 > y0) AS mh FROM p JOIN cf f USING (page_key, ord) GROUP BY 1, 2),
th AS (SELECT lt.page_key, lt.g, len(lt.gs) AS np, CASE WHEN len(lt.gs) >= 3 THEN CASE WHEN lt.t <= lt.gs[len(lt.gs)] THEN lt.t WHEN gg.t <= lt.gs[len(lt.gs)] THEN gg.t WHEN list_median(lt.gs) > coalesce(mh, 10.0) * 0.5 THEN lt.gs[1] - 0.1 ELSE lt.gs[len(lt.gs)] + 1 END ELSE gg.t END AS t FROM lt LEFT JOIN gg USING (page_key) JOIN ws USING (page_key, g)),
mv AS (SELECT gp.page_key, gp.g, CASE WHEN any_value(np) = 0 THEN 1 ELSE count(*) FILTER (WHERE gap > th.t) + 1 END AS n FROM gp JOIN th USING (page_key, g) GROUP BY 1, 2),
mc AS (SELECT page_key, n, count(*) AS c, min(g) AS first FROM mv GROUP BY 1, 2),
mj AS (SELECT page_key, arg_max(n, (c, -first)) AS n FROM mc GROUP BY 1),
yd AS (SELECT DISTINCT page_key, round(y, 1) AS v FROM p),
yb AS (SELECT page_key, CASE WHEN v - lag(v) OVER (PARTITION BY page_key ORDER BY v) < 8 THEN 0 ELSE 1 END AS b FROM yd),
pl AS (SELECT page_key, sum(b)::INT AS n FROM yb GROUP BY 1)
SELECT pl.page_key, coalesce(mj.n, 1)::INT AS maxjump, pl.n AS plain FROM pl LEFT JOIN mj USING (page_key)"""
    out["col_splits_maxjump"] = f"""{rows}, {_gaps('rf', 'x')}, al AS (SELECT page_key, list_sort(list(gap)) AS gs FROM gp WHERE gap > 0 GROUP BY page_key), {_threshold('gg', 'al', 'page_key')}, {_threshold('lt', 'gl', 'page_key, g')},
th AS (SELECT lt.page_key, lt.g, CASE WHEN len(lt.gs) >= 3 AND lt.t <= lt.gs[len(lt.gs)] THEN lt.t ELSE gg.t END AS t FROM lt JOIN gg USING (page_key) WHERE len(lt.gs) > 0),
tm AS (SELECT page_key, median(t) * 0.5 AS tol FROM th GROUP BY 1),
nl AS (SELECT page_key, count(DISTINCT g) AS n FROM rf GROUP BY 1),
bp AS (SELECT gp.page_key, gp.pos AS v, gp.g, gp.i FROM gp JOIN th USING (page_key, g) WHERE gap > 0 AND gap > th.t),
br AS (SELECT page_key, v, g, i, CASE WHEN v - lag(v) OVER (PARTITION BY page_key ORDER BY v, g, i) < tol THEN 0 ELSE 1 END AS b FROM bp JOIN tm USING (page_key)),
bn AS (SELECT page_key, v, sum(b) OVER (PARTITION BY page_key ORDER BY v, g, i ROWS UNBOUNDED PRECEDING) AS run FROM br)
SELECT page_key, median(v) AS split FROM bn JOIN nl USING (page_key) GROUP BY page_key, run, n HAVING count(*) >= greatest(2.0, n * 0.2)"""
    levels = f"""{receipts},
lv AS (SELECT v.page_key, v.line_idx, v.category, k.text AS key, v.text AS value, pl.entity, pl.spec, pl.value AS found FROM wp v JOIN wp k ON k.page_key = v.page_key AND k.line_idx = v.line_idx AND k.is_key = 1 LEFT JOIN pl ON pl.page_key = v.page_key AND pl.px = v.px AND pl.py = v.py WHERE v.is_key = 0),
on_line AS (SELECT DISTINCT page_key, lower(text) AS name, line_idx FROM p),
lj AS (SELECT lv.*, EXISTS (SELECT 1 FROM on_line o WHERE o.page_key = lv.page_key AND o.line_idx = lv.line_idx AND o.name IN (lower(lv.entity), lower(lv.spec))) AS spatial, spec IS NOT NULL AND (list_has_any(string_split(lower(key), ' '), string_split(lower(entity), ' ')) OR list_has_any(string_split(lower(key), ' '), string_split(lower(spec), ' '))) AS bond FROM lv),
le AS (SELECT category, count(*) AS lines, count(*) FILTER (WHERE spatial) AS spatial, count(spec) AS presence, count(*) FILTER (WHERE bond) AS bond, count(*) FILTER (WHERE bond AND trim(found) = value) AS value FROM lj GROUP BY category),
fp AS (SELECT count(*) AS lines FROM pl WHERE NOT EXISTS (SELECT 1 FROM wp WHERE wp.page_key = pl.page_key AND wp.px = pl.px AND wp.py = pl.py AND wp.is_key = 0))"""
    out |= {
        "receipt_levels": f"{levels} SELECT category, lines, spatial, presence, bond, value FROM le UNION ALL SELECT NULL, lines, 0, 0, 0, 0 FROM fp",
        "receipt_rollup": f"{levels}, lf2 AS (SELECT split_part(category, '.', 1) AS family, * FROM le) SELECT family, category, sum(lines)::BIGINT AS lines, sum(spatial)::BIGINT AS spatial, sum(presence)::BIGINT AS presence, sum(bond)::BIGINT AS bond, sum(value)::BIGINT AS value, round(sum(spatial) / sum(lines), 6) AS recall FROM lf2 GROUP BY ROLLUP (family, category)",
        "structure_strata": f"{out['structure_scores'].rsplit(' SELECT page_key, gr::INT', 1)[0]}, st2 AS (SELECT '4-6' AS size, CASE WHEN pp + rec > 0 THEN 2 * pp * rec / (pp + rec) ELSE 0 END AS top, pc = 4 AS ce, pr = gr AS re, pc FROM sc) SELECT size, count(*) AS pages, round(avg(top), 6) AS top, round(avg(ce::INT), 6) AS col_exact, round(avg(re::INT), 6) AS row_exact, count(*) FILTER (WHERE pc > 4) AS too_many, count(*) FILTER (WHERE pc < 4) AS too_few FROM st2 GROUP BY ROLLUP (size)",
    }
    return out
