"""DuckDB twins of the registered queries, written on their own from the definitions.

The cut engine's are in cut_oracles. Workbooks, pages and report lines have none; the tests read them back.
"""

from __future__ import annotations

from ..functions import catalog as C
from .fixtures import duck
from .queries import DAY_MS, PER_DAY

R6 = lambda x: f"floor(({x}) * 1e6 + 0.5e0) / 1e6"
M4 = lambda x: f"floor(({x}) * 1e4 + 0.50003e0) / 1e4"
SUM = lambda xs: f"list_reduce(list_prepend(0e0, {xs}), lambda a, b: a + b)"
NEXT = lambda p, i: f"{p}[({i} % len({p})) + 1]"
CROSS = lambda p: SUM(f"list_transform(range(1, len({p}) + 1), lambda i: {p}[i].x * {NEXT(p, 'i')}.y - {NEXT(p, 'i')}.x * {p}[i].y)")
AREA = lambda p: f"(CASE WHEN len({p}) < 3 THEN 0e0 ELSE abs({CROSS(p)} / 2e0) END)"
HYP = lambda a, b: f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"
PER = lambda p: SUM(f"list_transform(range(1, len({p}) + 1), lambda i: {HYP(f'{NEXT(p, chr(105))}.x - {p}[i].x', f'{NEXT(p, chr(105))}.y - {p}[i].y')})")
LOW = lambda p, a: f"list_min(list_transform({p}, lambda v: v.{a}))"
HIGH = lambda p, a: f"list_max(list_transform({p}, lambda v: v.{a}))"
INSIDE = lambda x, y, p: f"""(len(list_filter(range(1, len({p}) + 1), lambda i: ({p}[i].y > {y}) <> ({p}[(i + len({p}) - 2) % len({p}) + 1].y > {y})
    AND {x} < ({p}[(i + len({p}) - 2) % len({p}) + 1].x - {p}[i].x) * ({y} - {p}[i].y) / ({p}[(i + len({p}) - 2) % len({p}) + 1].y - {p}[i].y) + {p}[i].x)) % 2)"""  # noqa: E731
#: The most edges that a fixture room has; a room's corners as columns, null beyond its own, and the last one: many tiles are tested against them.
EDGES = 6
FLAT = ", ".join([*(f"points[{i}].x AS x{i}, points[{i}].y AS y{i}" for i in range(1, EDGES + 1)), "points[len(points)].x AS x0, points[len(points)].y AS y0"])
WITHIN = lambda x, y: "((" + " + ".join(f"CASE WHEN (y{i} > {y}) <> (y{i - 1} > {y}) AND {x} < (x{i - 1} - x{i}) * ({y} - y{i}) / (y{i - 1} - y{i}) + x{i} THEN 1 ELSE 0 END" for i in range(1, EDGES + 1)) + ") % 2)"
LINES = f"""sized AS (SELECT *, {AREA('points')} AS sf, {PER('points')} * wall_height AS wall_sf FROM rooms),
areas AS (SELECT b.project_id, b.material_id, sum(CASE WHEN type = 'wall' THEN wall_sf ELSE sf END) AS net_sf, CAST(count(*) AS BIGINT) AS n_rooms, string_agg(s.name, ', ' ORDER BY room_id) AS rooms
  FROM bridge b JOIN sized s USING (room_id) JOIN materials m USING (material_id) GROUP BY ALL),
lines AS (SELECT project_id, material_id, name AS material, type, pattern, waste, net_sf, net_sf * (1e0 + waste / 100e0) AS gross_sf, tw / 12e0 * (th / 12e0) * coalesce(face_coverage, 1e0) AS tile_sf, price, price_unit, sf_per_box FROM areas JOIN materials USING (material_id)),
priced AS (SELECT *, CAST(ceil(gross_sf / tile_sf) AS BIGINT) AS tiles, CASE price_unit WHEN 'tile' THEN ceil(gross_sf / tile_sf) WHEN 'box' THEN ceil(gross_sf / sf_per_box) ELSE gross_sf END AS qty FROM lines),
money AS (SELECT project_id, sum(qty * price) AS materials FROM priced GROUP BY 1),
floors AS (SELECT project_id, sum(sf) AS floor_sf FROM sized GROUP BY 1),
totals AS (SELECT project_id, p.name, coalesce(materials, 0e0) AS materials, coalesce(floor_sf, 0e0) AS floor_sf, scale, tax_rate, labor_rate_per_sf, coalesce(floor_sf, 0e0) * labor_rate_per_sf AS labor
  FROM projects p LEFT JOIN money USING (project_id) LEFT JOIN floors USING (project_id))"""
MAIN = duck("projects", "rooms", "materials", "bridge")
#: Half up at d digits with the epsilon, and a number as text.
RND = lambda x, d: f"(floor((({x}) + 2.220446049250313e-16) * 1e{d} + 0.5e0) / 1e{d})"
NUM = lambda x: f"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(38, 10)) AS VARCHAR), '0+$', ''), '[.]$', '')"


def _feet_inches(f: str) -> str:
    """Sixteenths counted as a whole number: another way to the same text."""
    feet = f"CAST(floor(abs({f}) + 1e-9) AS BIGINT)"
    sixteenths = f"(CAST(floor((abs({f}) - {feet}) * 12e0) AS BIGINT) * 16 + CAST(floor(((abs({f}) - {feet}) * 12e0 - floor((abs({f}) - {feet}) * 12e0)) * 16e0 + 0.5e0) AS BIGINT))"
    ft, s = f"({feet} + {sixteenths} // 192)", f"({sixteenths} % 192)"
    gcd = f"gcd({s} % 16, 16)"
    return f"""concat(CASE WHEN {f} < 0 THEN '-' ELSE '' END, {ft}, '''', CASE WHEN {s} <> 0 THEN concat('-', {s} // 16, CASE WHEN {s} % 16 <> 0 THEN concat(' ', ({s} % 16) // {gcd}, '/', 16 // {gcd}) ELSE '' END, '"') ELSE '' END)"""


def _length(f: str, system: str) -> str:
    return f"""CASE {system} WHEN 'imperial_ft_in' THEN {_feet_inches(f)} WHEN 'imperial_decft' THEN concat({NUM(RND(f, 3))}, ' ft') WHEN 'imperial_in' THEN concat({NUM(RND(f'{f} * 12e0', 2))}, ' in')
        WHEN 'metric_m' THEN concat({NUM(RND(f'{f} * 0.3048e0', 3))}, ' m') WHEN 'metric_cm' THEN concat({NUM(RND(f'{f} * 30.48e0', 1))}, ' cm') ELSE concat({NUM(RND(f'{f} * 304.8e0', 0))}, ' mm') END"""


def _area(sf: str, system: str) -> str:
    return f"CASE WHEN {system} LIKE 'metric%' THEN concat({NUM(RND(f'{sf} * 0.09290304e0', 2))}, ' m²') ELSE concat({NUM(RND(sf, 1))}, ' sf') END"


_TILES = f"""pairs AS (SELECT b.room_id, b.material_id, r.points, r.pattern AS p, r.origin_x AS ox, r.origin_y AS oy, (tw + grout) / 12e0 AS tw, (th + grout) / 12e0 AS th, {LOW('r.points', 'x')} AS bx0, {HIGH('r.points', 'x')} AS bx1, {LOW('r.points', 'y')} AS by0, {HIGH('r.points', 'y')} AS by1
  FROM bridge b JOIN rooms r USING (room_id) JOIN materials m USING (material_id)),
region AS (SELECT *, bx0 - 2e0 * greatest(tw, th) AS x0, by0 - 2e0 * greatest(tw, th) AS y0, bx1 + 2e0 * greatest(tw, th) AS x1, by1 + 2e0 * greatest(tw, th) AS y1, greatest(tw, th) AS lg, least(tw, th) AS sh FROM pairs),
grid AS (SELECT *, ox - ceil((ox - x0) / tw) * tw AS gx, oy - ceil((oy - y0) / th) * th AS gy FROM region WHERE p NOT IN ('herringbone', 'basketweave')),
gr AS (SELECT *, unnest(range(0, CAST(ceil((y1 - gy) / th) AS BIGINT) + 1)) AS r FROM grid),
gc AS (SELECT *, unnest(range(-1, CAST(ceil((x1 - gx) / tw) AS BIGINT) + 2)) AS c FROM gr),
hr AS (SELECT *, unnest(range(-1, CAST(ceil((y1 - y0) / (lg + sh)) AS BIGINT) + 3)) AS r FROM region WHERE p = 'herringbone'),
hc AS (SELECT *, unnest(range(-1, CAST(ceil((x1 - x0) / (lg + sh)) AS BIGINT) + 3)) AS c FROM hr),
hp AS (SELECT *, x0 + c * (lg + sh) + CASE WHEN r % 2 <> 0 THEN (lg + sh) / 2e0 ELSE 0e0 END AS ax, y0 + r * (lg + sh) AS ay FROM hc),
wr AS (SELECT *, unnest(range(0, CAST(ceil((y1 - y0) / (tw * 2e0)) AS BIGINT) + 2)) AS r FROM region WHERE p = 'basketweave'),
wc AS (SELECT *, unnest(range(0, CAST(ceil((x1 - x0) / (tw * 2e0)) AS BIGINT) + 2)) AS c FROM wr),
wp AS (SELECT *, x0 + c * (tw * 2e0) AS ax, y0 + r * (tw * 2e0) AS ay FROM wc),
tiles AS (
  SELECT room_id, material_id, r, c, 0 AS k, points, bx0, bx1, by0, by1, (gx + c * tw + CASE WHEN r % 2 = 0 THEN 0e0 WHEN p = 'brick_50' THEN 0.5e0 * tw WHEN p = 'brick_33' THEN (1e0 / 3e0) * tw ELSE 0e0 END) + tw / 2e0 AS cx, (gy + r * th) + th / 2e0 AS cy, tw AS w, th AS h FROM gc
  UNION ALL SELECT room_id, material_id, r, c, 0, points, bx0, bx1, by0, by1, ax + lg / 2e0, ay + sh / 2e0, lg, sh FROM hp
  UNION ALL SELECT room_id, material_id, r, c, 1, points, bx0, bx1, by0, by1, ax + lg + sh / 2e0, ay + sh + lg / 2e0, sh, lg FROM hp
  UNION ALL SELECT room_id, material_id, r, c, k, points, bx0, bx1, by0, by1, ax + tw / 2e0, ay + CASE k WHEN 0 THEN th / 4e0 ELSE (th * 3e0) / 4e0 END, tw, th / 2e0 FROM wp, (VALUES (0), (1)) AS k(k) WHERE (r + c) % 2 = 0
  UNION ALL SELECT room_id, material_id, r, c, k, points, bx0, bx1, by0, by1, ax + CASE k WHEN 0 THEN tw / 4e0 ELSE (tw * 3e0) / 4e0 END, ay + th / 2e0, tw / 2e0, th FROM wp, (VALUES (0), (1)) AS k(k) WHERE (r + c) % 2 = 1),
near AS (SELECT room_id, material_id, r, c, k, points, cx - w / 2e0 AS x, cy - h / 2e0 AS y, w, h, least(w, h) * 0.02e0 AS e FROM tiles WHERE cx - w / 2e0 <= bx1 AND cx - w / 2e0 + w >= bx0 AND cy - h / 2e0 <= by1 AND cy - h / 2e0 + h >= by0),
flat AS (SELECT room_id, {FLAT} FROM rooms),
counted AS (SELECT near.*, {WITHIN('x + e', 'y + e')} + {WITHIN('x + w - e', 'y + e')} + {WITHIN('x + w - e', 'y + h - e')} + {WITHIN('x + e', 'y + h - e')} AS n, {WITHIN('x + w / 2e0', 'y + h / 2e0')} AS mid FROM near JOIN flat USING (room_id)),
classed AS (SELECT *, CASE WHEN n = 4 THEN 'full' WHEN n > 0 OR mid = 1 THEN 'cut' ELSE 'out' END AS cls FROM counted)"""

_M = "(SELECT *, abs(points[2].x - points[1].x) AS dx, abs(points[2].y - points[1].y) AS dy FROM markups)"
_VALUE = f"""CASE type WHEN 'length' THEN {SUM(f"list_transform(range(2, len(points) + 1), lambda i: {HYP('points[i].x - points[i - 1].x', 'points[i].y - points[i - 1].y')})")}
    WHEN 'area' THEN {AREA('points')} WHEN 'rect' THEN dx * dy WHEN 'ellipse' THEN pi() * (dx / 2e0) * (dy / 2e0) WHEN 'count' THEN CAST(len(points) AS DOUBLE) ELSE 0e0 END"""
_MARKS = f"valued AS (SELECT *, {_VALUE} AS value FROM {_M} AS m)"
_UNIT = "CASE WHEN type = 'length' THEN 'lf' WHEN type IN ('area', 'rect', 'ellipse') THEN 'sf' WHEN type = 'count' THEN 'ea' ELSE '' END"
_DRAGS = """drags AS (SELECT markup_id AS drag_id, project_id, scale, (markup_id % 13) * 0.625e0 AS x0, (markup_id % 11) * 0.5e0 AS y0, (markup_id % 17) * 0.875e0 AS x1, (markup_id % 7) * 1.125e0 AS y1 FROM markups JOIN projects USING (project_id))"""
_STORED = "stored AS (SELECT c_custkey AS project_id, CAST(c_nationkey AS BIGINT) AS owner, c_name AS name, c_acctbal AS total_cost, c_custkey % 5 = 0 AS archived, (c_custkey * 7919) % 100003 AS updated_at FROM customer)"
_ASSIGNED = "assigned AS (SELECT room_id, list_sort(list(DISTINCT material_id)) AS a FROM bridge GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    out = {
        "project_estimate": f"""{MAIN}, {LINES}
SELECT project_id, name, {M4('materials')} AS materials, {M4('floor_sf')} AS floor_sf, {M4('CASE WHEN scale IS NOT NULL THEN floor_sf ELSE 0e0 END')} AS calibrated_sf, {M4('labor')} AS labor, {M4('materials + labor')} AS subtotal,
  {M4('(materials + labor) * tax_rate / 100e0')} AS tax, {M4('(materials + labor) + (materials + labor) * tax_rate / 100e0')} AS total FROM totals""",
        "material_areas": f"{MAIN}, {LINES} SELECT project_id, material_id, {R6('net_sf')} AS net_sf, n_rooms, rooms FROM areas",
        "estimate_lines": f"{MAIN}, {LINES} SELECT project_id, material_id, material, type, {R6('net_sf')} AS net_sf, {R6('gross_sf')} AS gross_sf, tiles, {R6('qty')} AS qty, CASE WHEN price_unit IN ('tile', 'box') THEN price_unit ELSE 'sf' END AS unit, {R6('qty * price')} AS cost FROM priced",
        "room_geometry": f"""{duck('rooms')} SELECT room_id, {AREA('points')} AS area, {R6(PER('points'))} AS perimeter, {CROSS('points')} / 2e0 AS signed_area, {LOW('points', 'x')} AS minx, {LOW('points', 'y')} AS miny, {HIGH('points', 'x')} AS maxx, {HIGH('points', 'y')} AS maxy,
  {HIGH('points', 'x')} - {LOW('points', 'x')} AS w, {HIGH('points', 'y')} - {LOW('points', 'y')} AS h, {R6("list_sum(list_transform(points, lambda v: v.x)) / len(points)")} AS cx, {R6("list_sum(list_transform(points, lambda v: v.y)) / len(points)")} AS cy FROM rooms""",
        "view_transform": f"""{duck('markups', 'projects')}, e AS (SELECT markup_id, scale, CASE WHEN abs(points[2].x - points[1].x) > abs(points[2].y - points[1].y) THEN points[2].x ELSE points[1].x END AS x, CASE WHEN abs(points[2].x - points[1].x) > abs(points[2].y - points[1].y) THEN points[1].y ELSE points[2].y END AS y FROM markups JOIN projects USING (project_id) WHERE len(points) >= 2),
s AS (SELECT *, CASE WHEN scale IS NULL THEN x ELSE x / scale END * 1.5e0 + 80e0 AS sx, CASE WHEN scale IS NULL THEN y ELSE y / scale END * 1.5e0 + 80e0 AS sy FROM e)
SELECT markup_id, {R6('sx')} AS sx, {R6('sy')} AS sy, {R6('CASE WHEN scale IS NULL THEN (sx - 80e0) / 1.5e0 ELSE (sx - 80e0) / 1.5e0 * scale END')} AS fx FROM s""",
        "unit_formats": f"{duck('rooms', 'projects')}, f AS (SELECT room_id, unit_system, {HIGH('points', 'x')} - {LOW('points', 'x')} + (room_id % 7) / 48e0 AS side, {AREA('points')} AS sf FROM rooms JOIN projects USING (project_id)) SELECT room_id, unit_system, {_length('side', 'unit_system')} AS length, {_area('sf', 'unit_system')} AS area FROM f",
        "unit_numbers": f"""WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS v, CASE o_orderkey % 6 WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 / 12e0 WHEN 2 THEN 3.280839895e0 WHEN 3 THEN 0.03280839895e0 WHEN 4 THEN 0.003280839895e0 ELSE 1e0 END AS f FROM orders)
SELECT o_orderkey, {R6('v * f')} AS feet, {R6('v / f')} AS back, {R6('v * 0.09290304e0')} AS sqm, {RND('v', 2)} AS rounded, floor((0e0 - v) * 100e0 + 0.5e0) / 100e0 AS negative, floor(v / 0.25e0 + 0.5e0) * 0.25e0 AS snapped, greatest(0e0, least(60e0, v - 60e0)) AS waste FROM o""",
        "unit_parse": f"""WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_orderkey % 4 AS s, CAST(o_orderkey % 40 + 1 AS VARCHAR) AS a, CAST(o_orderkey % 12 AS VARCHAR) AS b FROM orders),
t AS (SELECT o_orderkey, CASE k WHEN 0 THEN concat(a, '''', b, '"') WHEN 1 THEN concat(a, ''' ', b, ' 1/2"') WHEN 2 THEN concat(a, ' ft') WHEN 3 THEN concat(a, '.', b, 'm') WHEN 4 THEN concat(a, ' in') WHEN 5 THEN concat(a, 'mm') WHEN 6 THEN concat(a, '-', b) WHEN 7 THEN concat(a, '.5') WHEN 8 THEN 'abc' ELSE concat('-', a, '''-', b, '"') END AS text,
  CASE k WHEN 0 THEN CAST(a AS DOUBLE) + CAST(b AS DOUBLE) / 12e0 WHEN 1 THEN CAST(a AS DOUBLE) + (CAST(b AS DOUBLE) + 0.5e0) / 12e0 WHEN 2 THEN CAST(a AS DOUBLE) WHEN 3 THEN CAST(concat(a, '.', b) AS DOUBLE) * 3.280839895e0 WHEN 4 THEN CAST(a AS DOUBLE) / 12e0 WHEN 5 THEN CAST(a AS DOUBLE) * 0.003280839895e0
    WHEN 6 THEN CAST(a AS DOUBLE) + CAST(b AS DOUBLE) / 12e0 WHEN 7 THEN CAST(concat(a, '.5') AS DOUBLE) * CASE s WHEN 1 THEN 1e0 / 12e0 WHEN 2 THEN 3.280839895e0 WHEN 3 THEN 0.03280839895e0 ELSE 1e0 END WHEN 8 THEN NULL ELSE 0e0 - CAST(a AS DOUBLE) - CAST(b AS DOUBLE) / 12e0 END AS feet FROM o)
SELECT o_orderkey, text, {R6('feet')} AS feet FROM t""",
        "scales": f"""{duck('markups')}, s AS (SELECT markup_id, {C.case(f'markup_id % {len(C.SCALES) + len(C.METRIC_SCALES)}', [*C.SCALES, *C.METRIC_SCALES])} AS scale_id, points[2].x + abs(points[3].y) AS px FROM markups WHERE type = 'length')
SELECT markup_id, scale_id, {R6(f"coalesce({C.case('scale_id', {k: float(v) for k, v in C.SCALES.items()})}, {C.case('scale_id', C.METRIC_SCALES)} * 25.4e0 * 3.280839895e0) / 144e0")} AS preset, {R6('12e0 * CASE WHEN markup_id % 2 = 0 THEN 3.28084e0 ELSE 1e0 END / nullif(px, 0e0)')} AS ruler FROM s""",
        "text_functions": f"""WITH t AS (SELECT *, concat(CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '<' WHEN 2 THEN '"' ELSE '' END, p_name, CASE p_partkey % 3 WHEN 0 THEN ', & co' ELSE '' END) AS t FROM part),
u AS (SELECT *, CASE WHEN t[1] IN ('=', '+', '-', '@') THEN concat('''', t) ELSE t END AS s, CASE p_partkey % 8 {' '.join(f"WHEN {i} THEN 'rgba({int(c[1:3], 16)},{int(c[3:5], 16)},{int(c[5:7], 16)},0.5)'" for i, c in enumerate(C.ROOM_COLORS))} END AS rgba FROM t)
SELECT p_partkey, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, CASE WHEN contains(s, '"') OR contains(s, ',') THEN concat('"', replace(s, '"', '""'), '"') ELSE s END AS csv, regexp_replace(t, '\\s+', '_', 'g') AS file, concat('$', format('{{:,.2f}}', p_retailprice)) AS money, rgba FROM u""",
        "layout_tally": f"{MAIN}, {_TILES} SELECT room_id, material_id, CAST(count(*) FILTER (cls = 'full') AS BIGINT) AS \"full\", CAST(count(*) FILTER (cls = 'cut') AS BIGINT) AS cut, CAST(count(*) AS BIGINT) AS total FROM classed WHERE cls <> 'out' GROUP BY 1, 2",
        "wall_segments": f"""{duck('rooms')}, s AS (SELECT room_id, unnest(range(1, len(points) + 1)) AS i, points FROM rooms), q AS (SELECT room_id, i, points[i] AS p, points[i % len(points) + 1] AS q FROM s)
SELECT room_id, CAST(i - 1 AS INTEGER) AS edge, {R6(HYP('q.x - p.x', 'q.y - p.y'))} AS length, {R6('(p.x + q.x) / 2e0')} AS mid_x, {R6('(p.y + q.y) / 2e0')} AS mid_y, {R6('atan2(q.y - p.y, q.x - p.x)')} AS angle FROM q""",
        "markup_values": f"{duck('markups')}, {_MARKS} SELECT project_id, markup_id, type, {_UNIT} AS unit, {R6('value')} AS value, {R6('value * coalesce(unit_cost, 0e0)')} AS cost, {R6(chr(67) + 'ASE WHEN type IN (' + repr('rect') + ', ' + repr('ellipse') + ') THEN dx END')} AS box_w, {R6('CASE WHEN type IN (' + repr('rect') + ', ' + repr('ellipse') + ') THEN dy END')} AS box_h FROM valued",
        "markup_summary": f"""{duck('markups')}, {_MARKS} SELECT project_id, type, CASE WHEN grouping(type) = 0 THEN {M4('sum(value)')} END AS value, {M4('sum(value * coalesce(unit_cost, 0e0))')} AS cost, CAST(count(*) AS BIGINT) AS count, min(markup_id) AS first_id
FROM valued WHERE type NOT IN ('arrow', 'text') GROUP BY GROUPING SETS ((project_id, type), (project_id))""",
        "markup_labels": f"{duck('markups', 'projects')}, {_MARKS} SELECT project_id, markup_id, type, CASE WHEN type = 'length' THEN {_length('value', 'unit_system')} WHEN type IN ('area', 'rect', 'ellipse') THEN {_area('value', 'unit_system')} WHEN type = 'count' THEN concat(CAST(value AS BIGINT), ' ea') ELSE valued.name END AS label FROM valued JOIN projects USING (project_id)",
        "room_under_pointer": f"""{duck('rooms', 'markups')}, q AS (SELECT markup_id AS point_id, project_id, (markup_id % 53) * 0.25e0 AS x, (markup_id % 47) * 0.25e0 AS y FROM markups), hit AS (SELECT point_id, max(room_id) AS room_id FROM q JOIN rooms USING (project_id) WHERE {INSIDE('x', 'y', 'points')} = 1 GROUP BY 1)
SELECT q.point_id, project_id, x, y, room_id FROM q LEFT JOIN hit USING (point_id)""",
        "marquee": f"""{duck('rooms', 'markups', 'projects')}, {_DRAGS} SELECT drag_id, drags.project_id, room_id FROM drags JOIN rooms USING (project_id) WHERE {HYP('x1 - x0', 'y1 - y0')} >= 3e0
AND {LOW('points', 'x')} <= greatest(x0, x1) AND {HIGH('points', 'x')} >= least(x0, x1) AND {LOW('points', 'y')} <= greatest(y0, y1) AND {HIGH('points', 'y')} >= least(y0, y1)""",
        "drawn_rooms": f"""{duck('markups', 'projects')}, {_DRAGS}, d AS (SELECT *, CASE WHEN scale IS NULL THEN x1 - x0 ELSE floor((x1 - x0) / 0.5e0 + 0.5e0) * 0.5e0 END AS w, CASE WHEN scale IS NULL THEN y1 - y0 ELSE floor((y1 - y0) / 0.5e0 + 0.5e0) * 0.5e0 END AS h FROM drags)
SELECT drag_id, {R6('least(x0, x0 + w)')} AS x, {R6('least(y0, y0 + h)')} AS y, {R6('abs(w)')} AS w, {R6('abs(h)')} AS h FROM d WHERE abs(w) > 0.3e0 AND abs(h) > 0.3e0""",
        "moved_rooms": f"{duck('rooms')}, m AS (SELECT room_id, floor(({LOW('points', 'x')} + 0.4e0) / 0.25e0 + 0.5e0) * 0.25e0 AS x, floor(({LOW('points', 'y')} + 0.3e0) / 0.25e0 + 0.5e0) * 0.25e0 AS y FROM rooms) SELECT room_id, {R6('x')} AS minx, {R6('y')} AS miny, {R6('x + greatest(0.25e0, (room_id % 9) * 0.5e0)')} AS maxx, {R6('y + greatest(0.25e0, (room_id % 5) * 0.75e0)')} AS maxy FROM m",
        "fit_view": f"""{duck('rooms', 'projects')}, v AS (SELECT project_id, CASE WHEN scale IS NULL THEN p.x ELSE p.x / scale END AS x, CASE WHEN scale IS NULL THEN p.y ELSE p.y / scale END AS y FROM (SELECT project_id, unnest(points) AS p FROM rooms) JOIN projects USING (project_id)),
b AS (SELECT project_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v GROUP BY 1), z AS (SELECT *, greatest(0.05e0, least(8e0, 1040e0 / (x1 - x0), 640e0 / (y1 - y0))) AS z FROM projects LEFT JOIN b USING (project_id))
SELECT project_id, CASE WHEN x0 IS NULL THEN 1e0 ELSE {R6('z')} END AS zoom, CASE WHEN x0 IS NULL THEN 80e0 ELSE {R6('80e0 - x0 * z + (1040e0 - (x1 - x0) * z) / 2e0')} END AS x, CASE WHEN x0 IS NULL THEN 80e0 ELSE {R6('80e0 - y0 * z + (640e0 - (y1 - y0) * z) / 2e0')} END AS y FROM z""",
        "camera": f"""{duck('rooms')}, c AS (SELECT project_id, room_id, points, list_sum(list_transform(points, lambda v: v.x)) / len(points) AS x, list_sum(list_transform(points, lambda v: v.y)) / len(points) AS y FROM rooms),
v AS (SELECT project_id, room_id, x, y, unnest(points) AS p FROM c), d AS (SELECT project_id, max({HYP('p.x - x', 'p.y - y')}) AS far FROM v GROUP BY 1), m AS (SELECT project_id, avg(x) AS cx, avg(y) AS cy FROM c GROUP BY 1),
s AS (SELECT project_id, cx, cy, greatest(10e0, far) AS span, greatest(20e0, greatest(10e0, far) * 3e0 + 15e0) AS dist FROM m JOIN d USING (project_id))
SELECT project_id, {R6('cx')} AS cx, {R6('cy')} AS cy, {R6('span')} AS span, {R6('cx + dist * 0.6e0')} AS eye_x, {R6('dist * 0.7e0')} AS eye_y, {R6('dist * 0.6e0 - cy')} AS eye_z FROM s""",
        "plan_planes": f"""{duck('projects')}, o AS (SELECT o_orderkey, scale, CAST(o_orderkey % 4000 AS DOUBLE) AS w, 500e0 + o_orderkey % 700 AS h FROM orders JOIN projects ON o_custkey = project_id)
SELECT o_orderkey, {R6('CASE WHEN scale > 0 AND w > 0 THEN w * scale ELSE 40e0 END')} AS w, {R6('CASE WHEN scale > 0 AND w > 0 THEN h * scale WHEN w > 0 THEN 40e0 * h / w END')} AS h FROM o""",
        "hit_test": f"""{duck('rooms', 'markups', 'projects')}, f AS (SELECT project_id, min(room_id) AS selected FROM rooms GROUP BY 1),
q AS (SELECT markup_id AS point_id, project_id, scale, selected, 80e0 + (markup_id % 53) * 1.125e0 AS sx, 40e0 + (markup_id % 47) * 1.375e0 AS sy FROM markups JOIN projects USING (project_id) LEFT JOIN f USING (project_id)),
d AS (SELECT point_id, sx, sy, selected, room_id, room_ord, list_transform(points, lambda v: {{'x': CASE WHEN scale IS NULL THEN v.x ELSE v.x / 0.0625e0 END * 0.5e0 + 80e0, 'y': CASE WHEN scale IS NULL THEN v.y ELSE v.y / 0.0625e0 END * 0.5e0 + 40e0}}) AS path FROM q JOIN rooms USING (project_id)),
n AS (SELECT *, CASE WHEN room_id = selected THEN list_filter(range(1, len(path) + 1), lambda i: (sx - path[i].x) * (sx - path[i].x) + (sy - path[i].y) * (sy - path[i].y) < 81e0)[1] - 1 END AS vertex FROM d),
t AS (SELECT point_id, arg_max(room_id, room_ord) AS room_id, arg_max({{'v': vertex}}, room_ord).v AS vertex FROM n WHERE vertex IS NOT NULL OR {INSIDE('sx', 'sy', 'path')} = 1 GROUP BY 1)
SELECT q.point_id, q.project_id, t.room_id, CAST(t.vertex AS INTEGER) AS vertex FROM q LEFT JOIN t USING (point_id)""",
        "marquee_selection": f"""{duck('rooms', 'markups', 'projects')}, {_DRAGS} SELECT drag_id, drags.project_id, room_id FROM drags JOIN rooms USING (project_id) WHERE (drag_id % 3 = 0 AND room_id % 5 = 0) OR ({HYP('x1 - x0', 'y1 - y0')} >= 3e0
AND {LOW('points', 'x')} <= greatest(x0, x1) AND {HIGH('points', 'x')} >= least(x0, x1) AND {LOW('points', 'y')} <= greatest(y0, y1) AND {HIGH('points', 'y')} >= least(y0, y1))""",
        "toggled_selection": f"{duck('rooms', 'bridge')}, n AS (SELECT room_id, count(*) AS n FROM bridge GROUP BY 1) SELECT project_id, room_id FROM rooms LEFT JOIN n USING (room_id) WHERE (coalesce(n, 0) + CASE WHEN room_id % 2 = 0 THEN 1 ELSE 0 END) % 2 = 1",
        "count_markups": f"{duck('requests')} SELECT identity AS project_id, ts_ms // {DAY_MS} AS markup_id, CAST(count(*) AS DOUBLE) AS value, count(*) * 2e0 AS cost, min(event_id) * 0.5e0 AS first_x, max(event_id) * 0.25e0 AS last_y FROM requests GROUP BY 1, 2",
        "typed_dimensions": f"""{duck('rooms', 'projects')}, s AS (SELECT room_id, unit_system, (room_id % 29) * 0.25e0 + 6e0 AS side FROM rooms JOIN projects USING (project_id)) SELECT room_id, CASE WHEN room_id % 2 = 0 THEN {R6(f"CASE unit_system WHEN 'metric_m' THEN {RND('side * 0.3048e0', 3)} * 3.280839895e0 WHEN 'metric_cm' THEN {RND('side * 30.48e0', 1)} * 0.03280839895e0 WHEN 'metric_mm' THEN {RND('side * 304.8e0', 0)} * 0.003280839895e0 ELSE side END")} END AS feet FROM s""",
        "owner_projects": "SELECT c_custkey AS project_id, c_name AS name, c_acctbal AS total_cost, c_acctbal / 4e0 AS floor_sf, (c_custkey * 7919) % 100003 AS updated_at FROM customer WHERE c_nationkey = 7 AND c_custkey % 5 <> 0",
        "library_list": "SELECT p_partkey % 10 AS owner, p_partkey AS tile_id, p_name AS name, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY (p_partkey * 7919) % 100003 DESC, p_partkey) AS place FROM part",
        "detection_commits": """WITH r AS (SELECT event_id, o, CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE CAST(event_id % 100 AS DOUBLE) END AS x, CASE WHEN event_id % 3 = 2 THEN 8.5e0 ELSE 1e0 END AS w, CASE WHEN o = 0 THEN 1e0 ELSE 3e0 END AS h FROM events, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS s(o) WHERE (event_id + o) % 4 <> 0)
SELECT event_id AS request_id, o AS ord, concat('R', event_id) AS name, x AS x0, 2.5e0 AS y0, x + w AS x2, 2.5e0 + h AS y2 FROM r""",
        "add_rooms": f"""{MAIN}, have AS (SELECT project_id, count(*) AS n FROM rooms GROUP BY 1), fl AS (SELECT b.project_id, min(material_id) AS floor FROM bridge b JOIN materials USING (material_id) WHERE type = 'floor' GROUP BY 1)
SELECT project_id, seq, CASE WHEN seq = 2 THEN 'Porch' ELSE concat('Room ', coalesce(n, 0) + 1) END AS name, ([{', '.join(repr(c) for c in C.ROOM_COLORS)}])[(coalesce(n, 0) + seq - 1) % 8 + 1] AS color, floor, 120e0 AS area FROM projects CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) AS s(seq) LEFT JOIN have USING (project_id) LEFT JOIN fl USING (project_id)""",
        "toggle_assignments": f"{duck('bridge')}, {_ASSIGNED} SELECT room_id, array_to_string(CASE WHEN room_id % 2 = 0 THEN a[2:] ELSE list_append(a, -1) END, ',') AS assigned FROM assigned",
        "delete_materials": f"{duck('bridge', 'materials')} SELECT project_id, room_id, material_id FROM bridge WHERE material_id NOT IN (SELECT material_id FROM materials WHERE type = 'wall')",
        "add_floor_material": f"{MAIN} SELECT project_id, room_id, material_id FROM bridge UNION ALL SELECT project_id, room_id, -1 FROM rooms WHERE room_id NOT IN (SELECT room_id FROM bridge JOIN materials USING (material_id) WHERE type = 'floor')",
        "change_pattern": f"""{duck('materials')}, m AS (SELECT material_id, pattern, CASE WHEN material_id % 4 = 1 THEN 20e0 ELSE waste END AS waste, CASE WHEN material_id % 2 = 1 THEN {C.case('material_id % 5', list(C.WASTE)[:5])} END AS p FROM materials)
SELECT material_id, coalesce(p, pattern) AS pattern, CASE WHEN p IS NOT NULL AND waste = {C.waste_for('pattern')} THEN {C.waste_for('p')} ELSE waste END AS waste FROM m""",
        "merge_rooms": f"{duck('rooms')} SELECT room_id, CASE WHEN room_id % 6 = 0 THEN concat(name, '*') ELSE name END AS name, CASE WHEN room_id % 3 = 0 THEN 'grid' ELSE pattern END AS pattern FROM rooms",
        "tile_library": """SELECT p_partkey AS tile_id, p_partkey % 10 AS owner, CASE WHEN p_partkey % 9 = 0 THEN 'Tile' ELSE p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN 12e0 WHEN 1 THEN -3e0 ELSE CAST(p_size AS DOUBLE) END AS tw_in, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_partkey % 2 = 0 THEN 'box' ELSE 'sf' END AS price_unit, CAST(NULL AS DOUBLE) AS sf_per_box,
CASE WHEN p_partkey % 9 = 0 THEN 'Library Tile' ELSE p_name END AS material, CASE WHEN p_partkey % 4 < 2 THEN 12e0 ELSE CAST(p_size AS DOUBLE) END AS tw, CASE WHEN p_partkey % 5 = 0 THEN 0e0 ELSE p_retailprice END AS material_price, 15e0 AS box FROM part""",
        "project_list": f"WITH {_STORED} SELECT owner, project_id, name, total_cost, updated_at, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, project_id) AS place FROM stored WHERE NOT archived",
        "project_upsert": f"""WITH {_STORED} SELECT project_id, CASE WHEN project_id % 3 = 0 THEN concat(name, ' v2') ELSE name END AS name, CASE WHEN project_id % 3 = 0 THEN total_cost + 1e0 ELSE total_cost END AS total_cost, CASE WHEN project_id % 3 = 0 THEN updated_at + 1 ELSE updated_at END AS updated_at FROM stored WHERE NOT archived
UNION ALL SELECT -1 - project_id, concat(name, ' v2'), total_cost + 1e0, updated_at + 1 FROM stored WHERE project_id % 3 = 0""",
        "project_headline": f"{MAIN}, {LINES} SELECT project_id, {M4('CASE WHEN scale IS NOT NULL THEN floor_sf ELSE 0e0 END')} AS floor_sf, {M4('(materials + labor) + (materials + labor) * tax_rate / 100e0')} AS total_cost FROM totals",
        "room_materials": f"""{MAIN} SELECT room_id, coalesce(string_agg(m.name, ' | ' ORDER BY material_id), '') AS materials, min(material_id) FILTER (type = 'floor') AS first_floor FROM rooms LEFT JOIN bridge USING (room_id) LEFT JOIN materials m USING (material_id) GROUP BY 1""",
        "document_round_trip": f"""{duck('projects', 'rooms', 'bridge', 'markups')}, r AS (SELECT project_id, count(*) AS n, sum({AREA('points')}) AS sf FROM rooms GROUP BY 1), b AS (SELECT project_id, count(*) AS n FROM bridge GROUP BY 1), k AS (SELECT project_id, count(*) AS n FROM markups GROUP BY 1)
SELECT project_id, name, unit_system, scale, tax_rate, CAST(coalesce(r.n, 0) AS BIGINT) AS rooms, coalesce(sf, 0e0) AS sf, CAST(coalesce(b.n, 0) AS BIGINT) AS links, CAST(coalesce(k.n, 0) AS BIGINT) AS marks FROM projects LEFT JOIN r USING (project_id) LEFT JOIN b USING (project_id) LEFT JOIN k USING (project_id)""",
        "detection_cleaning": """WITH r AS (SELECT event_id, event_type, i, CASE i WHEN 0 THEN CAST(event_id % 1500 AS DOUBLE) ELSE (event_id % 30) * 0.5e0 END AS w FROM events, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS s(i))
SELECT event_id AS request_id, i AS ord, CASE WHEN event_id % 4 = i THEN 'Room' ELSE event_type END AS name, CAST(event_id % 100 AS DOUBLE) AS x, CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE 2.5e0 END AS y, w, 8.5e0 AS h, CASE event_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0.25e0 END AS confidence FROM r WHERE w > 0 AND w <= 1000 AND event_id % 6 <> 0""",
        "detection_requests": f"""SELECT event_id, CAST(CASE WHEN event_id % 13 = 0 THEN 405 WHEN event_id % 19 = 0 THEN 401 WHEN event_id % 23 = 0 THEN 429 WHEN event_id % 17 = 0 OR event_id = 0 THEN 400 WHEN event_id * 1000 > 8000000 THEN 413 WHEN event_id % 5 = 2 THEN 400 ELSE 200 END AS BIGINT) AS status, CASE WHEN event_id % 3 = 0 THEN concat('10.0.0.', event_id % 250) WHEN event_id % 2 = 0 THEN '127.0.0.1' ELSE 'unknown' END AS ip,
{R6('greatest(0.3e0, least(3e0, 2000e0 / (500e0 + event_id % 3000), sqrt(16777216e0 * 0.85e0 / ((500e0 + event_id % 3000) * (700e0 + event_id % 2000))), 4096e0 * 0.9e0 / greatest(500e0 + event_id % 3000, 700e0 + event_id % 2000)))')} AS raster FROM events""",
        "limiter_fixed": f"{duck('requests')} SELECT identity, ts_ms // {DAY_MS} AS bucket, CAST(count(*) AS BIGINT) AS hits, CAST(greatest(0, count(*) - {PER_DAY}) AS BIGINT) AS limited FROM requests GROUP BY 1, 2",
        "limiter_sliding": f"""{duck('requests')} SELECT a.event_id, a.identity, a.ts_ms, CAST(count(*) AS BIGINT) AS hits, count(*) > {PER_DAY} AS limited FROM requests a JOIN requests b ON a.identity = b.identity AND a.ts_ms - b.ts_ms < {DAY_MS} AND (b.ts_ms < a.ts_ms OR (b.ts_ms = a.ts_ms AND b.event_id <= a.event_id)) GROUP BY 1, 2, 3""",
        "debounced_saves": f"""{duck('requests')} SELECT identity, event_id, ts_ms FROM requests QUALIFY coalesce(lead(ts_ms) OVER (PARTITION BY identity ORDER BY ts_ms, event_id) - ts_ms >= 14400000, true)""",
    }
    out["document_estimate"] = out["project_estimate"]
    out["report_xlsx_rooms"] = f"""{MAIN}, n AS (SELECT room_id, string_agg(m.name, ' | ' ORDER BY material_id) AS names FROM bridge JOIN materials m USING (material_id) GROUP BY 1)
        SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY room_id) AS row, r.name, {RND(AREA('points'), 2)} AS area, {RND(PER('points'), 2)} AS perimeter, wall_height AS height, pattern, coalesce(names, '') AS materials
        FROM rooms r JOIN projects USING (project_id) LEFT JOIN n USING (room_id)"""
    out["report_xlsx_materials"] = f"""{MAIN} SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY material_id) AS row, m.name, type, tw::DOUBLE AS tw, th::DOUBLE AS th, grout::DOUBLE AS grout, pattern, waste::DOUBLE AS waste, price::DOUBLE AS price, price_unit AS unit, sf_per_box::DOUBLE AS sf_per_box
        FROM (SELECT DISTINCT project_id, material_id FROM bridge) JOIN projects USING (project_id) JOIN materials m USING (material_id)"""
    out["layout_patches"] = f"""{duck('projects', 'rooms')} SELECT project_id, concat('n', project_id) AS note, room_id, r.name, pattern, CASE WHEN room_id % 3 = 0 THEN (room_id % 90)::DOUBLE ELSE angle_deg END AS angle,
        origin_x AS x, origin_y AS y, len(points)::BIGINT AS corners FROM rooms r JOIN projects USING (project_id)"""
    out["snapshot_load"] = """SELECT c_custkey AS project_id, CASE c_custkey % 4 WHEN 0 THEN concat('A', c_custkey) WHEN 2 THEN NULL ELSE 'Untitled Takeoff' END AS name,
        CASE c_custkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 'metric_m' ELSE 'imperial_ft_in' END AS unit_system, CASE WHEN c_custkey % 4 IN (1, 3) THEN 8.625e0 END AS tax_rate,
        CASE c_custkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 2.5e0 ELSE 0e0 END AS labor, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS own FROM customer"""
    # a stream gives what its batch gives once the watermark, so far behind the latest request, has passed it
    out["limiter_sliding_stream"] = out["limiter_sliding"]
    out["limiter_fixed_stream"] = f"{out['limiter_fixed']} HAVING (bucket + 1) * {DAY_MS} <= (SELECT max(ts_ms) FROM requests) - 300000"
    out["debounced_saves_stream"] = f"""{duck('requests')}, gaps AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 4 HOUR, true) AS opens FROM requests WINDOW w AS (PARTITION BY identity ORDER BY ts, event_id)),
runs AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY identity ORDER BY ts, event_id) AS run FROM gaps)
SELECT identity, arg_max(event_id, (ts, event_id)) AS event_id, CAST(count(*) AS BIGINT) AS changes FROM runs GROUP BY identity, run HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM requests) - INTERVAL 1 MINUTE"""
    dx, dy = "abs(b.x - a.kept[-1].x)", "abs(b.y - a.kept[-1].y)"
    near = f"CASE WHEN {dx} = 0 THEN {dy} WHEN {dy} = 0 THEN {dx} ELSE {HYP(dx, dy)} END"
    point = "{'x': v.x, 'y': v.y, 'kept': [{'x': v.x, 'y': v.y}]}"
    out["markup_commits"] = f"""{duck('markups')}, d AS (SELECT markup_id, type, list_transform(points, lambda p: {{'x': p.x / 50e0, 'y': p.y / 50e0}}) AS p FROM markups WHERE type <> 'text'),
c AS (SELECT *, CASE WHEN type IN ('length', 'area') THEN len(list_reduce(list_transform(p, lambda v: {point}), lambda a, b: {{'x': b.x, 'y': b.y, 'kept': CASE WHEN {near} > 0.02e0 THEN list_append(a.kept, {{'x': b.x, 'y': b.y}}) ELSE a.kept END}}).kept) ELSE len(p) END AS n, abs(p[2].x - p[1].x) AS dx, abs(p[2].y - p[1].y) AS dy FROM d)
SELECT markup_id, type, CAST(n AS BIGINT) AS n_points FROM c WHERE CASE type WHEN 'rect' THEN dx > 0.2e0 AND dy > 0.2e0 WHEN 'ellipse' THEN dx > 0.2e0 AND dy > 0.2e0 WHEN 'arrow' THEN {HYP('dx', 'dy')} > 0.1e0 WHEN 'area' THEN n >= 3 WHEN 'length' THEN n >= 2 ELSE true END"""
    from .cut_oracles import cut_oracles  # it builds on this module

    return out | cut_oracles()
