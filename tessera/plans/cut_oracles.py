"""DuckDB twins of the cut engine's queries: half-plane clipping as a list a tile, allocation as a fold over a list of needs."""

from __future__ import annotations

from .oracles import _TILES, AREA, CROSS, EDGES, HIGH, INSIDE, LINES, LOW, M4, MAIN, R6

#: Names a value inside an expression: there is no LET.
LET = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"


def _clipped(source: str, to: str) -> str:
    """CTEs that lead from `source`, with x, y, w, h and points, to `to`, where poly is the part inside all half-planes of the room's edges."""
    out = [f"{to}_0 AS (SELECT *, [{{'x': x, 'y': y}}, {{'x': x + w, 'y': y}}, {{'x': x + w, 'y': y + h}}, {{'x': x, 'y': y + h}}] AS poly, CASE WHEN {CROSS('points')} / 2e0 < 0e0 THEN -1e0 ELSE 1e0 END AS turn FROM {source})"]
    a1, b1, c1 = "(edge.by - edge.ay)", "(edge.ax - edge.bx)", "((edge.by - edge.ay) * edge.ax + (edge.ax - edge.bx) * edge.ay)"
    a2, b2 = "(s.q.y - s.p.y)", "(s.p.x - s.q.x)"
    c2, d = f"({a2} * s.p.x + {b2} * s.p.y)", f"({a1} * {b2} - {a2} * {b1})"
    here = "{'x': s.q.x, 'y': s.q.y}"
    meet = f"CASE WHEN abs({d}) < 1e-12 THEN {here} ELSE {{'x': ({b2} * {c1} - {b1} * {c2}) / {d}, 'y': ({a1} * {c2} - {a2} * {c1}) / {d}}} END"
    inside = lambda p: f"s.{p}.c >= -1e-9"
    step = f"CASE WHEN {inside('p')} AND {inside('q')} THEN [{here}] WHEN {inside('p')} THEN [{meet}] WHEN {inside('q')} THEN [{meet}, {here}] ELSE [] END"
    for j in range(1, EDGES + 1):
        out += [
            f"{to}_{j}e AS (SELECT * EXCLUDE (poly), poly AS old, {{'ax': points[{j}].x, 'ay': points[{j}].y, 'bx': points[{j} % len(points) + 1].x, 'by': points[{j} % len(points) + 1].y}} AS edge FROM {to}_{j - 1})",
            f"{to}_{j}c AS (SELECT *, list_transform(old, lambda v: {{'x': v.x, 'y': v.y, 'c': turn * ((edge.bx - edge.ax) * (v.y - edge.ay) - (edge.by - edge.ay) * (v.x - edge.ax))}}) AS pts FROM {to}_{j}e)",
            # a part that is inside as a whole stays, its corners moved on by one as the steps would leave them
            f"{to}_{j} AS (SELECT * EXCLUDE (old, edge, pts), CASE WHEN {j} > len(points) THEN old WHEN list_min(list_transform(pts, lambda v: v.c)) >= -1e-9 THEN list_append(old[2:], old[1]) ELSE flatten(list_transform(range(1, len(pts) + 1), lambda i: {LET('s', '{\'p\': pts[i], \'q\': pts[i % len(pts) + 1]}', step)})) END AS poly FROM {to}_{j}c)",
        ]
    return ", ".join([*out, f"{to} AS MATERIALIZED (SELECT * EXCLUDE (points, turn) FROM {to}_{EDGES})"])


def _needs(tiles: str = _TILES) -> str:
    # the grouping changes no row: what it gives out is worked by all threads, what a CTE gives out by one
    return f"""{tiles}, dealt AS (SELECT room_id, material_id, r, c, k, x, y, w, h FROM classed WHERE cls = 'cut' GROUP BY ALL), cut_tiles AS (SELECT dealt.*, points FROM dealt JOIN rooms USING (room_id)), {_clipped('cut_tiles', 'cut_parts')},
pieces AS MATERIALIZED (SELECT room_id, material_id, r, c, k, least(w, {HIGH('poly', 'x')} - {LOW('poly', 'x')}) AS w, least(h, {HIGH('poly', 'y')} - {LOW('poly', 'y')}) AS h, {AREA('poly')} AS area FROM cut_parts WHERE len(poly) >= 3),
needs AS (SELECT project_id, material_id, room_id, rooms.name AS room, room_ord, r, c, k, pieces.w AS w, pieces.h AS h FROM pieces JOIN rooms USING (room_id) WHERE area > 1e-6),
fulls AS (SELECT project_id, material_id, count(*) AS full_tiles FROM classed JOIN rooms USING (room_id) WHERE cls = 'full' GROUP BY 1, 2),
about AS (SELECT b.project_id, b.material_id, m.name AS material, m.type, arg_min(r.pattern, r.room_ord) AS pattern, bool_or(r.pattern IN ('herringbone', 'diagonal', 'basketweave')) AS angled, any_value(coalesce(m.grain_locked, greatest(tw, th) / least(tw, th) >= 2.5e0)) AS grain_locked,
  any_value(tw) AS tw, any_value(th) AS th, any_value((tw + grout) / 12e0) AS tile_w, any_value((th + grout) / 12e0) AS tile_h, any_value(optimize_whole_job) AS whole, any_value(cost_mode) AS cost_mode FROM bridge b JOIN rooms r USING (room_id) JOIN materials m USING (material_id) GROUP BY ALL)"""


#: Needs in the order in which each mode serves them: as laid, or larger ones first.
LAID = "room_ord, room_id, r, c, k"
ORDERED = {"practical": LAID, "optimize": f"w * h DESC, {LAID}"}


def _fold(best: bool, listed: bool) -> str:
    """An expression: the state after all needs of the list `needs`; its fields are pool, broken, reused, scrap, label and steps."""
    fits = "(a.pool[i].w >= b.w - 1e-6 AND a.pool[i].h >= b.h - 1e-6) OR (NOT grain_locked AND a.pool[i].w >= b.h - 1e-6 AND a.pool[i].h >= b.w - 1e-6)"
    able = f"list_filter(range(1, len(a.pool) + 1), lambda i: {fits})"
    found = f"list_min(list_transform({able}, lambda i: {{'slack': a.pool[i].a - b.w * b.h, 'i': i}})).i" if best else f"{able}[1]"
    origin = "CASE WHEN f IS NULL THEN concat('tile #', a.broken + 1) ELSE a.pool[f].n END" if listed else "''"
    taken = f"{{'f': f, 'w': CASE WHEN f IS NULL THEN tile_w ELSE a.pool[f].w END, 'h': CASE WHEN f IS NULL THEN tile_h ELSE a.pool[f].h END, 't': CASE WHEN f IS NULL THEN a.broken + 1 ELSE a.pool[f].t END, 'n': {origin}}}"
    strips = "list_filter([{'over': s.w - b.w, 'w': s.w - b.w, 'h': s.h, 'a': (s.w - b.w) * s.h}, {'over': s.h - b.h, 'w': b.w, 'h': s.h - b.h, 'a': b.w * (s.h - b.h)}], lambda v: v.over > 1e-6)"
    usable = f"list_filter({strips}, lambda v: v.a >= tile_w * tile_h * 0.1e0)"
    name = "concat('O', s.t, '.', a.label + 1 + i)" if listed else "''"
    kept = f"list_transform(range(1, len(m) + 1), lambda i: {{'w': m[i].w, 'h': m[i].h, 'a': m[i].a, 't': s.t, 'n': {name}}})"
    made = "list_transform(o, lambda v: {'w': v.w, 'h': v.h, 'id': v.n})"
    step = f"{{'piece': concat('C', a.label + 1 + len(o)), 'room': b.room, 'w': b.w, 'h': b.h, 'source': CASE WHEN s.f IS NULL THEN 'new tile' ELSE 'offcut' END, 'origin': s.n, 'produces': {made}}}"
    steps = f"list_append(a.steps, {step})" if listed else "a.steps"
    rest = "CASE WHEN s.f IS NULL THEN a.pool ELSE list_concat(a.pool[:s.f - 1], a.pool[s.f + 1:]) END"
    scraps = f"len(list_filter({strips}, lambda v: v.a < tile_w * tile_h * 0.1e0 AND v.a > 1e-6))"
    state = f"""{{'w': b.w, 'h': b.h, 'room': b.room, 'pool': list_concat({rest}, o), 'broken': a.broken + CASE WHEN s.f IS NULL THEN 1 ELSE 0 END, 'reused': a.reused + CASE WHEN s.f IS NULL THEN 0 ELSE 1 END,
        'scrap': a.scrap + {scraps}, 'label': a.label + 1 + len(o), 'steps': {steps}}}"""
    return f"list_reduce(list_prepend({_state('0e0', '0e0', repr(''))}, needs), lambda a, b: {LET('f', found, LET('s', taken, LET('m', usable, LET('o', kept, state))))})"


def _state(w: str, h: str, room: str) -> str:
    pool = "CAST([] AS STRUCT(w DOUBLE, h DOUBLE, a DOUBLE, t BIGINT, n VARCHAR)[])"
    steps = "CAST([] AS STRUCT(piece VARCHAR, room VARCHAR, w DOUBLE, h DOUBLE, source VARCHAR, origin VARCHAR, produces STRUCT(w DOUBLE, h DOUBLE, id VARCHAR)[])[])"
    return f"{{'w': {w}, 'h': {h}, 'room': {room}, 'pool': {pool}, 'broken': CAST(0 AS BIGINT), 'reused': CAST(0 AS BIGINT), 'scrap': CAST(0 AS BIGINT), 'label': CAST(0 AS BIGINT), 'steps': {steps}}}"


def _analysis(which: dict[str, str], listed: bool = False) -> str:
    """CTEs up to `analysis`: a row for each project, material and mode. which: for each mode the groups that have it."""
    parts = []
    for mode, where in which.items():
        ordered = f"SELECT project_id, material_id, list({_state('w', 'h', 'room')} ORDER BY {ORDERED[mode]}) AS needs FROM needs GROUP BY 1, 2"
        parts.append(f"SELECT about.*, '{mode}' AS mode, coalesce(len(needs), 0) AS n_cuts, {_fold(mode == 'optimize', listed)} AS z FROM about LEFT JOIN ({ordered}) USING (project_id, material_id) WHERE {where}")
    whole = lambda x: f"CAST(coalesce({x}, 0) AS BIGINT)"
    return f"""folded AS ({' UNION ALL '.join(parts)}), analysis AS (SELECT project_id, material_id, material, type, pattern, angled, grain_locked, tw, th, mode, cost_mode, {whole('full_tiles')} AS full_tiles, {whole('n_cuts')} AS cut_pieces, {whole('z.broken')} AS new_tiles, {whole('z.reused')} AS reused, {whole('n_cuts - z.broken')} AS saved,
  {whole('z.scrap')} AS scrap, {whole('len(z.pool)')} AS leftover, {whole('coalesce(full_tiles, 0) + coalesce(z.broken, 0)')} AS total_tiles, {whole('coalesce(full_tiles, 0) + n_cuts')} AS naive_total, z.steps AS steps FROM folded LEFT JOIN fulls USING (project_id, material_id))"""


def _offcuts(made: str) -> str:
    return ", ".join(f"{made}[{i}].{f} AS offcut{i}_{f}" for i in (1, 2) for f in ("id", "w", "h"))


BOTH = {"practical": "true", "optimize": "true"}
OWN = {"practical": "NOT whole", "optimize": "whole"}
PRICED = {k: f"cost_mode = 'cuts' AND type <> 'wall' AND {v}" for k, v in OWN.items()}
_SERVED = f"served AS (SELECT n.*, CASE WHEN whole THEN 'optimize' ELSE 'practical' END AS mode, row_number() OVER (PARTITION BY n.project_id, n.material_id ORDER BY CASE WHEN whole THEN 0e0 - w * h ELSE 0e0 END, {LAID}) - 1 AS n FROM needs n JOIN about USING (project_id, material_id))"


def cut_oracles() -> dict[str, str]:
    two = lambda x: f"floor({x} * 100e0 + 0.5e0) / 100e0"
    return {
        "tile_in_room": f"""{MAIN}, t AS (SELECT b.room_id, b.material_id, points, (b.room_id % 11) * 1e0 AS x, (b.material_id % 9) * 1e0 AS y, (tw + grout) / 12e0 AS w, (th + grout) / 12e0 AS h FROM bridge b JOIN rooms r USING (room_id) JOIN materials m USING (material_id)),
e AS (SELECT *, least(w, h) * 0.02e0 AS e FROM t), n AS (SELECT *, {INSIDE('x + e', 'y + e', 'points')} + {INSIDE('x + w - e', 'y + e', 'points')} + {INSIDE('x + w - e', 'y + h - e', 'points')} + {INSIDE('x + e', 'y + h - e', 'points')} AS n, {INSIDE('x + w / 2e0', 'y + h / 2e0', 'points')} AS mid FROM e), {_clipped('n', 'part')}
SELECT room_id, material_id, CASE WHEN n = 4 THEN 'full' WHEN n > 0 OR mid = 1 THEN 'cut' ELSE 'out' END AS cls, {R6(AREA('poly'))} AS inside FROM part""",
        "cut_pieces": f"{MAIN}, {_needs()} SELECT room_id, material_id, count(*) AS pieces, {M4('sum(w)')} AS w, {M4('sum(h)')} AS h, {M4('sum(area)')} AS area FROM pieces WHERE area > 1e-6 GROUP BY 1, 2",
        "cut_analysis": f"""{MAIN}, {_needs()}, {_analysis(BOTH)} SELECT * EXCLUDE (steps, cost_mode), CASE WHEN naive_total > 0 THEN saved / naive_total * 100e0 ELSE 0e0 END AS pct_saved FROM analysis""",
        "cut_comparison": f"""{MAIN}, {_needs()}, {_analysis(BOTH)} SELECT project_id, CAST(sum(naive_total) FILTER (mode = 'practical') AS BIGINT) AS naive, CAST(sum(total_tiles) FILTER (mode = 'practical') AS BIGINT) AS practical, CAST(sum(total_tiles) FILTER (mode = 'optimize') AS BIGINT) AS optimized FROM analysis GROUP BY 1""",
        "cut_steps": f"""{MAIN}, {_needs()}, {_analysis(OWN, True)}, s AS (SELECT project_id, material_id, unnest(range(1, len(steps) + 1)) AS n, steps FROM analysis)
SELECT project_id, material_id, CAST(n - 1 AS INTEGER) AS n, steps[n].piece AS piece, steps[n].room AS room, steps[n].w AS w, steps[n].h AS h, steps[n].source AS source, steps[n].origin AS origin, {_offcuts('steps[n].produces')} FROM s""",
        "cut_plan": f"""{MAIN}, {_needs()}, {_analysis(OWN, True)}, f AS (SELECT project_id, material_id, mode, list_filter(steps, lambda s: s.source = 'new tile') AS steps FROM analysis), s AS (SELECT *, unnest(range(1, len(steps) + 1)) AS n FROM f)
SELECT project_id, material_id, mode, CAST(n - 1 AS INTEGER) AS n, steps[n].origin AS tile, steps[n].w AS w, steps[n].h AS h, steps[n].room AS room, {_offcuts('steps[n].produces')} FROM s""",
        "cut_list": f"""{MAIN}, {_needs()}, {_SERVED}, sized AS (SELECT *, {two('w')} AS rw, {two('h')} AS rh FROM served), by_room AS (SELECT project_id, material_id, mode, rw, rh, room, count(*) AS cuts, min(n) AS n, arg_min(w, n) AS w, arg_min(h, n) AS h FROM sized GROUP BY ALL)
SELECT project_id, material_id, mode, arg_min(w, n) AS w, arg_min(h, n) AS h, CAST(sum(cuts) AS BIGINT) AS count, CAST(min(n) AS INTEGER) AS first, string_agg(room, ', ' ORDER BY n) AS rooms FROM by_room GROUP BY project_id, material_id, mode, rw, rh""",
        "cut_rooms": f"""{MAIN}, {_needs()}, named AS (SELECT project_id, material_id, room, count(*) AS cuts FROM needs GROUP BY ALL)
SELECT b.project_id, b.material_id, CASE WHEN whole THEN 'optimize' ELSE 'practical' END AS mode, b.room_id, r.name AS room, {AREA('r.points')} AS area_sf, coalesce(cuts, 0) AS cuts, r.pattern AS pattern FROM bridge b JOIN rooms r USING (room_id) JOIN about ON about.project_id = b.project_id AND about.material_id = b.material_id LEFT JOIN named n ON n.project_id = b.project_id AND n.material_id = b.material_id AND n.room = r.name""",
        "estimate_lines_cuts": f"""{MAIN}, {LINES}, {_needs()}, {_analysis(PRICED)}, cuts AS (SELECT project_id, material_id, total_tiles FROM analysis),
u AS (SELECT l.*, m.cost_mode = 'cuts' AND m.type <> 'wall' AS by_cuts, CAST(ceil(gross_sf / tile_sf) AS BIGINT) AS waste_tiles, coalesce(total_tiles, 0) * (1e0 + coalesce(m.cut_safety_pct, 5e0) / 100e0) AS raw FROM lines l JOIN materials m USING (material_id) LEFT JOIN cuts USING (project_id, material_id)),
v AS (SELECT *, CASE WHEN by_cuts THEN CAST(ceil(raw) AS BIGINT) ELSE waste_tiles END AS n FROM u),
q AS (SELECT *, CASE WHEN price_unit = 'tile' THEN CAST(n AS DOUBLE) WHEN price_unit = 'box' THEN ceil(CASE WHEN by_cuts THEN raw * tile_sf ELSE gross_sf END / sf_per_box) WHEN by_cuts THEN n * tile_sf ELSE gross_sf END AS q FROM v)
SELECT project_id, material_id, CASE WHEN by_cuts THEN 'cuts' ELSE 'waste' END AS mode, n AS tiles, {R6('q')} AS qty, CASE WHEN price_unit IN ('tile', 'box') THEN price_unit ELSE 'sf' END AS unit, {R6('q * price')} AS cost FROM q""",
    }
