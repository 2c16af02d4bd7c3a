"""Projects, rooms, materials, assignments, markups and requests made from the driver's tables.

One SQL text serves Spark and DuckDB; just the spelling of structs and a few functions differ.
Every literal that is not whole has an exponent, so it is a double in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import catalog as C


def _point(x: str, y: str, duck: bool) -> str:
    return f"{{'x': {x}, 'y': {y}}}" if duck else f"named_struct('x', {x}, 'y', {y})"


def _points(corners: list[tuple[str, str]], duck: bool) -> str:
    inner = ", ".join(_point(f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)", duck) for x, y in corners)
    return f"[{inner}]" if duck else f"array({inner})"


def projects(duck: bool = False) -> str:
    return f"""SELECT c_custkey AS project_id, c_name AS name, {C.case('c_custkey % 6', C.UNIT_SYSTEMS)} AS unit_system,
        CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 0.05e0 END AS scale, 5e0 + (c_custkey % 9) * 0.625e0 AS tax_rate, (c_nationkey % 5) * 0.75e0 AS labor_rate_per_sf FROM customer"""


def rooms(duck: bool = False) -> str:
    shapes = [
        [("0e0", "0e0"), ("w", "0e0"), ("w", "h"), ("0e0", "h")],
        [("0e0", "0e0"), ("w", "0e0"), ("0e0", "h")],
        [("0e0", "0e0"), ("w", "0e0"), ("w", "h / 2e0"), ("w / 2e0", "h / 2e0"), ("w / 2e0", "h"), ("0e0", "h")],
        [("0e0", "0e0"), ("w", "0e0"), ("w / 2e0", "h"), ("0e0", "h")],
    ]
    points = "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {_points(s, duck)}" for i, s in enumerate(shapes)) + " END"
    return f"""SELECT o_custkey AS project_id, o_orderkey AS room_id, concat('Room ', CAST(o_orderkey % 50 AS VARCHAR(9))) AS name, {points} AS points,
        8e0 + o_orderkey % 3 AS wall_height, {C.case('o_orderkey % 6', list(C.WASTE))} AS pattern, CAST(o_orderkey AS INTEGER) AS room_ord,
        (o_orderkey % 4) * 15e0 AS angle_deg, (o_orderkey % 5) * 0.25e0 AS origin_x, (o_orderkey % 7) * 0.125e0 AS origin_y
        FROM (SELECT o_orderkey, o_custkey, 6e0 + (o_orderkey % 29) * 0.25e0 AS w, 5e0 + (o_orderkey % 23) * 0.375e0 AS h FROM orders)"""


def materials(duck: bool = False) -> str:
    sizes = C.sizes()
    pattern = C.case("p_partkey % 6", list(C.WASTE))
    return f"""SELECT p_partkey AS material_id, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN 'wall' ELSE 'floor' END AS type,
        {C.case('p_partkey % 32', [w for w, _ in sizes])} AS tw, {C.case('p_partkey % 32', [h for _, h in sizes])} AS th,
        {C.case('p_partkey % 5', C.GROUT)} AS grout, {pattern} AS pattern, {C.waste_for(pattern)} AS waste, p_retailprice / 100e0 AS price,
        {C.case('p_partkey % 3', ['sf', 'tile', 'box'])} AS price_unit, 10e0 + p_size % 11 AS sf_per_box, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 1e0 END AS face_coverage,
        CASE WHEN p_partkey % 2 = 1 THEN 'cuts' ELSE 'waste' END AS cost_mode, p_partkey % 4 = 3 AS optimize_whole_job,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 5e0 END AS cut_safety_pct, CAST(NULL AS BOOLEAN) AS grain_locked FROM part"""


def bridge(duck: bool = False) -> str:
    return "SELECT o_custkey AS project_id, room_id, material_id FROM (SELECT DISTINCT l_orderkey AS room_id, l_partkey AS material_id FROM lineitem) b JOIN orders ON room_id = o_orderkey"


def markups(duck: bool = False) -> str:
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)" if duck else "CAST(get_json_object(props, '$.k') AS INT)"
    kind = "CASE event_type WHEN 'view' THEN 'length' WHEN 'click' THEN 'count' WHEN 'purchase' THEN 'rect' WHEN 'signup' THEN 'ellipse' ELSE CASE event_id % 3 WHEN 0 THEN 'area' WHEN 1 THEN 'arrow' ELSE 'text' END END"
    box = _points([("0e0", "0e0"), ("v", "k * 0.25e0")], duck)
    line = _points([("0e0", "0e0"), ("v", "0e0"), ("v", "k")], duck)
    ring = _points([("0e0", "0e0"), ("v", "0e0"), ("v", "k"), ("0e0", "k")], duck)
    dots = f"list_transform(range(0, k % 5 + 1), lambda i: {_point('CAST(i AS DOUBLE)', 'v', True)})" if duck else f"transform(sequence(0, k % 5), i -> {_point('CAST(i AS DOUBLE)', 'v', False)})"
    return f"""SELECT project_id, markup_id, type, CASE type WHEN 'length' THEN {line} WHEN 'count' THEN {dots} WHEN 'area' THEN {ring} WHEN 'text' THEN NULL ELSE {box} END AS points,
        concat(type, ' ', CAST(markup_id % 10 AS VARCHAR(9))) AS name, CASE WHEN k % 9 = 0 THEN NULL ELSE k * 0.25e0 END AS unit_cost
        FROM (SELECT user_id AS project_id, event_id AS markup_id, {kind} AS type, value AS v, {k} AS k FROM events)"""


def requests(duck: bool = False) -> str:
    # a timestamp without a zone has no epoch in Spark: its parts count the same in any session's zone
    parts = "datediff(ts, DATE '1970-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT)"
    ms = "epoch_us(ts) // 1000" if duck else parts
    return f"SELECT event_id, user_id AS identity, ts, {ms} AS ts_ms FROM events"


FIXTURES = {"projects": projects, "rooms": rooms, "materials": materials, "bridge": bridge, "markups": markups, "requests": requests}
#: Which driver tables a fixture reads.
SOURCES = {"projects": ["customer"], "rooms": ["orders"], "materials": ["part"], "bridge": ["lineitem", "orders"], "markups": ["events"], "requests": ["events"]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES[name]}
    text = FIXTURES[name]()
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **tables)


def duck(*names: str) -> str:
    """A WITH clause that defines fixtures in DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({FIXTURES[n](True)})" for n in names)
