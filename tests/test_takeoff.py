"""Golden values of geometry, layouts, cuts, estimates, units and markups."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import geometry as G
from tessera.functions import units as U
from tessera.operators import cuts, estimate, layout


def rect(w, h, x=0.0, y=0.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def one(spark, sql, points=None):
    df = spark.range(1)
    if points is not None:
        df = spark.createDataFrame([([(float(a), float(b)) for a, b in points],)], f"p {schema.POINTS}")
    return df.select(F.expr(sql).alias("v")).first()["v"]


def pairs(spark, rooms, tile, grout=0.0, pattern="grid", **more):
    """rooms: (name, points)."""
    r = spark.createDataFrame([(1, i, i, n, [(float(a), float(b)) for a, b in p], 8.0, pattern) for i, (n, p) in enumerate(rooms)], schema.ROOM)
    m = dict(material_id=7, name="m", type="floor", tw=float(tile[0]), th=float(tile[1]), grout=grout, pattern=pattern, waste=10.0, price=5.0, price_unit="sf", sf_per_box=15.0, face_coverage=1.0, cost_mode="waste", optimize_whole_job=False, cut_safety_pct=5.0, grain_locked=None) | more
    m = spark.createDataFrame([m], schema.MATERIAL)
    b = spark.createDataFrame([(1, i, 7) for i in range(len(rooms))], schema.BRIDGE)
    return r, m, b


def counts(spark, rooms, tile, mode="practical", **more):
    row = cuts.analyze(layout.assigned(*pairs(spark, rooms, tile, **more)), [mode]).first()
    return row


def test_area_and_perimeter(spark):
    assert one(spark, G.area("p"), rect(10, 12)) == 120
    assert one(spark, G.perimeter("p"), rect(10, 12)) == 44
    assert one(spark, G.area("p"), [(0, 0), (4, 0), (0, 3)]) == 6
    assert one(spark, G.area("p"), rect(10, 12)[::-1]) == 120
    assert one(spark, G.area("p"), [(0, 0), (1, 1)]) == 0
    assert tuple(one(spark, G.centroid("p"), rect(10, 12))) == (5, 6)


@pytest.mark.parametrize("at,area", [((9.5, 2), 0.5), ((9.5, 11.5), 0.25), ((2, 2), 1), ((20, 20), 0)])
def test_clipped_area(spark, at, area):
    assert one(spark, G.clipped_area(f"{at[0]}D", f"{at[1]}D", "1D", "1D", "p"), rect(10, 12)) == pytest.approx(area)


@pytest.mark.parametrize("at,cls", [((2, 2), "full"), ((20, 20), "out"), ((9.5, 2), "cut"), ((0, 0), "full")])
def test_classify(spark, at, cls):
    assert one(spark, G.classify(f"{at[0]}D", f"{at[1]}D", "1D", "1D", G.edges("p")), rect(10, 10)) == cls


@pytest.mark.parametrize("size,tile,full,cut", [((10, 12), 12, 120, 0), ((11.5, 12), 12, 132, 12), ((13, 11), 24, 30, 12)])
def test_tally(spark, size, tile, full, cut):
    row = layout.tally(layout.assigned(*pairs(spark, [("a", rect(*size))], (tile, tile))), "material_id").first()
    assert (row["full"], row["cut"], row["total"]) == (full, cut, full + cut)


@pytest.mark.parametrize(
    "rooms,tile,more,mode,expected",
    [
        ([("a", rect(12.25, 12.25))], (12, 12), {}, "practical", (144, 25, 7, 18)),
        ([("a", rect(11.3, 9.7))], (12, 12), {}, "practical", (99, 21, 14, 7)),
        ([("a", rect(11.3, 9.7))], (12, 12), {}, "optimize", (99, 21, 11, 10)),
        ([("a", rect(11.5, 8)), ("b", rect(11.5, 5))], (12, 12), {}, "practical", (143, 13, 7, 6)),
        ([("a", rect(10, 9.3))], (6, 24), {}, "optimize", (80, 20, 20, 0)),
        ([("a", rect(12.25, 12.25))], (12, 12), {"grout": 0.125}, "practical", (144, 25, 3, 22)),
        ([("a", rect(12.25, 12.25))], (12, 12), {"pattern": "brick_50"}, "practical", (138, 31, 11, 20)),
        ([("a", rect(12.25, 12.25))], (12, 12), {"pattern": "brick_33"}, "practical", (138, 31, 14, 17)),
        ([("a", rect(12.25, 12.25))], (12, 12), {"pattern": "herringbone"}, "practical", (72, 12, 3, 9)),
        ([("a", rect(12.25, 12.25))], (12, 12), {"pattern": "basketweave"}, "practical", (72, 19, 3, 16)),
        ([("a", [(0, 0), (10, 0), (0, 8)])], (12, 12), {}, "practical", (32, 16, 12, 4)),
        ([("a", [(0, 0), (12.25, 0), (12.25, 6.5), (6.5, 6.5), (6.5, 12.25), (0, 12.25)])], (12, 12), {}, "practical", (108, 1, 1, 0)),
    ],
)
def test_cuts(spark, rooms, tile, more, mode, expected):
    row = counts(spark, rooms, tile, mode, **more)
    assert (row["full_tiles"], row["cut_pieces"], row["new_tiles"], row["reused"]) == expected
    assert row["total_tiles"] == row["full_tiles"] + row["new_tiles"] <= row["naive_total"]
    assert row["saved"] == row["cut_pieces"] - row["new_tiles"]


def test_plank_is_grain_locked(spark):
    assert counts(spark, [("a", rect(10, 9.3))], (6, 24))["grain_locked"]
    assert not counts(spark, [("a", rect(10, 9.3))], (12, 12))["grain_locked"]


def test_diagonal_counts_as_grid(spark):
    a, b = (counts(spark, [("a", rect(12.25, 9.4))], (12, 12), pattern=p) for p in ("grid", "diagonal"))
    assert (a["full_tiles"], a["cut_pieces"], a["new_tiles"]) == (b["full_tiles"], b["cut_pieces"], b["new_tiles"])


def lines(spark, size, with_cuts=False, **more):
    r, m, b = pairs(spark, [("a", rect(*size))], (12, 12), **more)
    analysis = cuts.analyze(layout.assigned(r, m, b), None) if with_cuts else None
    return estimate.estimate_lines(estimate.material_areas(r, m, b), m, analysis)


@pytest.mark.parametrize("more,qty,cost", [({}, 132, 660), ({"price_unit": "tile", "price": 2.0}, 132, 264), ({"price_unit": "box", "price": 30.0}, 9, 270)])
def test_waste_estimate(spark, more, qty, cost):
    row = lines(spark, (10, 12), **more).first()
    assert row["tiles"] == 132 and row["qty"] == pytest.approx(qty) and row["cost"] == pytest.approx(cost)


def test_cuts_estimate(spark):
    row = lines(spark, (12.25, 12.25), True, cost_mode="cuts").first()
    assert row["tiles"] == 159 and row["mode"] == "cuts"
    row = lines(spark, (12.25, 12.25), True, cost_mode="cuts", price_unit="box", sf_per_box=14.0).first()
    assert row["qty"] == 12


def test_wall_and_project(spark):
    assert lines(spark, (10, 12), type="wall").first()["net_sf"] == 352
    r, m, b = pairs(spark, [("a", rect(10, 12))], (12, 12))
    p = spark.createDataFrame([(1, "p", "imperial_ft_in", None, 10.0, 3.0), (2, "q", "imperial_ft_in", 0.05, 10.0, 3.0)], schema.PROJECT)
    rows = {x["project_id"]: x for x in estimate.estimate_projects(p, r, estimate.estimate_lines(estimate.material_areas(r, m, b), m)).collect()}
    assert rows[1]["labor"] == 360 and rows[1]["subtotal"] == pytest.approx(1020) and rows[1]["tax"] == pytest.approx(102) and rows[1]["total"] == pytest.approx(1122)
    assert rows[1]["calibrated_sf"] == 0 and rows[2]["total"] == 0


@pytest.mark.parametrize("text,feet", [("12'6\"", 12.5), ("12' 6 1/2\"", 12 + 6.5 / 12), ("0'-3\"", 0.25), ("3.81m", 12.5), ("150in", 12.5), ("12", 12), ("12abc", 12), ("11/2", 1 + 0.5 / 12), ("12 1/2", 12 + 0.5 / 12), ("-0'6\"", 0.5), ("1.2.3mm", None), ("", None), ("x", None), ("381 cm", 12.5), ("-2'-6\"", -2.5)])
def test_parse_length(spark, text, feet):
    got = spark.createDataFrame([(text,)], "t string").select(F.expr(U.parse_length("t", "'imperial_ft_in'")).alias("v")).first()["v"]
    assert got is None if feet is None else got == pytest.approx(feet, abs=1e-4)


@pytest.mark.parametrize("feet,text", [(12.5, "12'-6\""), (10, "10'"), (0.9999, "1'"), (-2.5, "-2'-6\""), (6.5 / 12, "0'-6 1/2\""), (11.999, "12'")])
def test_feet_inches(spark, feet, text):
    assert one(spark, U.feet_inches(f"CAST({feet} AS DOUBLE)")) == text


def test_numbers(spark):
    assert one(spark, U.rounded("1.005D")) == 1.01
    assert one(spark, U.snap("12.3D", "0.5D")) == 12.5
    assert one(spark, U.number("100D")) == "100" and one(spark, U.number("12.50D")) == "12.5"
    assert one(spark, U.rounded("-2.5D", 0)) == -2
    assert one(spark, U.csv_cell("'=1+1'")) == "'=1+1" and one(spark, U.csv_cell("'a\"b'")) == '"a""b"'
    assert one(spark, G.to_px("1D", "0.05D")) == 20
    assert one(spark, U.html("'<b>&'")) == "&lt;b&gt;&amp;"
    assert one(spark, U.rgba("'#1d4e6b'", "0.5")) == "rgba(29,78,107,0.5)"


def test_near_points(spark):
    p = [(0, 0), (0.01, 0), (0.019, 0), (0.03, 0), (5, 5), (5, 5)]
    assert [tuple(x) for x in one(spark, G.without_near_points("p"), p)] == [(0, 0), (0.03, 0), (5, 5)]
    assert one(spark, G.path_length("p"), [(0, 0), (3, 0), (3, 4)]) == 7


def test_fold_invariants():
    sizes = [(w / 100, h / 100) for w in range(700, 1400, 37) for h in range(600, 1300, 53)]
    for w, h in sizes[::7]:
        needs = [(w % 1 or 1, 1.0, "a")] * int(h) + [(1.0, h % 1 or 1, "a")] * int(w)
        for best in (False, True):
            broken, reused, scrap, left, steps = cuts.redistribute(needs, 1.0, 1.0, False, best)
            assert broken + reused == len(needs) == len(steps) and broken <= len(needs)
            assert math.isclose(sum(s["w"] * s["h"] for s in steps), sum(a * b for a, b, _ in needs))


def test_layout_origin_angle_and_rotation(spark):
    r, m, b = pairs(spark, [("a", rect(4, 3))], (12, 12))
    at = lambda **more: layout.assigned(r.withColumns({k: F.lit(v) for k, v in more.items()}), m, b)
    assert tuple(layout.tally(at(), "material_id").first())[1:] == (12, 0, 12)
    moved = layout.tally(at(origin_x=0.5, origin_y=0.25), "material_id").first()
    assert (moved["full"], moved["cut"]) == (3 * 2, 5 * 4 - 3 * 2)
    turned = layout.generate(at(angle_deg=30.0), "room_id")
    assert {round(x["rot"], 9) for x in turned.collect()} == {round(math.pi / 6, 9)}
    for pattern, rot in (("diagonal", math.pi / 4), ("herringbone", 0), ("basketweave", 0)):
        tiles = layout.generate(layout.assigned(r.withColumns({"pattern": F.lit(pattern), "angle_deg": F.lit(30.0)}), m, b), "room_id").collect()
        assert tiles and {round(x["rot"], 9) for x in tiles} == {round(rot, 9)}


def test_trimmed_columns_lose_no_tile(spark):
    shapes = [rect(7.3, 5.1), [(2.0, 1.0), (9.0, 2.5), (4.0, 7.0)], [(-3.0, -2.0), (5.0, -2.0), (5.0, 1.0), (1.0, 1.0), (1.0, 6.0), (-3.0, 6.0)]]
    for tile in ((12, 12), (6, 24), (3, 6)):
        for pattern in ("grid", "brick_33", "herringbone", "basketweave"):
            p = layout.assigned(*pairs(spark, [(str(i), s) for i, s in enumerate(shapes)], tile, pattern=pattern))
            p = p.withColumns({"origin_x": F.lit(0.3), "origin_y": F.lit(-0.7)})
            every = layout.generate(p.withColumn("e", F.expr(G.edges("points"))), "room_id", "e")
            cls = every.select("room_id", "r", "c", "k", F.expr(G.classify("cx - w / 2", "cy - h / 2", "w", "h", "e")).alias("cls")).where("cls <> 'out'")
            some = layout.classified(p, "room_id").select("room_id", "r", "c", "k", "cls")
            assert sorted(map(tuple, cls.collect())) == sorted(map(tuple, some.collect())), (tile, pattern)
        if tile == (3, 6):
            break


def test_cuts_follow_the_order_of_rooms(spark):
    rooms = [("a", rect(11.5, 8)), ("b", rect(11.5, 5)), ("c", rect(3.2, 4))]
    r, m, b = pairs(spark, rooms, (12, 12))
    first = lambda order: [s["room"] for s in cuts.analyze(layout.assigned(r.withColumn("room_ord", F.expr(order)), m, b), ["practical"]).first()["steps"]]
    assert first("CAST(room_id AS INT)") == sorted(first("CAST(room_id AS INT)")) and first("CAST(-room_id AS INT)") == sorted(first("CAST(-room_id AS INT)"), reverse=True)


def test_rooms_without_an_assigned_array_are_in_if_lenient(spark):
    r, m, b = pairs(spark, [("a", rect(4, 3)), ("b", rect(2, 2))], (12, 12))
    r = r.withColumn("assigned", F.expr("CASE WHEN room_id = 0 THEN array(7L) END"))
    only = b.where("room_id = 0")
    assert layout.assigned(r, m, only).count() == 1 and layout.assigned(r, m, only, lenient=True).count() == 2


def test_camera_and_fit(spark):
    from tessera.operators import spatial

    r, _, _ = pairs(spark, [("a", rect(10, 12)), ("b", rect(40, 30, 10, 0))], (12, 12))
    c = spatial.camera(r).first()
    assert (c["cx"], c["cy"], c["span"]) == (17.5, 10.5, 25.0) and c["eye_x"] == pytest.approx(17.5 + 90 * 0.6) and c["eye_z"] == pytest.approx(90 * 0.6 - 10.5)
    assert spatial.camera(pairs(spark, [("a", rect(2, 2))], (12, 12))[0]).first()["span"] == 10
    projects = spark.createDataFrame([(1, 0.05), (2, None)], "project_id bigint, scale double")
    views = {v["project_id"]: v for v in spatial.fit(r, projects).collect()}
    assert views[1]["zoom"] == pytest.approx(min(1040 / 1000, 640 / 600)) and (views[2]["zoom"], views[2]["x"], views[2]["y"]) == (1, 80, 80)


def test_detection_statuses(spark):
    from tessera.sources import detection

    rows = [("GET", None, 0, True, False, 405), ("POST", None, 10, False, True, 401), ("POST", None, 10, True, True, 429), ("POST", None, None, True, False, 400), ("POST", "text/html", 9_000_000, True, False, 413), ("POST", "text/html", 10, True, False, 400), ("POST", None, 10, True, False, 200), ("POST", "image/gif", 8_000_000, True, False, 200)]
    df = spark.createDataFrame(rows, "m string, t string, n bigint, s boolean, l boolean, want int")
    assert df.where(F.expr(detection.verdict("m", "t", "n", "s", "l")) != F.col("want")).count() == 0
