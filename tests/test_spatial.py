"""The grid join against all pairs, and on a project with very many rooms and pointers."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import spatial

BOX = "project_id bigint, {} bigint, minx double, miny double, maxx double, maxy double"


def boxes(n, seed, sizes):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, s = r.choice([r.uniform(-300, 300), float(r.randint(-8, 8) * 16)]), r.choice([r.uniform(-300, 300), float(r.randint(-8, 8) * 16)]), r.choice(sizes)
        out.append((r.choice([1, 1, 1, 2, 3]), i, x, y, x + s * r.choice([0, 1, r.random()]), y + s * r.random()))
    return out


@pytest.mark.parametrize("left,right", [([0.0], [3.0, 40.0]), ([1.0, 16.0, 500.0], [0.0, 2.0, 16.0, 64.0]), ([4.0], [4.0])])
def test_every_pair_once(spark, left, right):
    a, b = boxes(220, 1, left), boxes(260, 2, right)
    a += [(1, 900, None, 0.0, 1.0, 1.0), (1, 901, float("inf"), 0.0, float("inf"), 1.0), (9, 902, 0.0, 0.0, 1.0, 1.0), a[0]]
    got = spatial.touching(spark.createDataFrame(a, BOX.format("a")), spark.createDataFrame(b, BOX.format("b"))).select("a", "b").collect()
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[1] not in (900, 901) and x[2] <= y[4] and x[4] >= y[2] and x[3] <= y[5] and x[5] >= y[3]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 8


def test_many_rooms_in_one_project(spark):
    """100,000 rooms and as many pointers of one project: rows in the join stay near their number (all pairs would be 10^10)."""
    n = 100_000
    rooms = spark.range(n).selectExpr("1L AS project_id", "id AS room_id", f"{G.rect('(id % 400) * 12D', '(id DIV 400) * 12D', '10D', '10D')} AS points")
    points = spark.range(n).selectExpr("id AS point_id", "1L AS project_id", "(id % 400) * 12D + (id % 11) + 0.5D AS x", "(id DIV 400) * 12D + (id % 7) * 1.75D AS y")
    top = spatial.topmost_room(rooms, points)
    sums = top.agg(F.count("room_id"), F.sum(F.when(F.col("room_id").isNotNull() & (F.col("room_id") != F.col("point_id")), 1).otherwise(0))).first()
    assert tuple(sums) == (sum(i % 11 + 0.5 < 10 and i % 7 * 1.75 < 10 for i in range(n)), 0)
    dots = points.select("point_id", "project_id", *(F.col(c).alias(f"{m}{c}") for m in ("min", "max") for c in "xy"))
    assert spatial.touching(dots, spatial._boxed(rooms)).count() < 2 * n


def test_hit_test_equals_all_pairs(spark):
    r = random.Random(6)
    rooms = spark.createDataFrame([(p, 10 * p + i, [{"x": float(x), "y": float(y)}, {"x": x + w, "y": float(y)}, {"x": x + w, "y": y + h}, {"x": float(x), "y": y + h}]) for p in (1, 2, 3) for i in range(8) for x, y, w, h in [(r.randint(0, 20), r.randint(0, 20), r.uniform(1, 15), r.uniform(1, 15))]], "project_id bigint, room_id bigint, points array<struct<x:double,y:double>>")
    rows = [(k, k % 3 + 1, r.uniform(-40, 260), r.uniform(-40, 260), [None, 0.0, 0.05, 0.2][k % 4], [0.5, 2.0, -1.0][k % 3], 80.0, 40.0, 10 * (k % 3 + 1) + k % 9) for k in range(1500)]
    pointers = spark.createDataFrame(rows, "point_id bigint, project_id bigint, sx double, sy double, scale double, zoom double, shift_x double, shift_y double, selected bigint")
    every = pointers.join(rooms, "project_id").withColumn("path", F.expr(spatial.on_screen("points", "scale", "zoom", "shift_x", "shift_y")))
    near = "CASE WHEN room_id = selected THEN get(filter(sequence(0, size(path) - 1), i -> hypot(sx - path[i].x, sy - path[i].y) < 9.0), 0) END"
    hits = every.withColumn("vertex", F.expr(near)).where(F.col("vertex").isNotNull() | F.expr(G.contains("sx", "sy", "path"))).groupBy("point_id").agg(F.max(F.struct("room_id", "vertex")).alias("t"))
    want = sorted((x["point_id"], x["t"]["room_id"], x["t"]["vertex"]) for x in hits.collect())
    got = sorted((x["point_id"], x["room_id"], x["vertex"]) for x in spatial.hit_test(rooms, pointers).where("room_id IS NOT NULL").collect())
    assert got == want and len(want) > 60 and any(v is not None for *_, v in want)


def test_rooms_are_not_drawn_again_for_every_corner(spark):
    """A filter that is pushed below the drawing of a room held it once for each corner's coordinate."""
    rooms = spark.sql("SELECT 1L AS project_id, 2L AS room_id, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 8D, 'y', 0D), named_struct('x', 8D, 'y', 8D), named_struct('x', 0D, 'y', 8D)) AS points")
    points = spark.sql("SELECT id AS point_id, 1L AS project_id, 0.5D AS scale, 2L AS selected, 1D AS zoom, 0D AS shift_x, 0D AS shift_y, id * 4D - 8D AS sx, id * 4D - 8D AS sy FROM range(10)")
    hits = spatial.hit_test(rooms, points)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("transform(points") <= 10
    assert {x["point_id"]: (x["room_id"], x["vertex"]) for x in hits.collect()} == {0: (None, None), 1: (2, 0), 2: (2, 0), 3: (2, 0), 4: (2, None), 5: (2, 2), 6: (2, 2), 7: (2, 2), 8: (None, None), 9: (None, None)}
