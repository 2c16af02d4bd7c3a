"""Picking, snapping and fitting.

Rooms meet pointers and drags of their own project in the cells of a grid (touching()), so each of these is an
equi-join on project and cell with a spatial test behind it, however many rooms a project has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import units as U
from .layout import contained, corners_of


def _ordered(rooms: DataFrame) -> DataFrame:
    """A struct to order a project's rooms by, from the lowest to the topmost."""
    return F.struct("room_ord", "room_id") if "room_ord" in rooms.columns else F.struct("room_id")


#: A box's level is the even power of two that its longer side reaches, its cells that wide, so it meets few of them.
_LEVEL = "CAST(coalesce(2 * ceil(log2(greatest(maxx - minx, maxy - miny)) / 2), -40) AS INT)"


def touching(left: DataFrame, right: DataFrame) -> DataFrame:
    """All columns of both for the boxes (project_id, minx, miny, maxx, maxy) of a project that share a point, borders included.

    Boxes go into grid cells as wide as the larger box of a pair: a box is put into cells of its own level, and of those
    higher levels that the other side has in its project (half a hundred at most). A pair of levels meets in one way only, and a pair
    of boxes counts in the cell of the least corner of what they share, so none comes twice. Null coordinates touch nothing; infinite ones neither.
    What is left to one key is a cell with many boxes of both sides. `right` columns that `left` has too, but for project_id, must not exist.
    """
    box = ("minx", "miny", "maxx", "maxy")
    real = " AND ".join(f"abs({c}) < double('Infinity')" for c in box)
    a, b = (d.where(real).withColumn("__level", F.expr(_LEVEL)) for d in (left, right.withColumnsRenamed({c: f"__{c}" for c in box}).withColumns({c: F.col(f"__{c}") for c in box})))
    levels = lambda d: d.groupBy("project_id").agg(F.collect_set("__level").alias("__others"))

    def celled(d: DataFrame, others: DataFrame, ways: str) -> DataFrame:
        each = d.join(others, "project_id").select(*d.columns, F.inline(F.expr(ways)))
        span = lambda c: F.explode(F.expr(f"sequence(CAST(floor(min{c} / pow(2D, __at)) AS BIGINT), CAST(floor(max{c} / pow(2D, __at)) AS BIGINT))")).alias(f"__c{c}")
        return each.select("*", span("x")).select("*", span("y"))

    way = lambda at, kind: f"named_struct('__at', {at}, '__way', {kind})"
    # way 0: the left box is the larger one or as large; way 1: the right one is larger
    a = celled(a, levels(b), f"concat(IF(exists(__others, l -> l <= __level), array({way('__level', 0)}), array()), transform(filter(__others, l -> l > __level), l -> {way('l', 1)}))")
    b = celled(b, levels(left.where(real).withColumn("__level", F.expr(_LEVEL))), f"concat(transform(filter(__others, l -> l >= __level), l -> {way('l', 0)}), IF(exists(__others, l -> l < __level), array({way('__level', 1)}), array()))")
    met = a.join(b.drop(*box, "__level"), ["project_id", "__at", "__way", "__cx", "__cy"])
    share = "minx <= __maxx AND maxx >= __minx AND miny <= __maxy AND maxy >= __miny"
    first = " AND ".join(f"floor(greatest(min{c}, __min{c}) / pow(2D, __at)) = __c{c}" for c in "xy")
    return met.where(f"{share} AND {first}").select(*left.columns, *(c for c in right.columns if c != "project_id" and c not in box))


def _boxed(rooms: DataFrame, *more) -> DataFrame:
    """project_id, room_id, `more` and the bounds of each room with corners."""
    return rooms.where("size(points) > 0").select("project_id", "room_id", *more, F.expr(G.bounds("points")).alias("__b")).select("*", "__b.minx", "__b.miny", "__b.maxx", "__b.maxy").drop("__b")


def topmost_room(rooms: DataFrame, points: DataFrame) -> DataFrame:
    """Points (point_id, project_id, x, y) with the last room of their project that contains them, or null."""
    dots = points.select("point_id", "project_id", "x", "y", *(F.col(c).alias(f"{m}{c}") for m in ("min", "max") for c in "xy"))
    inside = touching(dots, _boxed(rooms, "points", _ordered(rooms).alias("place"))).where(F.expr(G.contains("x", "y", "points")))
    top = inside.groupBy("point_id").agg(F.max_by("room_id", "place").alias("room_id"))
    return points.join(top, "point_id", "left").select("point_id", "project_id", "x", "y", "room_id")


def on_screen(points: str, scale: str, zoom: str, shift_x: str, shift_y: str) -> str:
    """SQL for vertices in screen pixels."""
    at = lambda a, shift: G.to_screen(G.to_px(f"p.{a}", scale), zoom, shift)
    return f"transform({points}, p -> named_struct('x', {at('x', shift_x)}, 'y', {at('y', shift_y)}))"


def _under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose pointer is near a vertex or inside the room as it is on the screen. As an expression, a filter would draw the room anew for every corner."""
    for b in batches:
        _, _, owner, x, y, before, _ = corners_of(b.column("points"))
        scale, zoom, shift_x, shift_y, sx, sy = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("scale", "zoom", "shift_x", "shift_y", "sx", "sy"))
        scaled = (np.nan_to_num(scale, nan=0.0) != 0)[owner]
        by = np.where(scaled, scale[owner], 1.0)
        inside = contained(sx, sy, owner, x / by * zoom[owner] + shift_x[owner], y / by * zoom[owner] + shift_y[owner], before)
        yield b.select(["point_id", "room_id", "place", "vertex"]).filter(pa.array(inside | b.column("vertex").is_valid().to_numpy(zero_copy_only=False)))


def hit_test(rooms: DataFrame, pointers: DataFrame, reach: float = 9.0) -> DataFrame:
    """V4: for pointers (point_id, project_id, sx, sy, scale, zoom, shift_x, shift_y, selected) the topmost room under them, or null.

    A room is under a pointer if its polygon on the screen contains it, or if it is the selected room and a vertex is nearer
    than `reach` pixels; `vertex` is the first such vertex (from 0), else null. Candidates are the rooms whose bounds in feet
    lie within `reach` of the pointer, taken back to feet. At zoom 0 nothing is hit.
    """
    feet = lambda s, shift: G.to_ft(G.to_model(s, "zoom", shift), "scale")
    near_by = pointers.withColumns({"__x": F.expr(feet("sx", "shift_x")), "__y": F.expr(feet("sy", "shift_y")), "__r": F.abs(F.expr(feet(f"{reach + 1}D", "0D")))})
    around = near_by.select(*pointers.columns, *(F.expr(f"__{c} {sign} __r").alias(f"{m}{c}") for m, sign in (("min", "-"), ("max", "+")) for c in "xy"))
    joined = touching(around, _boxed(rooms, "points", _ordered(rooms).alias("place")))
    shown = lambda a: G.to_screen(G.to_px(f"p.{a}", "scale"), "zoom", f"shift_{a}")
    near = f"CASE WHEN room_id = selected THEN get(filter(transform(points, (p, i) -> IF(hypot(sx - {shown('x')}, sy - {shown('y')}) < {reach}, i, NULL)), i -> i IS NOT NULL), 0) END"
    drawn = joined.select("point_id", "room_id", "place", F.expr(near).alias("vertex"), "points", "scale", "zoom", "shift_x", "shift_y", "sx", "sy")
    kept = ["point_id", "room_id", "place", "vertex"]
    hits = drawn.mapInArrow(_under, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in drawn.select(*kept).schema.fields))
    top = hits.groupBy("point_id").agg(F.max_by(F.struct("room_id", "vertex"), "place").alias("top"))
    return pointers.join(top, "point_id", "left").select("point_id", "project_id", "top.room_id", "top.vertex")


def marquee(rooms: DataFrame, drags: DataFrame, least: float = 3.0) -> DataFrame:
    """For drags (drag_id, project_id, x0, y0, x1, y1) the rooms whose bounds the rectangle touches; short drags pick nothing.

    Drags and rooms are in one system of coordinates: pass rooms through on_screen() for drags in pixels.
    """
    real = drags.where(F.expr(f"hypot(x1 - x0, y1 - y0) >= {least}"))
    box = real.select("drag_id", "project_id", *(F.expr(f"{f}({c}0, {c}1)").alias(f"{m}{c}") for m, f in (("min", "least"), ("max", "greatest")) for c in "xy"))
    return touching(box, _boxed(rooms)).select("drag_id", "project_id", "room_id")


def selection(hits: DataFrame, drags: DataFrame, selected: DataFrame) -> DataFrame:
    """What is selected after each drag: its hits, and for drags with `add` the rooms that were (project_id, room_id) selected; each once."""
    kept = drags.where("add").select("drag_id", "project_id").join(selected.select("project_id", "room_id"), "project_id")
    return hits.select("drag_id", "project_id", "room_id").unionByName(kept.select("drag_id", "project_id", "room_id")).distinct()


def toggled_selection(selected: DataFrame, clicks: DataFrame) -> DataFrame:
    """Rooms (project_id, room_id) selected after clicks that each turn a room on or off: those touched an odd number of times, the first selection counting once."""
    touched = selected.select("project_id", "room_id").distinct().unionByName(clicks.select("project_id", "room_id"))
    return touched.groupBy("project_id", "room_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("project_id", "room_id")


def drawn_rooms(drags: DataFrame) -> DataFrame:
    """V1: rectangles from drags, sides snapped to half a foot if the project has a scale; small ones go."""
    side = lambda a: F.expr(f"CASE WHEN coalesce(scale, 0D) <> 0 THEN {U.snap(f'({a}1 - {a}0)', '0.5D')} ELSE {a}1 - {a}0 END")
    sized = drags.withColumns({"__w": side("x"), "__h": side("y")})
    rect = sized.select("drag_id", "project_id", F.expr("least(x0, x0 + __w)").alias("x"), F.expr("least(y0, y0 + __h)").alias("y"), F.abs("__w").alias("w"), F.abs("__h").alias("h"))
    return rect.where("w > 0.3 AND h > 0.3")


def moved(rooms: DataFrame, dx: str, dy: str, step: str = "0.25D") -> DataFrame:
    """V2: rooms shifted by the SQL distances dx and dy, every vertex snapped."""
    return rooms.withColumn("points", F.expr(f"transform(points, p -> named_struct('x', {U.snap(f'p.x + {dx}', step)}, 'y', {U.snap(f'p.y + {dy}', step)}))"))


def resized(rooms: DataFrame, w: str, h: str) -> DataFrame:
    """A rectangle with the old least corner and new sides, 0.25 at least."""
    b = G.bounds("points")
    return rooms.withColumn("__b", F.expr(b)).withColumn("points", F.expr(G.rect("__b.minx", "__b.miny", f"greatest(0.25D, {w})", f"greatest(0.25D, {h})"))).drop("__b")


def fit(rooms: DataFrame, projects: DataFrame, width: float = 1200.0, height: float = 800.0, pad: float = 80.0) -> DataFrame:
    """The view of each project that shows all its rooms, which are drawn in pixels by the project's scale; zoom within 0.05 and 8. Without rooms the view is the plain one."""
    boxed = rooms.select("project_id", F.expr(G.bounds("points")).alias("b")).groupBy("project_id").agg(*(F.expr(f"{f}(b.{f}{a})").alias(f"{f}{a}") for f in ("min", "max") for a in "xy"))
    drawn = projects.select("project_id", "scale").join(boxed, "project_id", "left").select("project_id", *(F.expr(G.to_px(c, "scale")).alias(c) for c in ("minx", "miny", "maxx", "maxy")))
    side = lambda a: F.coalesce(F.nullif(F.col(f"max{a}") - F.col(f"min{a}"), F.lit(0.0)), F.lit(1.0))
    sized = drawn.withColumns({"bw": side("x"), "bh": side("y")})
    inner_w, inner_h = width - 2 * pad, height - 2 * pad
    zoomed = sized.withColumn("zoom", F.when(F.col("minx").isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(8.0), F.least(inner_w / F.col("bw"), inner_h / F.col("bh"))))))
    shift = lambda a, inner: F.coalesce(pad - F.col(f"min{a}") * F.col("zoom") + (inner - F.col(f"b{'w' if a == 'x' else 'h'}") * F.col("zoom")) / 2, F.lit(80.0)).alias(a)
    return zoomed.select("project_id", "zoom", shift("x", inner_w), shift("y", inner_h))


def camera(rooms: DataFrame) -> DataFrame:
    """The middle of each project's room centres, the span (largest distance of a vertex from its own room's centre, 10 at least), and the camera's place."""
    reach = "array_max(transform(points, p -> hypot(p.x - c.x, p.y - c.y)))"
    spans = rooms.select("project_id", "points", F.expr(G.centroid("points")).alias("c")).select("project_id", "c.x", "c.y", F.expr(reach).alias("reach"))
    seen = spans.groupBy("project_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.greatest(F.lit(10.0), F.max("reach")).alias("span"))
    far = seen.withColumn("far", F.expr("greatest(20D, span * 3D + 15D)"))
    return far.select("project_id", "cx", "cy", "span", F.expr("cx + far * 0.6D").alias("eye_x"), F.expr("far * 0.7D").alias("eye_y"), F.expr("far * 0.6D - cy").alias("eye_z"))


def plan_plane(width_px: str, height_px: str, scale: str) -> str:
    """SQL for a plan's size in feet: by the scale, else 40 ft wide."""
    known = f"coalesce({scale}, 0D) <> 0 AND coalesce({width_px}, 0D) <> 0 AND coalesce({height_px}, 0D) <> 0"
    return f"CASE WHEN {known} THEN named_struct('w', {width_px} * {scale}, 'h', {height_px} * {scale}) ELSE named_struct('w', 40D, 'h', try_divide(40D * {height_px}, {width_px})) END"
