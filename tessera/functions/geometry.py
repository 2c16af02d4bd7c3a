"""Polygon functions (G1-G15) as expressions over an array of points.

Every function takes SQL text for its arguments and gives SQL text, so functions nest inside
higher-order lambdas; `col()` turns the text into a Column. All arithmetic is in doubles and
in a fixed order, as ceilings later depend on the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(sql: str) -> Column:
    return F.expr(sql)


def total(array: str) -> str:
    """Sum of an array of doubles, from the first."""
    return f"aggregate({array}, 0e0D, (s, v) -> s + v)".replace("0e0D", "0D")


def following(points: str, i: str = "i") -> str:
    return f"get({points}, ({i} + 1) % size({points}))"


def signed_area(p: str) -> str:
    """G9."""
    q = following(p)
    return f"({total(f'transform({p}, (v, i) -> v.x * {q}.y - {q}.x * v.y)')} / 2)"


def area(p: str) -> str:
    """G1: 0 under three points, whatever the winding."""
    return f"CASE WHEN size({p}) < 3 THEN 0D ELSE abs({signed_area(p)}) END"


def perimeter(p: str) -> str:
    """The closing edge counts."""
    q = following(p)
    return total(f"transform({p}, (v, i) -> hypot({q}.x - v.x, {q}.y - v.y))")


def bounds(p: str) -> str:
    """Nulls for no points."""
    low = lambda a: f"array_min(transform({p}, v -> v.{a}))"
    high = lambda a: f"array_max(transform({p}, v -> v.{a}))"
    return f"named_struct('minx', {low('x')}, 'miny', {low('y')}, 'maxx', {high('x')}, 'maxy', {high('y')}, 'w', {high('x')} - {low('x')}, 'h', {high('y')} - {low('y')})"


def centroid(p: str) -> str:
    """The mean of the vertices; nulls for no points."""
    mean = lambda a: f"try_divide({total(f'transform({p}, v -> v.{a})')}, size({p}))"
    return f"named_struct('x', {mean('x')}, 'y', {mean('y')})"


def edges(p: str) -> str:
    """Edges from each vertex to the one before it, as the even-odd test walks them; level ones never count and go."""
    before = f"get({p}, (i + size({p}) - 1) % size({p}))"
    return f"filter(transform({p}, (v, i) -> named_struct('xi', v.x, 'yi', v.y, 'xj', {before}.x, 'yj', {before}.y)), e -> e.yi <> e.yj)"


def crossings(y: str, e: str) -> str:
    """Where edges cross the height y."""
    return f"transform(filter({e}, e -> (e.yi > {y}) <> (e.yj > {y})), e -> (e.xj - e.xi) * ({y} - e.yi) / (e.yj - e.yi) + e.xi)"


def inside_crossings(x: str, at: str) -> str:
    return f"(size(filter({at}, v -> {x} < v)) % 2)"


def contains(x: str, y: str, p: str) -> str:
    """Even-odd, borders as the half-open test has them."""
    return f"({inside_crossings(x, crossings(y, edges(p)))} = 1)"


def corners_inside(x: str, y: str, w: str, h: str, e: str) -> str:
    """How many corners, moved in by 2 % of the shorter side, lie inside; each height's crossings are found once."""
    inset = f"least({w}, {h}) * 0.02D"
    left, right = f"{x} + {inset}", f"{x} + {w} - {inset}"
    row = lambda y_: f"element_at(transform(array({crossings(y_, e)}), a -> {inside_crossings(left, 'a')} + {inside_crossings(right, 'a')}), 1)"
    return f"({row(f'{y} + {inset}')} + {row(f'{y} + {h} - {inset}')})"


def class_of(corners: str, x: str, y: str, w: str, h: str, e: str) -> str:
    """G6 from the number of corners inside; the centre decides just where there is none."""
    centre = f"{inside_crossings(f'{x} + {w} / 2', crossings(f'{y} + {h} / 2', e))} = 1"
    return f"CASE WHEN {corners} = 4 THEN 'full' WHEN {corners} > 0 THEN 'cut' WHEN {centre} THEN 'cut' ELSE 'out' END"


def classify(x: str, y: str, w: str, h: str, e: str) -> str:
    """G6: 'full', 'cut' or 'out'."""
    return f"element_at(transform(array({corners_inside(x, y, w, h, e)}), n -> {class_of('n', x, y, w, h, e)}), 1)"


def rect(x: str, y: str, w: str, h: str) -> str:
    """Clockwise on a screen from the top left."""
    return f"array(named_struct('x', {x}, 'y', {y}), named_struct('x', {x} + {w}, 'y', {y}), named_struct('x', {x} + {w}, 'y', {y} + {h}), named_struct('x', {x}, 'y', {y} + {h}))"


def sides(window: str) -> str:
    """A clip window's edges, each with the sign of its inner side; once for a room, not for each tile."""
    edge = f"named_struct('ax', v.x, 'ay', v.y, 'bx', {following(window)}.x, 'by', {following(window)}.y, 's', o)"
    return f"element_at(transform(array(CASE WHEN {signed_area(window)} < 0 THEN -1D ELSE 1D END), o -> transform({window}, (v, i) -> {edge})), 1)"


def clip(subject: str, window: str) -> str:
    """G8 with G10 and G11: the part of `subject` inside all half-planes of the window's edges, one after another.

    Exact for a convex window; of a concave one the common part of its half-planes.
    """
    return clip_sides(subject, sides(window))


def clip_sides(subject: str, of: str) -> str:
    # each point with its side of the line: 0 or more (to 1e-9) is inside
    placed = "transform(pts, p -> named_struct('x', p.x, 'y', p.y, 'c', e.s * ((e.bx - e.ax) * (p.y - e.ay) - (e.by - e.ay) * (p.x - e.ax))))"
    a1, b1 = "(e.by - e.ay)", "(e.ax - e.bx)"
    c1 = f"({a1} * e.ax + {b1} * e.ay)"
    a2, b2 = "(q.y - p.y)", "(p.x - q.x)"
    c2 = f"({a2} * p.x + {b2} * p.y)"
    d = f"({a1} * {b2} - {a2} * {b1})"
    meet = f"""CASE WHEN abs({d}) < 1e-12D THEN named_struct('x', q.x, 'y', q.y)
        ELSE named_struct('x', try_divide({b2} * {c1} - {b1} * {c2}, {d}), 'y', try_divide({a1} * {c2} - {a2} * {c1}, {d})) END"""
    here = "named_struct('x', q.x, 'y', q.y)"
    none = "CAST(array() AS array<struct<x:double,y:double>>)"
    step = f"""flatten(transform(transform(s, (p, j) -> named_struct('p', p, 'q', get(s, (j + 1) % size(s)))), k ->
        element_at(transform(array(named_struct('p', k.p, 'q', k.q)), o -> {_let('o', meet, here, none)}), 1)))"""
    return f"aggregate({of}, transform({subject}, v -> named_struct('x', v.x, 'y', v.y)), (pts, e) -> element_at(transform(array({placed}), s -> {step}), 1))"


def _let(o: str, meet: str, here: str, none: str) -> str:
    """The points that a step from o.p to o.q adds."""
    put = lambda t: t.replace("p.x", f"{o}.p.x").replace("p.y", f"{o}.p.y").replace("q.x", f"{o}.q.x").replace("q.y", f"{o}.q.y")
    return f"CASE WHEN {o}.p.c >= -1e-9D AND {o}.q.c >= -1e-9D THEN array({put(here)}) WHEN {o}.p.c >= -1e-9D THEN array({put(meet)}) WHEN {o}.q.c >= -1e-9D THEN array({put(meet)}, {put(here)}) ELSE {none} END"


def clipped_area(x: str, y: str, w: str, h: str, window: str) -> str:
    """G12."""
    return f"element_at(transform(array({clip(rect(x, y, w, h), window)}), c -> {area('c')}), 1)"


def axis_lock(ax: str, ay: str, bx: str, by: str) -> str:
    """The end of a segment moved onto its longer axis; a tie is vertical."""
    return f"CASE WHEN abs({bx} - {ax}) > abs({by} - {ay}) THEN named_struct('x', {bx}, 'y', {ay}) ELSE named_struct('x', {ax}, 'y', {by}) END"


def to_px(ft: str, scale: str) -> str:
    """Without a scale the number stays."""
    return f"CASE WHEN coalesce({scale}, 0D) = 0 THEN {ft} ELSE try_divide({ft}, {scale}) END"


def to_ft(px: str, scale: str) -> str:
    return f"CASE WHEN coalesce({scale}, 0D) = 0 THEN {px} ELSE {px} * {scale} END"


def to_screen(m: str, zoom: str, shift: str) -> str:
    return f"({m} * {zoom} + {shift})"


def to_model(s: str, zoom: str, shift: str) -> str:
    return f"try_divide({s} - {shift}, {zoom})"


def without_near_points(p: str, gap: str = "0.02D") -> str:
    """P10: drops a point that lies within `gap` of the last point kept."""
    empty = "CAST(array() AS array<struct<x:double,y:double>>)"
    return f"aggregate({p}, {empty}, (k, v) -> CASE WHEN size(k) = 0 OR hypot(v.x - element_at(k, -1).x, v.y - element_at(k, -1).y) > {gap} THEN array_append(k, named_struct('x', v.x, 'y', v.y)) ELSE k END)"


def path_length(p: str) -> str:
    """An open line's length."""
    return f"CASE WHEN size({p}) < 2 THEN 0D ELSE {total(f'transform(slice({p}, 2, size({p}) - 1), (v, i) -> hypot(v.x - get({p}, i).x, v.y - get({p}, i).y))')} END"
