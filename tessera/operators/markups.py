"""Measurement markups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import geometry as G
from ..functions import units as U

_SPAN = lambda a: f"abs(get(points, 1).{a} - get(points, 0).{a})"


def measured(markups: DataFrame) -> DataFrame:
    """`markups` with value, unit, cost, and box_w and box_h of rectangles and ellipses. Annotations are worth 0."""
    two = "coalesce(size(points), 0) >= 2"
    value = f"""CASE type WHEN 'length' THEN {G.path_length('points')} WHEN 'area' THEN {G.area('points')}
        WHEN 'rect' THEN CASE WHEN {two} THEN {_SPAN('x')} * {_SPAN('y')} ELSE 0D END
        WHEN 'ellipse' THEN CASE WHEN {two} THEN pi() * ({_SPAN('x')} / 2) * ({_SPAN('y')} / 2) ELSE 0D END
        WHEN 'count' THEN CAST(size(points) AS DOUBLE) ELSE 0D END"""
    box = lambda a: F.expr(f"CASE WHEN type IN ('rect', 'ellipse') AND {two} THEN {_SPAN(a)} END")
    rows = markups.withColumn("points", F.coalesce("points", F.expr("CAST(array() AS array<struct<x:double,y:double>>)")))
    return rows.withColumns({"value": F.expr(value), "unit": F.expr(C.unit_of("type")), "box_w": box("x"), "box_h": box("y")}).withColumn("cost", F.col("value") * F.coalesce("unit_cost", F.lit(0.0)))


def summarize(markups: DataFrame) -> DataFrame:
    """A row for each project and type, and one with a null type for the project's total; annotations do not count."""
    rows = measured(markups).where("unit <> ''")
    return rows.groupingSets([["project_id", "type"], ["project_id"]], "project_id", "type").agg(F.sum(F.when(F.grouping("type") == 0, F.col("value"))).alias("value"), F.sum("cost").alias("cost"), F.count("*").alias("count"), F.min("markup_id").alias("first_id"))


def labels(markups: DataFrame, projects: DataFrame) -> DataFrame:
    """V8: the text beside a markup, in the project's units."""
    rows = measured(markups).join(projects.select("project_id", "unit_system"), "project_id")
    text = f"""CASE WHEN type = 'length' THEN {U.format_length('value', 'unit_system')} WHEN type IN ('area', 'rect', 'ellipse') THEN {U.format_area('value', 'unit_system')}
        WHEN type = 'count' THEN concat(CAST(CAST(value AS BIGINT) AS STRING), ' ea') ELSE name END"""
    return rows.select("project_id", "markup_id", "type", F.expr(text).alias("label"))


def committed(drafts: DataFrame) -> DataFrame:
    """V5, P10: drafts that are large enough to become markups, near-duplicate points of lines and areas removed."""
    cleaned = drafts.withColumn("points", F.expr(f"CASE WHEN type IN ('length', 'area') THEN {G.without_near_points('points')} ELSE points END"))
    enough = f"""CASE type WHEN 'rect' THEN {_SPAN('x')} > 0.2D AND {_SPAN('y')} > 0.2D WHEN 'ellipse' THEN {_SPAN('x')} > 0.2D AND {_SPAN('y')} > 0.2D
        WHEN 'arrow' THEN hypot({_SPAN('x')}, {_SPAN('y')}) > 0.1D WHEN 'area' THEN size(points) >= 3 WHEN 'length' THEN size(points) >= 2 ELSE true END"""
    return cleaned.where(enough)


def accumulated(clicks: DataFrame) -> DataFrame:
    """V6: one count markup for each run of clicks (project_id, run_id, ord, x, y), its points in the order of the clicks.

    A run is one use of the count tool; it bounds the array.
    """
    points = F.transform(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    return clicks.groupBy("project_id", "run_id").agg(points.alias("points")).select("project_id", F.col("run_id").alias("markup_id"), F.lit("count").alias("type"), "points", F.lit("Count").alias("name"))
