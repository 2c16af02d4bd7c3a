"""Lookups (D1-D6, L6): fixed values, and small tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tile sizes in inches, in catalogue order, by group.
TILES = {
    "square": [(2, 2), (3, 3), (4, 4), (6, 6), (8, 8), (12, 12), (16, 16), (18, 18), (24, 24), (32, 32), (36, 36)],
    "rectangle": [(2, 4), (3, 6), (4, 8), (4, 12), (6, 12), (8, 12), (12, 24), (16, 32), (18, 36)],
    "plank": [(6, 24), (6, 36), (8, 36), (8, 48), (9, 48)],
    "mosaic": [(12, 12), (12, 12), (12, 12)],
    "metric": [(11.81, 11.81), (23.62, 23.62), (23.62, 47.24), (31.5, 31.5)],
}
#: Grout joints in inches.
GROUT = [0.0625, 0.125, 0.1875, 0.25, 0.375]
#: Suggested waste in percent for each pattern.
WASTE = {"grid": 10, "brick_50": 10, "brick_33": 12, "diagonal": 15, "herringbone": 15, "basketweave": 15}
UNIT_SYSTEMS = ["imperial_ft_in", "imperial_decft", "imperial_in", "metric_m", "metric_cm", "metric_mm"]
#: Feet for an inch of paper; then metres for a millimetre of paper.
SCALES = {"1/32": 32, "1/16": 16, "3/32": 32 / 3, "1/8": 8, "3/16": 16 / 3, "1/4": 4, "3/8": 8 / 3, "1/2": 2, "3/4": 4 / 3, "1": 1, "1-1/2": 2 / 3, "3": 1 / 3} | {f"e{n}": n for n in (10, 20, 30, 40, 50, 60, 80, 100, 200)}
METRIC_SCALES = {"1:20": 0.02, "1:50": 0.05, "1:100": 0.1, "1:200": 0.2, "1:500": 0.5}
#: The unit of each markup type; '' is an annotation.
MARKUP_UNITS = {"length": "lf", "area": "sf", "rect": "sf", "ellipse": "sf", "count": "ea", "arrow": "", "text": ""}
#: Room colours in turn.
ROOM_COLORS = ["#1d4e6b", "#a8430f", "#3a6b35", "#6b3a72", "#1f6b6b", "#8a5a14", "#444f6b", "#6b2f4a"]


def sizes() -> list[tuple[float, float]]:
    """All sizes in order."""
    return [(float(w), float(h)) for group in TILES.values() for w, h in group]


def tile_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, group, float(w), float(h)) for i, (group, (w, h)) in enumerate((g, s) for g, items in TILES.items() for s in items)]
    return spark.createDataFrame(rows, "tile_no int, family string, tw double, th double")


def case(key: str, values: dict | list, default: str = "NULL") -> str:
    """SQL that looks `key` up among fixed values."""
    items = values.items() if isinstance(values, dict) else enumerate(values)
    lit = lambda v: f"'{v}'" if isinstance(v, str) else repr(float(v)) + "e0" if isinstance(v, float) and "e" not in repr(v) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in items) + f" ELSE {default} END"


def waste_for(pattern: str) -> str:
    """D3."""
    return case(pattern, {k: float(v) for k, v in WASTE.items()})


def unit_of(markup_type: str) -> str:
    """D5."""
    return case(markup_type, MARKUP_UNITS, "''")


def feet_per_paper_inch(scale_id: str) -> str:
    """U1, D4."""
    metric = case(scale_id, METRIC_SCALES)
    return f"coalesce({case(scale_id, {k: float(v) for k, v in SCALES.items()})}, {metric} * 25.4e0 * 3.280839895e0)"
