"""Changes to projects as transforms of whole tables.

A patch table has a row for each change; applying it is a join, so a thousand edits cost as
much as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import geometry as G
from ..functions import units as U
from ..schema import DEFAULTS
from .keys import having, scoped


def with_defaults(projects: DataFrame) -> DataFrame:
    """Missing fields as a new project has them; a kept 0 stays."""
    given = {"name": "name", "unit_system": "unit_system", "tax_rate": "tax_rate", "labor_rate_per_sf": "labor_rate_per_sf"}
    return projects.withColumns({c: F.coalesce(F.col(c), F.lit(DEFAULTS[k])) for c, k in given.items()})


def add_rooms(rooms: DataFrame, new: DataFrame, floors: DataFrame) -> DataFrame:
    """`new` rooms (project_id, seq, points, name) numbered behind a project's rooms, coloured in turn, with the first floor material (project_id, material_id; by material_ord if there is one, else by id) assigned."""
    have = rooms.groupBy("project_id").agg(F.count("*").alias("have"))
    first = floors.groupBy("project_id").agg(F.min_by("material_id", F.struct(*having(floors, "material_ord"), "material_id")).alias("floor"))
    n = F.coalesce("have", F.lit(0)) + F.row_number().over(Window.partitionBy("project_id").orderBy("seq")) - 1
    colors = F.array(*map(F.lit, C.ROOM_COLORS))
    rows = new.join(have, "project_id", "left").join(first, "project_id", "left").withColumn("__n", n)
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Room "), (F.col("__n") + 1).cast("string")))
    assigned = F.when(F.col("floor").isNull(), F.expr("CAST(array() AS array<bigint>)")).otherwise(F.array("floor"))
    return rows.select("project_id", "seq", name.alias("name"), F.element_at(colors, (F.col("__n") % len(C.ROOM_COLORS) + 1).cast("int")).alias("color"), "points", assigned.alias("assigned"), F.lit(8.0).alias("wall_height"), F.lit("grid").alias("pattern"))


def merged(base: DataFrame, patches: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """`base` with the fields that a patch row sets; a null in a patch sets nothing."""
    joined = base.alias("b").join(patches.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields)), keys, "left")
    return joined.select(*(F.coalesce(f"__{c}", f"b.{c}").alias(c) if c in fields else F.col(c) for c in base.columns))


def toggled(assigned: str | Column, item: str | Column) -> Column:
    """The array without the item if it has it, else with it behind."""
    a, i = (F.col(x) if isinstance(x, str) else x for x in (assigned, item))
    return F.when(F.array_contains(a, i), F.array_remove(a, i)).otherwise(F.array_append(a, i))


def without(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in `gone`."""
    return base.join(gone.select(*keys), keys, "left_anti")


def delete_materials(bridge: DataFrame, gone: DataFrame) -> DataFrame:
    """Assignments after materials have gone."""
    return without(bridge, gone, scoped(bridge, gone, "material_id"))


def assign_new_floor(rooms: DataFrame, bridge: DataFrame, materials: DataFrame, new_id: int) -> DataFrame:
    """Assignments with a new floor material added in every room that has no floor material."""
    floors = bridge.join(materials.where("type = 'floor'"), scoped(bridge, materials, "material_id"), "left_semi")
    bare = rooms.join(floors, scoped(rooms, floors, "room_id"), "left_anti")
    return bridge.select("project_id", "room_id", "material_id").unionByName(bare.select("project_id", "room_id", F.lit(new_id).cast("long").alias("material_id")))


def change_pattern(materials: DataFrame, patches: DataFrame) -> DataFrame:
    """The new pattern, and its suggested waste where the old waste was the old pattern's suggestion."""
    keys = scoped(materials, patches, "material_id")
    p = materials.join(patches.select(*keys, F.col("pattern").alias("__p")), keys, "left")
    follows = F.col("__p").isNotNull() & F.expr(C.waste_for("__p")).isNotNull() & (F.col("waste") == F.coalesce(F.expr(C.waste_for("pattern")), F.col("waste")))
    p = p.withColumns({"waste": F.when(follows, F.expr(C.waste_for("__p"))).otherwise(F.col("waste")), "pattern": F.coalesce("__p", "pattern")})
    return p.select(*materials.columns)


def material_from_tile(tiles: DataFrame) -> DataFrame:
    """A floor material for each library tile (texts as typed); sizes must be finite and above 0, a price finite."""
    number = lambda c: F.expr(f"CASE WHEN abs(try_cast({c} AS DOUBLE)) < double('Infinity') THEN try_cast({c} AS DOUBLE) END")
    above = lambda c, d: F.coalesce(F.when(number(c) > 0, number(c)), F.lit(d))
    return tiles.select("tile_id", F.coalesce(F.nullif("name", F.lit("")), F.lit("Library Tile")).alias("name"), above("tw_in", 12.0).alias("tw"), above("th_in", 12.0).alias("th"), F.lit(0.125).alias("grout"), F.coalesce(number("price"), F.lit(0.0)).alias("price"), F.coalesce(F.nullif("price_unit", F.lit("")), F.lit("sf")).alias("price_unit"), above("sf_per_box", 15.0).alias("sf_per_box"))


def library_row(tiles: DataFrame) -> DataFrame:
    """A library tile as stored: sizes default to 12, other numbers to null, the name to 120 characters."""
    number = lambda c: F.expr(f"CASE WHEN abs(try_cast({c} AS DOUBLE)) < double('Infinity') THEN try_cast({c} AS DOUBLE) END")
    return tiles.select("tile_id", "owner", F.substring(F.coalesce(F.nullif("name", F.lit("")), F.lit("Tile")), 1, 120).alias("name"), F.coalesce(number("tw_in"), F.lit(12.0)).alias("tw_in"), F.coalesce(number("th_in"), F.lit(12.0)).alias("th_in"), number("price").alias("price"), F.coalesce(F.nullif("price_unit", F.lit("")), F.lit("sf")).alias("price_unit"), number("sf_per_box").alias("sf_per_box"))


def owned(rows: DataFrame, owner: int) -> DataFrame:
    """What one user may see and change."""
    return rows.where(F.col("owner") == owner)


def listed(stored: DataFrame, *more: str) -> DataFrame:
    """The columns of a project list (and `more`), archived ones left out, latest first."""
    return stored.where("NOT archived").select("project_id", "name", "floor_sf", "total_cost", "updated_at", "archived", *more).orderBy(F.desc("updated_at"), "project_id")


def library_places(tiles: DataFrame) -> DataFrame:
    """`tiles` with their place in their owner's list, newest first."""
    return tiles.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created_at"), "tile_id")))


def stamped(changes: DataFrame, now: str = "current_timestamp()") -> DataFrame:
    """Changes as they are stored, with the time of the change."""
    return changes.withColumn("updated_at", F.expr(now))


def single(rows: DataFrame, key: str, value) -> DataFrame:
    """The one row with this key; no row or a second one is an error when the plan runs."""
    found = rows.where(F.col(key) == value)
    counted = found.groupBy().agg(F.count("*").alias("__n"), F.first(F.struct(*found.columns)).alias("__r"))
    return counted.select(F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.raise_error(F.concat(F.lit("rows found: "), F.col("__n").cast("string")))).alias("r")).select("r.*")


def upserted(stored: DataFrame, changes: DataFrame, key: str = "project_id") -> DataFrame:
    """`stored` with changed rows in place and new rows added."""
    return stored.join(changes.select(key), key, "left_anti").unionByName(changes)


def headline(projects: DataFrame, rooms: DataFrame, estimates: DataFrame) -> DataFrame:
    """Floor area (0 without a scale) and total of each project."""
    floors = rooms.groupBy("project_id").agg(F.sum(F.expr(G.area("points"))).alias("sf"))
    zero = F.lit(0.0)
    joined = projects.join(floors, "project_id", "left").join(estimates.select("project_id", "total"), "project_id", "left")
    return joined.select("project_id", F.when(F.coalesce("scale", zero) != 0, F.coalesce("sf", zero)).otherwise(zero).alias("floor_sf"), F.coalesce("total", zero).alias("total_cost"))


def room_materials(rooms: DataFrame, materials: DataFrame) -> DataFrame:
    """For rooms with an `assigned` array, the names of the materials that exist, in that order, and the first floor material."""
    room = [*having(rooms, "project_id"), "room_id"]
    each = rooms.select(*room, F.posexplode_outer("assigned").alias("pos", "material_id"))
    each = each.join(materials.select(*having(materials, "project_id"), "material_id", F.col("name").alias("m"), "type"), scoped(rooms, materials, "material_id"), "left")
    named = F.when(F.col("m").isNotNull(), F.struct("pos", "m"))
    grouped = each.groupBy(*room).agg(F.sort_array(F.collect_list(named)).alias("n"), F.min_by(F.when(F.col("type") == "floor", F.col("material_id")), F.when(F.col("type") == "floor", F.col("pos"))).alias("first_floor"))
    return grouped.select(*room, F.concat_ws(" | ", F.transform("n", lambda x: x["m"])).alias("materials"), "first_floor")


def texture_repeat(tw: str) -> str:
    """V9."""
    return f"greatest(1D, {U.half_up(f'try_divide(12D, {tw} / 12D) / 4D')})"
