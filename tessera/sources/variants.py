"""Changes to project documents that keep every field, known or not (S4, S12, X2): documents as VARIANT.

A document's object is a map from names to variants, so a patch is a map laid over it. A null that a patch states is set, a name that it
lacks stays. Numbers and texts keep their spelling as VARIANT has it; the order of an object's names does not stay.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..schema import DEFAULTS

#: What a new project's document holds.
BLANK = {"name": DEFAULTS["name"], "unitSystem": DEFAULTS["unit_system"], "scale": None, "archScale": None, "rooms": [], "materials": [], "markups": [], "taxRate": DEFAULTS["tax_rate"], "laborRatePerSf": DEFAULTS["labor_rate_per_sf"], "showGrid": DEFAULTS["show_grid"]}


def _fields(v: str) -> str:
    """SQL for an object's fields; of what is no object, none."""
    return f"coalesce(try_variant_get({v}, '$', 'map<string,variant>'), CAST(map() AS map<string,variant>))"


def _parsed(docs: DataFrame) -> str:
    """SQL for the variant of `doc`, which may be one."""
    return "doc" if isinstance(docs.schema["doc"].dataType, VariantType) else "parse_json(doc)"


def laid_over(base: str, patch: str, deep: tuple[str, ...] = ()) -> str:
    """SQL for the variant object `base` with the fields of `patch`; an object in a field of `deep` is laid over the one there."""
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    inner = "p"
    if deep:
        names = ", ".join(f"'{d}'" for d in deep)
        both = laid_over("element_at(b, k)", "v")
        inner = f"transform_values(p, (k, v) -> IF(k IN ({names}) AND map_contains_key(b, k), {both}, v))"
    over = f"to_variant_object(map_concat(map_filter(b, (k, v) -> NOT map_contains_key(p, k)), {inner}))"
    return let(_fields(base), "b", let(_fields(patch), "p", over))


def load_snapshots(snapshots: DataFrame) -> DataFrame:
    """(project_id, doc) with the fields of a new project where a snapshot lacks them, and all that it has, known or not. What is no JSON object has a null doc."""
    blank = "parse_json('" + json.dumps(BLANK).replace("'", "\\'") + "')"
    v = snapshots.withColumn("__v", F.expr("try_parse_json(doc)"))
    whole = F.expr(f"IF(schema_of_variant(__v) LIKE 'OBJECT%', to_json({laid_over(blank, '__v')}), NULL)")
    return v.withColumn("doc", whole).drop("__v")


def set_fields(docs: DataFrame, patches: DataFrame, text: bool = True) -> DataFrame:
    """Documents (project_id, doc) with the fields that patches (project_id, patch as JSON, one for a project) set; if not `text`, `doc` is
    a VARIANT, which patch_items() takes, so that a document that both change is read and written once."""
    joined = docs.join(patches.select("project_id", F.col("patch").alias("__p")), "project_id", "left")
    merged = laid_over(_parsed(docs), "parse_json(__p)")
    merged, plain = (F.expr(f"to_json({merged})"), F.col("doc")) if text else (F.expr(merged), F.expr(_parsed(docs)))
    return joined.withColumn("doc", F.when(F.col("__p").isNotNull(), merged).otherwise(plain)).drop("__p")


def patch_items(docs: DataFrame, patches: DataFrame, items: str = "rooms", deep: tuple[str, ...] = ("layout",)) -> DataFrame:
    """Documents, as text or VARIANT, whose rooms (materials, markups) have the patches (project_id, id, seq, patch as JSON) laid over them, by seq.

    Objects in `deep` are patched themselves: a layout's new angle keeps its origin. With no `deep` they are replaced. A project
    bounds what meets in one row; ids that a document lacks change nothing.
    """
    each = patches.groupBy("project_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "patch"))), lambda x: x["patch"]).alias("all"))
    given = each.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "all"))).alias("__given"))
    joined = docs.join(given, "project_id", "left").withColumn("__v", F.expr(_parsed(docs)))
    plain = F.expr("to_json(doc)") if _parsed(docs) == "doc" else F.col("doc")
    mine = "element_at(__given, try_variant_get(r, '$.id', 'string'))"
    patched = f"aggregate(coalesce({mine}, CAST(array() AS array<string>)), r, (a, x) -> {laid_over('a', 'parse_json(x)', deep)})"
    # the list is taken out once, and goes back into the fields beside it without a copy of its own
    listed = f"element_at(transform(array(IF(__given IS NULL, NULL, try_variant_get(__v, '$.{items}', 'array<variant>'))), l -> transform(l, r -> {patched})), 1)"
    whole = f"to_variant_object(map_concat(map_filter({_fields('__v')}, (k, v) -> k <> '{items}'), map('{items}', to_variant_object(x))))"
    doc = F.coalesce(F.expr(f"element_at(transform(array({listed}), x -> IF(x IS NULL, NULL, to_json({whole}))), 1)"), plain)
    return joined.withColumn("doc", doc).drop("__given", "__v")
