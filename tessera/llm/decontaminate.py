"""Benchmark decontamination by template canonicalisation.

Words of texts and benchmark items become templates: numbers, units behind a number and
names turn into typed placeholders. Every word with a capital counts as a name, at the start of a sentence too, so that a word's tag never depends on
what stands before the passage; the slot check tells an article from a name. Hashes of all
five-word template windows are joined. A window with fewer than LITERALS words that are no
placeholders would fit by its placeholders alone, so it is compared by its values: an item of
names or numbers matches word for word or not at all. An item's place counts if either its template
or its values are found, so a copy all in capitals, to which every word is a name, is found too. A document that holds 0.8 or more of an
item's windows, counted by their places in the item, is a candidate; on the candidates alone
the values in the slots are aligned, and an item's slot value must stand for one document value
(0.8 or more of the slots agree), which catches re-parameterised questions.

Slots are compared for each occurrence: pairs of windows are grouped by their offset
(document position less item position), in overlapping bands, so that a few words more or
less do not part an occurrence; in a band an item window counts at the offset that most
windows share. One contained and consistent band is enough, or the whole document.

Items of fewer than five words are one window of their own width. Null or wordless texts
and items match nothing. Results have one row for each doc_id, text and item; repeated
rows add none. Rows of a null doc_id match too. Equal item ids count as one item. Extra
columns are not read. An empty table on either side gives no rows.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized, row_key, unused

WIDTH = 5
#: Words of a window that are no placeholders, from which it is compared as a template.
LITERALS = 2
CONTAINMENT = 0.8
CONSISTENCY = 0.8
#: Units of measure as they follow a number.
UNITS = ["%", "€", "$", "£", "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g", "kg", "gram", "grams", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "mph", "kmh", "w", "kw", "v", "hz", "khz", "mhz", "b", "kb", "mb", "gb", "tb"]
#: Benchmark windows up to which their table is broadcast (16 bytes each and overhead); beyond, Spark chooses the join.
BROADCAST_WINDOWS = 500_000
#: Keys of found documents (16 bytes each and overhead) up to which they are broadcast, so that texts need not move.
BROADCAST_ROWS = 500_000


#: Fixed value: a number, a word, or a unit sign.
WORD = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+|[%€$£]"


def _words(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep`, and raw: the words as they stand."""
    return rows.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias("raw"))


def _tag(w: str, i: str) -> str:
    """SQL for the template word of raw[i]: a placeholder or the word, which has no capital then. Comparing whole strings is what Spark does fastest."""
    before, units = f"get(raw, {i} - 1)", ", ".join(f"'{u}'" for u in UNITS)
    return f"""CASE WHEN {w} >= '0' AND {w} < ':' THEN '<num>'
        WHEN {before} >= '0' AND {before} < ':' AND lower({w}) IN ({units}) THEN '<unit>'
        WHEN lower({w}) <> {w} THEN '<name>'
        ELSE {w} END"""


def _windows(hashes: str, widths: list[int], value) -> str:
    """SQL for an array of value(i, width) over all windows of each width."""
    parts = [f"CASE WHEN size({hashes}) >= {n} THEN transform(sequence(0, size({hashes}) - {n}), i -> {value('i', n)}) END" for n in widths]
    return f"flatten(filter(array({', '.join(parts)}), a -> a IS NOT NULL))"


def _arrays(words: str) -> dict[str, str]:
    """SQL for h, g and l of an array of (t, v), template words and values: hashes of the first, of the second, and 1 for what is no placeholder."""
    literal = "w.t NOT IN ('<num>', '<unit>', '<name>')"
    return {"h": f"transform({words}, w -> xxhash64(w.t))", "g": f"transform({words}, w -> xxhash64(w.v))", "l": f"transform({words}, w -> IF({literal}, 1, 0))"}


def _hash(i: str, width: int) -> str:
    """SQL for a window's hash, from h, g and l."""
    return f"IF({_is_template(i, width)}, xxhash64({width}, {_each('h', i, width, ', ')}), {_value_hash(i, width)})"


def _each(array: str, i: str, width: int, by: str) -> str:
    return by.join(f"get({array}, {i} + {k})" for k in range(width))


def _is_template(i: str, width: int) -> str:
    return f"{_each('l', i, width, ' + ')} >= {LITERALS}"


def _value_hash(i: str, width: int) -> str:
    return f"xxhash64(-{width}, {_each('g', i, width, ', ')})"


def _tagged(raw: str) -> str:
    return f"transform({raw}, (w, i) -> struct({_tag('w', 'i')} AS t, lower(w) AS v))"


def _slotted(rows: DataFrame, widths: list[int], *keep: str, both: bool = False) -> DataFrame:
    """`keep`, at, hash, slots: a row for each window; at: its first word; slots: the values under its placeholders, none where it is compared by value.

    both: besides, a row with the hash of the values for each window.
    """
    tagged = rows.select(*keep, F.expr(_tagged("raw")).alias("words"))
    hashed = tagged.select(*keep, "words", *(F.expr(e).alias(c) for c, e in _arrays("words").items()))
    none = "CAST(array() AS array<string>)"
    slots = lambda i, n: f"IF({_is_template(i, n)}, transform(filter(slice(words, {i} + 1, {n}), w -> w.t IN ('<num>', '<unit>', '<name>')), w -> w.v), {none})"
    rows_of = _windows("h", widths, lambda i, n: f"struct({i} AS at, {_hash(i, n)} AS hash, {slots(i, n)} AS slots)")
    if both:
        rows_of = f"concat({rows_of}, {_windows('h', widths, lambda i, n: f'struct({i} AS at, {_value_hash(i, n)} AS hash, {none} AS slots)')})"
    return hashed.select(*keep, F.expr(f"inline({rows_of})"))


def _agreement(aligned: DataFrame, containment: float) -> DataFrame:
    """key, item_id, consistency and same (share of equal values) of the most consistent contained alignment.

    aligned: key, item_id, n_windows, part, at, of, hash, asked, slots: pairs of windows; (part, of): the item's place. Bands are a quarter of the item wide
    (four words at least); of two grids of them, half a band apart, one keeps together what drifts by half a band.
    """
    ids = ["key", "item_id", "n_windows"]
    near = Window.partitionBy("key", "item_id", "part", "offset")  # an item's windows bound it
    pairs = aligned.withColumn("offset", F.expr("at - of")).withColumn("support", F.count("*").over(near)).withColumn("width", F.expr("greatest(4, n_windows DIV 4)"))
    bands = F.expr("explode(array(struct(0 AS grid, floor(offset / width) AS place), struct(1 AS grid, floor(offset / width + 0.5D) AS place)))")
    banded = pairs.withColumn("band", bands).groupBy(*ids, "band", "part", "of").agg(F.max_by(F.struct("asked", "slots"), F.struct("support", -F.col("offset"))).alias("best"))
    whole = aligned.select(*ids, F.expr("struct(2 AS grid, 0L AS place) AS band"), "at", "hash", "asked", "slots").distinct().drop("at", "hash")
    rows = banded.select(*ids, "band", "best.*").unionByName(whole)
    in_bands = banded.groupBy(*ids, "band").agg(F.count("*").alias("n_held"))  # a row for each place of the item
    anywhere = aligned.groupBy(*ids).agg(F.countDistinct("part", "of").alias("n_held")).select(*ids, F.expr("struct(2 AS grid, 0L AS place) AS band"), "n_held")
    held = in_bands.unionByName(anywhere).where(F.col("n_held") >= containment * F.col("n_windows") - 1e-9)
    slots = rows.join(held.select("key", "item_id", "band"), ["key", "item_id", "band"]).select("key", "item_id", "band", F.expr("inline_outer(arrays_zip(asked, slots))").alias("a", "b"))
    by_pair = slots.groupBy("key", "item_id", "band", "a", "b").agg(F.count("a").alias("n"))
    by_value = by_pair.groupBy("key", "item_id", "band", "a").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    share = lambda c: F.expr(f"coalesce(sum({c}) / nullif(sum(n), 0), 1D)")
    each = by_value.groupBy("key", "item_id", "band").agg(share("most").alias("consistency"), share("same").alias("same"))
    return each.groupBy("key", "item_id").agg(F.max(F.struct("consistency", "same")).alias("best")).select("key", "item_id", "best.*")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", containment: float = CONTAINMENT, consistency: float = CONSISTENCY) -> DataFrame:
    """doc_id, key (of id and text), item_id, n_windows, n_found, containment, consistency, verbatim."""
    known = benchmark.where("item_id IS NOT NULL").withColumn("part", F.xxhash64(text))
    items = _words(known, text, "item_id", "part").where("size(raw) > 0")
    widths = sorted(r["n"] for r in items.select(F.least(F.size("raw"), F.lit(WIDTH)).alias("n")).distinct().collect())  # five values at most
    widths = widths or [WIDTH]
    per_width = [_slotted(items.where(f"least(size(raw), {WIDTH}) = {n}"), [n], "item_id", "part", both=True) for n in widths]
    asked = per_width[0]
    for more in per_width[1:]:
        asked = asked.unionByName(more)
    asked = materialized(asked.distinct(), "benchmark_windows")
    places = asked.select("item_id", "hash", F.struct("part", "at").alias("place")).distinct()
    total = places.groupBy("item_id").agg(F.countDistinct("place").alias("n_windows"))
    small = asked.count() <= BROADCAST_WINDOWS
    bounded = F.broadcast if small else (lambda df: df)

    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"), row_key("doc_id", text).alias("key"))
    hashed = _words(rows, "text", "doc_id", "key").select("doc_id", "key", F.expr(_tagged("raw")).alias("words")).select("doc_id", "key", *(F.expr(e).alias(c) for c, e in _arrays("words").items()))
    seen = hashed.select("doc_id", "key", F.explode(F.expr(f"array_distinct({_windows('h', widths, _hash)})")).alias("hash"))
    found = seen.join(bounded(places), "hash").groupBy("doc_id", "key", "item_id").agg(F.countDistinct("place").alias("n_found"))
    candidates = materialized(found.join(bounded(total), "item_id").where(F.col("n_found") >= containment * F.col("n_windows") - 1e-9), "candidates")

    again = among(rows, candidates).dropDuplicates(["key"])
    items_at = asked.select("item_id", "part", "hash", F.col("at").alias("of"), F.col("slots").alias("asked"))
    aligned = _slotted(_words(again, "text", "doc_id", "key"), widths, "key").join(candidates.select("key", "item_id", "n_windows"), "key").join(bounded(items_at), ["item_id", "hash"])
    agreed = _agreement(materialized(aligned, "aligned"), containment)
    joined = candidates.join(agreed, ["key", "item_id"], "left")
    one = F.lit(1.0)
    return joined.select(
        "doc_id", "key", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("containment"),
        F.coalesce("consistency", one).alias("consistency"), (F.coalesce("same", one) >= consistency).alias("verbatim"),
    ).where(F.col("consistency") >= consistency - 1e-9)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without those that match an item."""
    key = unused(docs.columns, "row_key")
    hit = materialized(matches(docs, benchmark, text).select(F.col("key").alias(key)), "contaminated")
    return among(docs.withColumn(key, row_key("doc_id", text)), hit, key, "left_anti").drop(key)


def among(rows: DataFrame, some: DataFrame, key: str = "key", how: str = "left_semi") -> DataFrame:
    """`rows` whose key a written table `some` has (or, left_anti, lacks): by broadcast up to BROADCAST_ROWS keys, beyond that as Spark chooses."""
    keys = some.select(key).distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, key, how)
