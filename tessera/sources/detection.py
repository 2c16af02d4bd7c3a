"""Proposed rooms from a landing table of detection responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

MEDIA = ["image/png", "image/jpeg", "image/webp", "image/gif"]
MAX_BASE64 = 8_000_000
MAX_ROOMS = 200
RESPONSE = "struct<rooms:array<struct<name:string,x:string,y:string,w:string,h:string,confidence:string>>>"


def finite(x: str) -> str:
    return f"CASE WHEN abs(try_cast({x} AS DOUBLE)) < double('Infinity') THEN try_cast({x} AS DOUBLE) END"


def verdict(method: str, media: str, size: str, signed_in: str = "true", limited: str = "false") -> str:
    """SQL for the status of a request, by the first check that fails.

    405 for a method other than POST, 401 without a session, 429 over the rate limit, 400 without an image, 413 for one that
    is too long, 400 for a media type that is not allowed (none given: PNG), else 200.
    """
    allowed = ", ".join(f"'{m}'" for m in MEDIA)
    return f"""CASE WHEN {method} <> 'POST' THEN 405 WHEN NOT {signed_in} THEN 401 WHEN {limited} THEN 429 WHEN coalesce({size}, 0) = 0 THEN 400
        WHEN {size} > {MAX_BASE64} THEN 413 WHEN coalesce({media}, 'image/png') NOT IN ({allowed}) THEN 400 ELSE 200 END"""


def client_ip(forwarded: str, address: str) -> str:
    """The first forwarded address, else the socket's, else 'unknown'."""
    return f"coalesce(nullif(trim(split_part({forwarded}, ',', 1)), ''), nullif({address}, ''), 'unknown')"


def cleaned(responses: DataFrame) -> DataFrame:
    """From (request_id, body) the usable rooms, in order, 200 for each request at most.

    Sides must be finite, above 0 and at most 1000 ft, coordinates within 100,000 ft; confidence is 0.5 if missing or negative, 1 at most.
    """
    rooms = responses.select("request_id", F.posexplode(F.from_json("body", RESPONSE).getField("rooms")).alias("ord", "p")).select("request_id", "ord", "p.*")
    typed = rooms.select("request_id", "ord", F.expr("CASE WHEN trim(coalesce(name, '')) = '' THEN 'Room' ELSE substring(name, 1, 80) END").alias("name"), *(F.expr(f"coalesce({finite(c)}, 0D)").alias(c) for c in "xy"), *(F.expr(finite(c)).alias(c) for c in "wh"), F.expr(finite("confidence")).alias("confidence"))
    real = typed.where("w > 0 AND h > 0 AND w <= 1000 AND h <= 1000 AND abs(x) <= 100000 AND abs(y) <= 100000")
    sure = real.withColumn("confidence", F.expr("CASE WHEN confidence IS NULL OR confidence < 0 THEN 0.5D ELSE least(confidence, 1D) END"))
    kept = sure.groupBy("request_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("ord", "name", "x", "y", "w", "h", "confidence"))), 1, MAX_ROOMS).alias("r"))
    return kept.select("request_id", F.inline("r"))


def committed(reviewed: DataFrame) -> DataFrame:
    """The reviewed rooms (request_id, ord, name, x, y, w, h as text or numbers, keep) that are kept, as rectangles; a side that is no number above 0 is 1, a coordinate that is none is 0."""
    side = lambda c: f"CASE WHEN {finite(c)} > 0 THEN {finite(c)} ELSE 1D END"
    rows = reviewed.where("keep").select("request_id", "ord", "name", *(F.expr(f"coalesce({finite(c)}, 0D)").alias(c) for c in "xy"), *(F.expr(side(c)).alias(c) for c in "wh"))
    return rows.select("request_id", "ord", "name", F.expr(G.rect("x", "y", "w", "h")).alias("points"))


def render_scale(width: str, height: str, target: str = "2000D") -> str:
    """SQL for a page's raster scale: to the target width, within area and side caps, 0.3 to 3."""
    area, side = f"sqrt(try_divide(16777216D * 0.85D, {width} * {height}))", f"try_divide(4096D * 0.9D, greatest({width}, {height}))"
    return f"greatest(0.3D, least(3D, try_divide({target}, {width}), {area}, {side}))"


def encoded(files: DataFrame) -> DataFrame:
    """base64 text and media type of files read by the binaryFile source."""
    kind = "CASE lower(element_at(split(path, '[.]'), -1)) WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'gif' THEN 'image/gif' ELSE 'image/jpeg' END"
    return files.select("path", F.expr(kind).alias("media_type"), F.base64("content").alias("data"))
