"""Rate limits and debounced saves over stored requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_MS = 300_000
MOST = 20


def fixed_windows(requests: DataFrame, window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """Requests for each identity and window counted from the epoch, and how many of them the limit turned away."""
    counted = requests.groupBy("identity", F.expr(f"ts_ms DIV {window_ms}").alias("bucket")).agg(F.count("*").alias("hits"))
    return counted.withColumn("limited", F.greatest(F.lit(0).cast("long"), F.col("hits") - most))


def sliding_log(requests: DataFrame, window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """Each request with the requests of its identity in the window before it, refused ones and itself included.

    A request at exactly the window's distance is out. Requests of one millisecond come by event_id.
    """
    by_time = Window.partitionBy("identity").orderBy("ts_ms").rangeBetween(-(window_ms - 1), 0)
    tied = Window.partitionBy("identity", "ts_ms").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    hits = F.count("*").over(by_time) - F.count("*").over(tied)
    return requests.select("event_id", "identity", "ts_ms", hits.alias("hits")).withColumn("limited", F.col("hits") > most)


def debounced(changes: DataFrame, quiet_ms: int) -> DataFrame:
    """X11: of each run of changes with less than quiet_ms between them the last, which is what gets saved."""
    nxt = F.lead("ts_ms").over(Window.partitionBy("identity").orderBy("ts_ms", "event_id"))
    return changes.withColumn("__next", nxt).where(F.col("__next").isNull() | (F.col("__next") - F.col("ts_ms") >= quiet_ms)).drop("__next")
