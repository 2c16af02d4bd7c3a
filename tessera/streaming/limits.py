"""The rate limits and the debounced save as streams."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.limits import MOST, WINDOW_MS


def fixed_windows(requests: DataFrame, window_ms: int = WINDOW_MS, most: int = MOST, late: str = "5 minutes") -> DataFrame:
    """Counts for each identity and tumbling window; a window closes, and its state goes, `late` after its end."""
    windows = requests.withWatermark("ts", late).groupBy("identity", F.window("ts", f"{window_ms} milliseconds")).agg(F.count("*").alias("hits"))
    return windows.select("identity", F.expr(f"unix_millis(window.start) DIV {window_ms}").alias("bucket"), "hits", F.greatest(F.lit(0).cast("long"), F.col("hits") - most).alias("limited"))


class SlidingLog(StatefulProcessor):
    """Counts of one identity's requests in the window before each (W2), right for rows that come late too.

    List state holds (ts_ms, event_id) of the requests that a row may still need: those later than the watermark less the window. What one batch
    adds is one value, two arrays side by side, since each value costs a pickle and a row on its way to the store and back. A timer
    takes away what the watermark has passed; in event time it stands for a time to live, which Spark has for processing time alone.
    A late row raises the hits of later requests in its window, so those are sent again.
    """

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "ts_ms array<bigint>, event_id array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        past = self._past()
        new = sorted((int(t), int(e)) for b in rows for t, e in zip(b["ts_ms"], b["event_id"], strict=True))
        now = sorted(past + new)
        if past and new[0] < past[-1]:
            before = dict(zip(past, self._hits(past), strict=True))
            fresh = set(new)
            out = [(x, h) for x, h in zip(now, self._hits(now), strict=True) if x in fresh or before[x] != h]
        else:
            out = list(zip(now, self._hits(now), strict=True))[len(past) :]
        self._keep(now, timerValues.getCurrentWatermarkInMs(), None if past else new)
        if not past:
            self.handle.registerTimer(now[-1][0] + self.window_ms)
        yield pd.DataFrame({"event_id": [e for (_, e), _ in out], "identity": key[0], "ts_ms": [t for (t, _), _ in out], "hits": [h for _, h in out], "limited": [h > self.most for _, h in out]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = self._keep(self._past(), timerValues.getCurrentWatermarkInMs())
        if left:
            self.handle.registerTimer(left[-1][0] + self.window_ms)
        return iter(())

    def close(self) -> None:
        pass

    def _past(self) -> list[tuple[int, int]]:
        return sorted(x for times, ids in self.log.get() for x in zip(times, ids, strict=True))

    def _hits(self, log: list[tuple[int, int]]) -> list[int]:
        times = [t for t, _ in log]
        return [i + 1 - bisect_right(times, t - self.window_ms) for i, t in enumerate(times)]

    def _keep(self, log: list[tuple[int, int]], watermark: int, added: list | None = None) -> list[tuple[int, int]]:
        left = [x for x in log if x[0] > watermark - self.window_ms]
        if not left:
            self.log.clear()
        elif added is not None and len(left) == len(log):
            self.log.appendValue(_value(added))
        else:
            self.log.put([_value(left)])
        return left


def _value(log: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """A log as one value of the state."""
    return [t for t, _ in log], [e for _, e in log]


def sliding_log(requests: DataFrame, window_ms: int = WINDOW_MS, most: int = MOST, late: str = "5 minutes") -> DataFrame:
    """Each request with the hits in the window before it. A request comes again, with more hits, when a late one turns up in its window:
    settled() keeps the last word. Needs the RocksDB state store, which run_once() sets."""
    schema = "event_id long, identity long, ts_ms long, hits long, limited boolean"
    return requests.withWatermark("ts", late).groupBy("identity").transformWithStateInPandas(SlidingLog(window_ms, most), schema, "append", "eventTime")


def settled(hits: DataFrame) -> DataFrame:
    """What a sliding_log() stream wrote, each request once: late requests only ever add hits, so the largest number is the last."""
    return hits.groupBy("event_id", "identity", "ts_ms").agg(F.max("hits").alias("hits"), F.bool_or("limited").alias("limited"))


def debounced(changes: DataFrame, quiet_ms: int, late: str = "1 minute") -> DataFrame:
    """X11: a session for each run of changes; its latest change is saved when the session closes."""
    sessions = changes.withWatermark("ts", late).groupBy("identity", F.session_window("ts", f"{quiet_ms} milliseconds"))
    return sessions.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("changes")).select("identity", "event_id", "changes")


_LOCAL: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share: in spark.checkpoint.dir, or, on a local master alone, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-streams-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of requests."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ms = "datediff(ts, DATE '1970-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT)"
    return rows.selectExpr("event_id", "user_id AS identity", "CAST(ts AS TIMESTAMP) AS ts", f"{ms} AS ts_ms")


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all input that is there and reads what it wrote."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    run_once(stream, out, scratch(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Handles all input that is there, writes Parquet, and stops. Its state is in RocksDB, so it need not fit the heap; the session's setting stays."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
