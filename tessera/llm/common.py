"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Arrow bytes that a task turns into Python values at a time.
SLICE_BYTES = 4 << 20

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_LOCAL_SHARED: list[str] = []
_SCRATCH: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, as every contract here does; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is spark.checkpoint.dir. Only a local master may leave that unset; a
    temporary folder then stands in, which is right because all tasks run in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_SHARED:
            _LOCAL_SHARED.append(tempfile.mkdtemp(prefix="spark-shared-"))
        base = _LOCAL_SHARED[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


def materialized(df: DataFrame, name: str) -> DataFrame:
    """written(), for a step inside an operator: scratch() deletes it."""
    back = written(df, name)
    if _SCRATCH:
        _SCRATCH[-1].append(back._tessera_path)
    return back


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that materialized() wrote inside; so results made inside must have been written elsewhere by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def forget(df: DataFrame | None) -> None:
    """Deletes the table behind a written() result that nothing reads any more; other tables stay."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(columns: list[str], name: str) -> str:
    """`name`, lengthened until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str, text: str) -> Column:
    """128 bits for an id and text: never null, so equal rows, null ones included, have equal keys."""
    part = lambda c: F.coalesce(F.concat(F.lit("t"), F.col(c).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(part(f"`{doc_id}`"), F.lit("\x00"), part(f"`{text}`")).cast("binary")))


def bound_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold 1,000 rows instead of the default 10,000, which whole documents make too large; another setting stays."""
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], schema: str, keep: list[str] = ()) -> DataFrame:
    """mapInArrow: `keep` columns pass through, and make()(batch) gives the arrays of `schema`, one value a row.

    make() runs once for each task, so that what it loads or caches lives as long as the task.
    """
    bound_batches(df.sparkSession)
    fields = [df.schema[c] for c in keep]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    out = f"{kept}, {schema}" if kept else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE_BYTES // max(SLICE_BYTES, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *work(batch)], names=names)

    names = [*keep, *(p.strip().split(" ")[0] for p in _split_schema(schema))]
    return df.mapInArrow(run, out)


def _split_schema(schema: str) -> list[str]:
    """The top-level fields of a DDL string."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column's values; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
