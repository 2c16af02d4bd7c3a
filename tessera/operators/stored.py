"""Stored projects in hashed folders: changes that rewrite only the folders they touch (X14-X16, X22-X24), also from a stream (X11).

A table is Parquet in folders `bucket=k`, k from a hash of the key. A change reads and writes the buckets of its keys alone; a folder is
replaced by Spark's dynamic partition overwrite. Each row carries the batch that wrote it, so a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stamped

BUCKETS = 256
BATCH = "batch"


class ProjectStore:
    """A table of projects at `path`. `columns` is its schema as DDL, without bucket and batch; `key` names its key.

    Changes of several writers at once are not told apart: one writer changes a table, as one stream does.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str = "project_id", buckets: int = BUCKETS):
        self.spark, self.path, self.columns, self.key, self.buckets = spark, path, columns, key, buckets

    def create(self) -> ProjectStore:
        self._write(self.spark.createDataFrame([], f"{self.columns}, {BATCH} bigint, bucket int"))
        return self

    def read(self) -> DataFrame:
        return self._all().drop("bucket", BATCH)

    def upsert(self, changes: DataFrame, batch: int, now: str = "current_timestamp()") -> int:
        """Rows in place of those with their key, if these are of the same owner and of an older batch, and new rows; stamped with `now`.

        Of several changes of one key in a batch the last by updated_at counts, the largest row of equal ones. Returns the number of folders written.
        """
        fields = [f.name for f in self._all().schema.fields if f.name not in ("bucket", BATCH)]
        latest = changes.groupBy(self.key).agg(F.max(F.struct("updated_at", *(c for c in fields if c not in (self.key, "updated_at")))).alias("c")).select(self.key, "c.*")
        placed = stamped(latest, now).select(*fields).withColumns({BATCH: F.lit(batch).cast("long"), "bucket": self._bucket()})
        return self._change(placed, batch, lambda old, new: old.join(new.select(self.key), self.key, "left_anti").unionByName(new))

    def delete(self, gone: DataFrame, batch: int) -> int:
        """Rows (key, owner) go if they are that owner's. Returns the number of folders written."""
        placed = gone.select(self.key, "owner").distinct().withColumns({BATCH: F.lit(batch).cast("long"), "bucket": self._bucket()})
        return self._change(placed, batch, lambda old, new: old.join(new.select(self.key), self.key, "left_anti"), only_known=True)

    def follow(self, stream: DataFrame, checkpoint: str, now: str = "current_timestamp()"):
        """A stream's changes as they come; a micro-batch that is run again after a failure finds its own number and changes nothing."""
        return stream.writeStream.foreachBatch(lambda df, batch: self.upsert(df, batch, now) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, {BATCH} bigint, bucket int").parquet(self.path)

    def _change(self, changes: DataFrame, batch: int, apply, only_known: bool = False) -> int:
        about = [r["bucket"] for r in changes.select("bucket").distinct().collect()]  # self.buckets at most
        if not about:
            return 0
        old = self._all().where(F.col("bucket").isin(about))
        stored = old.select(self.key, F.col("owner").alias("__owner"), F.col(BATCH).alias("__batch"))
        joined = changes.join(stored, self.key, "inner" if only_known else "left")
        due = joined.where(f"__owner IS NULL OR (__owner = owner AND __batch < {int(batch)})").drop("__owner", "__batch")
        touched = [r["bucket"] for r in due.select("bucket").distinct().collect()]
        if touched:
            after = apply(self._all().where(F.col("bucket").isin(touched)), due)
            left = {r["bucket"] for r in after.select("bucket").distinct().collect()}
            self._write(after)  # folders are replaced when all tasks have read and written
            for bucket in set(touched) - left:  # an overwrite does not see a folder that is to be empty
                self._drop(bucket)
        return len(touched)

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def _drop(self, bucket: int) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
