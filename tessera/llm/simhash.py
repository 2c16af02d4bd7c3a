"""Near-duplicate documents by SimHash.

A fingerprint is cut into 32 segments of two bits. Each segment's bit count, written in
unary (0: 00, 1: 01, 2: 11), embeds it so that the Hamming distance of two embeddings is
the Manhattan distance of their bit counts, which never exceeds the fingerprints' Hamming
distance. Two fingerprints within 3 bits therefore differ by 1 or less in the counts of the
lower or of the upper 16 segments: each is looked up in its own cell of that half's grid
and in the cells one step above, then the whole Manhattan bound and the exact distance are
checked inside the join. Equal fingerprints count once, so copies cost no pairs. Linked
fingerprints form components by alternating stars.

Null texts are empty: fingerprint zero, linked like any other. Repeated rows each get the
same result. A row with a null doc_id takes part in links; component ids come from the
known ids (null if a component has none). Extra columns are ignored; an empty table gives
no rows. deduplicated() keeps one of repeated rows, and all columns, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialized, row_key, unused
from .graph import components

SEED = 42
SHINGLE = 3
RADIUS = 3
HALVES = 2
_LOW = 0x5555555555555555
#: A fingerprint of at least this share of all rows is joined by broadcast; there can be no more than its inverse.
HOT_SHARE = 0.001


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """As a signed 64-bit number; A-Z are lower-cased, words end at the six ASCII spaces."""
    words = text.lower().split()  # bytes: ASCII alone, both times
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - width]]).tolist()
        pieces = [line[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n - width + 1)
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    packed = np.packbits((2 * bits > len(hashes)).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, fp (long)."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([fingerprint(t or b"") for t in batch.column(text).cast(pa.binary()).to_pylist()], pa.int64())]

        return work

    return map_rows(docs.select(*dict.fromkeys([*keep, text])), make, "fp bigint", list(keep))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: every pair of different fingerprints (column fp, each once) within `radius` (3 or less) bits; some pairs twice."""
    if radius > 2 * HALVES - 1:
        raise ValueError("two halves and cells one step apart find 3 bits or fewer")
    low = f"{_LOW}L"
    unary = F.expr(f"shiftleft(fp & shiftrightunsigned(fp, 1) & {low}, 1) | ((fp | shiftrightunsigned(fp, 1)) & {low})")
    halves = distinct.select("fp", unary.alias("e")).select("fp", "e", F.posexplode(F.expr("array(e & 4294967295L, shiftrightunsigned(e, 32))")).alias("half", "cell"))
    above = """concat(array(cell), filter(transform(sequence(0, 15), k -> cell | shiftleft(
        case shiftright(cell, 2 * k) & 3L when 0L then 1L when 1L then 2L else 0L end, 2 * k)), c -> c <> cell))"""
    asks = halves.select(F.col("fp").alias("u"), F.col("e").alias("eu"), "half", F.col("cell").alias("home"), F.explode(F.expr(above)).alias("cell"))
    has = halves.select(F.col("fp").alias("v"), F.col("e").alias("ev"), "half", "cell")
    near = F.expr(f"bit_count(eu ^ ev) <= {radius} AND bit_count(u ^ v) <= {radius} AND (home <> cell OR u < v)")
    return asks.join(has, ["half", "cell"]).where(near).select("u", "v")


def grouped(docs: DataFrame, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` (doc_id among them), fp, component_id, root; root is a key of the component that is never null."""
    rows = materialized(fingerprints(docs, keep, text), "fingerprints")
    reps = materialized(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct_fingerprints")
    roots = materialized(components(links(reps.select("fp"))).withColumnRenamed("node", "fp"), "roots")
    linked = roots.join(reps, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = linked.join(least, "root").select("fp", "root", "least")
    classes = materialized(reps.join(named, "fp", "left").select("fp", "n", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "fp").alias("root")), "classes")
    least_hot = HOT_SHARE * (classes.agg(F.sum("n")).first()[0] or 0)
    hot = F.broadcast(classes.where(F.col("n") >= least_hot).drop("n"))  # 1 / HOT_SHARE rows at most
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(classes.where(F.col("n") < least_hot).drop("n"), "fp")
    return rows.join(hot, "fp").unionByName(cold)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    found = grouped(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with one document of each group: the smallest doc_id, then the smallest text hash; of equal rows one."""
    key = unused(docs.columns, "row_key")
    keyed = docs.select("doc_id", text).withColumn(key, row_key("doc_id", text))
    found = grouped(keyed, ["doc_id", key], text)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(key).alias("k"))).alias("s"))
    marked = docs.withColumn(key, row_key("doc_id", text))
    return marked.join(kept.select(F.col("s.k").alias(key)), key, "left_semi").dropDuplicates([key]).drop(key)
