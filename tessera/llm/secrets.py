"""Secret scans over an incremental ledger of blobs.

Every version of every text is content-addressed (SHA-256). The ledger holds one row for
each (blob, rule version) ever scanned, with its findings; a scan takes only the pairs
that the ledger lacks, so copies and unchanged history cost a hash. Findings are joined
back to all paths that hold the blob.

Null texts are the empty blob. Repeated rows and copies share one blob and each get its
findings; rows with a null path keep it. An empty table gives an empty result. Extra
columns of the versions table are not read, except by redact(), which keeps them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows, shared_path, strings, unused

#: kind, pattern, group whose length counts, its least length. Leftmost matches that do not
#: overlap within a kind; those whose group is too short are then dropped.
RULES: list[tuple[str, str, int, int]] = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # as AKIA[A-Z0-9]+ of 20 or more: a run's first match is its longest
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # as [0-9a-f]+ of 24 or more, for the same reason
    ("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]
BASE = ("assign", "access", "hex")
PLACEHOLDER = "[SECRET]"
#: Rows of one blob are dealt over so many join keys; blobs with findings, few and narrow, are repeated as often.
SALTS = 16
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def find(text: str, rules: list) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end), in that order."""
    return sorted((m.start(), k, m.end()) for k, (pattern, group, least) in enumerate(rules) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)


def scan(texts: DataFrame, rules=RULES, keep: list[str] = ("blob_id",), text: str = "text") -> DataFrame:
    """`keep`, findings: array of (kind, start, end) in code points, end exclusive."""

    def make():
        compiled = [(re.compile(p), g, n) for _, p, g, n in rules]
        kinds = [r[0] for r in rules]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in find(t, compiled)] for t in strings(batch, text)]
            return [pa.array(found, pa.list_(kind))]

        return work

    return map_rows(texts, make, f"findings {FINDINGS}", list(keep))


def update_ledger(versions: DataFrame, ledger_path: str, rules=RULES, text: str = "text") -> DataFrame:
    """Scans the blobs of `versions` that the ledger lacks under these rules, appends them, and returns the ledger's rows for these rules.

    Copies meet in a partial aggregate before the shuffle, so a blob that a third of all rows
    share moves once for each map task.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    schema = f"blob_id binary, rule_version string, findings {FINDINGS}"
    blobs = versions.select(blob_id(F.col(text)).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("blob_id").agg(F.first("text").alias("text"))
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        seen = spark.read.schema(schema).parquet(ledger_path).where(F.col("rule_version") == version)
        blobs = blobs.join(seen.select("blob_id"), "blob_id", "left_anti")
    scan(blobs, rules).select("blob_id", F.lit(version).alias("rule_version"), "findings").write.mode("append").parquet(ledger_path)
    return spark.read.schema(schema).parquet(ledger_path).where(F.col("rule_version") == version).drop("rule_version")


def _with_findings(versions: DataFrame, ledger: DataFrame, text: str, found: str) -> DataFrame:
    """`versions` and, as `found`, the findings of its blob (null: none)."""
    blob, salt = unused([*versions.columns, found], "blob"), unused([*versions.columns, found], "salt")
    # two scans at once may have told the ledger of one blob twice
    hits = ledger.where(F.size("findings") > 0).dropDuplicates(["blob_id"]).select(F.col("blob_id").alias(blob), F.col("findings").alias(found), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    others = [F.col(f"`{f.name}`") for f in versions.schema if f.name != text and "map<" not in f.dataType.simpleString()]
    keyed = versions.withColumn(blob, blob_id(F.col(f"`{text}`"))).withColumn(salt, F.pmod(F.xxhash64(F.lit(0), *others), F.lit(SALTS)).cast("int"))
    return keyed.join(hits, [blob, salt], "left").drop(blob, salt)


def findings_by_path(versions: DataFrame, ledger: DataFrame, paths: list[str], text: str = "text") -> DataFrame:
    """`paths`, findings: a row for each row of `versions`."""
    return _with_findings(versions.select(*dict.fromkeys([*paths, text])), ledger, text, "findings").select(*paths, "findings")


def without(text: str, spans: list[tuple[int, int]], placeholder: str) -> str:
    """The text with each span replaced, in one pass; spans that meet or overlap become one."""
    parts, at, open_ = [], 0, None
    for a, b in sorted(spans):
        if open_ is not None and a <= open_:
            open_ = max(open_, b)
        else:
            if open_ is not None:
                at = open_
            parts += [text[at:a], placeholder]
            open_ = b
    return "".join(parts) + text[open_ or 0 :]


def redact(versions: DataFrame, ledger: DataFrame, text: str = "text", placeholder: str = PLACEHOLDER) -> DataFrame:
    """`versions` with every found span of the text replaced; overlapping spans become one."""
    found = unused(versions.columns, "findings")
    bound_batches(versions.sparkSession)

    def cut_out(texts: pa.Array, findings: pa.Array) -> pa.Array:
        return pa.array([t if f is None or t is None else without(t, [(x["start"], x["end"]) for x in f], placeholder) for t, f in zip(texts.to_pylist(), findings.to_pylist(), strict=True)], pa.string())

    cut = F.arrow_udf(cut_out, "string")(F.col(f"`{text}`"), F.col(found))
    joined = _with_findings(versions, ledger, text, found)
    return joined.select(*(F.when(F.col(found).isNull(), F.col(f"`{c}`")).otherwise(cut).alias(c) if c == text else F.col(f"`{c}`") for c in versions.columns))


def report(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    ledger = update_ledger(docs, ledger_path or shared_path(docs.sparkSession, "ledger"))
    found = findings_by_path(docs, ledger, ["doc_id"]).withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")))
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"))
