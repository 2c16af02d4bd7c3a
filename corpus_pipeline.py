"""A cleaning pipeline over `documents`: five operators, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the
shared folder and rereads as the next stage's docs. All but the last return the columns of
documents. ORACLE_SQL is None: training, XXH64 fingerprints and BPE have no SQL form, so the
tests compare each stage with a brute-force version.

Every stage takes null ids and texts, empty and very long texts, ties, repeated rows, empty
tables, and extra columns of any name, which all but the last keep; its docstring says what
becomes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, classifier, decontaminate, secrets, simhash
from tessera.llm.common import forget, scratch, shared_path, table, unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under the threshold.

    Rows are scored one by one: repeated rows share a fate, null and empty texts have the score of the end mark alone, null
    ids are scored like others. Without labels every score is 0.5 and all rows stay.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    score = unused(columns, "score")
    scored = classifier.score(docs, model, keep=columns, name=score)
    return scored.where(F.col(score) >= classifier.THRESHOLD).select(*(F.col(f"`{c}`") for c in columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the smallest doc_id (null last), of repeated rows one.

    Null and wordless texts have fingerprint zero and so form one group.
    """
    return simhash.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whatever their id; null and empty texts hold none. Without items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. No row goes; null texts stay null; repeated rows change alike."""
    ledger = secrets.update_ledger(docs, shared_path(spark, "ledger"))
    clean = secrets.redact(docs, ledger)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), and whether decoding gives the text back; null texts have no ids."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secret),
    ("byte_level_bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table. A stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            last, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
