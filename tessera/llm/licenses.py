"""License scans: an exact set-similarity join of text blocks with license templates.

Words lie in overlapping blocks of 64, one every 32 words, so any run of 33 words or fewer
is whole in a block. A template matches a block that holds at least its threshold share
of the template's distinct words. Template words are ordered by their frequency over all
documents, rarest first; block and template share a word of both prefixes if they match
(prefix filter), the block has enough words (length filter), and the places of that word
in both orders leave enough to come (positional filter); what passes is counted exactly.
A base phrase is a template with threshold 1 whose words must then stand consecutively.

Null texts are empty. Rows of equal doc_id and text share one computation and each get its
result; null doc_ids are kept. Extra columns are not read. An empty table gives no rows.
Only DataFrame functions are used; the driver gets one count for each template word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Label and phrase.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: The method's own: label, words, threshold.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", 0.8),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", 0.8),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", 0.8),
    ("cc-by-4.0", "licensed under the creative commons attribution 4 0 international license", 0.8),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.8),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", 0.8),
]
STRIDE = 32
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Prefix rows up to which the template index is broadcast; beyond, Spark chooses the join.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def templates(base=BASE, more=TEMPLATES) -> list[tuple[str, list[str], float, bool]]:
    """label, words in order, threshold, whether the words must be consecutive."""
    found = [(label, phrase.split(), 1.0, True) for label, phrase in base] + [(label, text.split(), share, False) for label, text, share in more]
    if any(not w or len(w) > STRIDE + 1 for _, w, _, _ in found):
        raise ValueError(f"a template has 1 to {STRIDE + 1} words")
    return found


def word_order(docs: DataFrame, vocabulary: list[str], text: str = "text") -> list[str]:
    """The vocabulary, words of fewer documents first; ties by the word."""
    held = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words(F.col(text)))).alias("word"))
    count = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each template word at most
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def find(docs: DataFrame, base=BASE, more=TEMPLATES, text: str = "text") -> DataFrame:
    """doc_id, key, n_words, self, hit: for each row of docs one with self true and no hit, and one for each block and template that match.

    hit: label, consecutive, share, and of consecutive templates the first and last start and the number of places.
    """
    given = templates(base, more)
    vocabulary = sorted({w for _, ws, _, _ in given for w in ws})
    order = word_order(docs, vocabulary, text)
    rank = {w: i for i, w in enumerate(order)}
    literal = lambda xs: F.array(*map(F.lit, xs))
    entries = []
    for label, ws, share, consecutive in given:
        distinct = sorted(set(ws), key=rank.get)
        need = math.ceil(share * len(distinct) - 1e-9)
        for i, w in enumerate(distinct[: len(distinct) - need + 1]):
            entries.append((w, i, label, need, distinct, ws, consecutive))
    names = ("word", "i", "label", "need", "template", "phrase", "consecutive")
    index = docs.sparkSession.range(1).select(F.inline(F.array(*(F.struct(*((literal(v) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(names, e, strict=True))) for e in entries))))
    index = F.broadcast(index) if len(entries) <= BROADCAST_ROWS else index
    starts = sorted({e[0] for e in entries})

    lists = docs.select("doc_id", F.xxhash64(text).alias("key"), words(F.col(text)).alias("words"))
    lists = lists.withColumn("n_words", F.size("words").cast("long"))
    cut = F.expr(f"transform(sequence(0, greatest(cast(ceil(n_words / {STRIDE}) as int), 1) - 1), k -> slice(words, k * {STRIDE} + 1, {2 * STRIDE}))")
    blocks = lists.select("doc_id", "key", "n_words", F.posexplode(cut).alias("block", "words"))
    blocks = blocks.withColumn("held", F.array_intersect(literal(order), "words"))
    # the word '' stands for the document itself, once, in its first block
    asks = F.concat(F.when(F.col("block") == 0, F.array(F.struct(F.lit(-1).alias("j"), F.lit("").alias("word")))).otherwise(F.expr("cast(array() as array<struct<j:int,word:string>>)")), F.expr("transform(held, (w, j) -> struct(j as j, w as word))"))
    asked = blocks.select("doc_id", "key", "n_words", "block", "words", "held", F.inline(asks)).where((F.col("word") == "") | F.col("word").isin(starts))
    joined = asked.join(index, "word", "left")
    b, t = F.size("held"), F.size("template")
    passes = (b >= F.col("need")) & (F.col("j") < b - F.col("need") + 1) & (F.least(t - F.col("i"), b - F.col("j")) >= F.col("need"))
    common = F.array_intersect("template", "held")
    joined = joined.where((F.col("word") == "") | passes).withColumn("common", common)
    exact = (F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("word"))  # each pair by its first common word alone
    joined = joined.where((F.col("word") == "") | exact)
    places = F.when(F.col("consecutive"), F.expr(f"filter(sequence(1, {STRIDE}), p -> slice(words, p, size(phrase)) = phrase)"))
    joined = joined.withColumn("places", places).where((F.col("word") == "") | ~F.col("consecutive") | (F.size("places") > 0))
    offset = F.col("block").cast("long") * STRIDE - 1
    hit = F.when(F.col("word") != "", F.struct("label", "consecutive", (F.size("common") / t).alias("share"), (offset + F.array_min("places")).alias("first"), (offset + F.array_max("places")).alias("last"), F.coalesce(F.size("places"), F.lit(0)).alias("places")))
    return joined.select("doc_id", "key", "n_words", (F.col("word") == "").alias("self"), hit.alias("hit"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template found)."""
    joined_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("hit.consecutive")
    found = find(docs).groupBy("doc_id", "key").agg(
        F.sum(F.col("self").cast("int")).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.sum(F.when(base, F.col("hit.places"))).alias("places"),
        F.min("hit.first").alias("first_word"),
        F.max("hit.last").alias("last_word"),
        joined_set(F.when(base, F.col("hit.label"))).alias("base_labels"),
        joined_set(F.col("hit.label")).alias("labels"),
        F.coalesce(F.max("hit.share"), F.lit(0.0)).alias("score"),
    )
    n_base = (F.coalesce("places", F.lit(0)) / F.col("copies")).cast("long").alias("n_base")  # copies of a row each gave its places
    return found.select("doc_id", "n_words", n_base, "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy")).drop("copy")


def oracle() -> str:
    """The same result in DuckDB: every block against every template."""
    rows = ", ".join(f"('{label}', {ws!r}, {sorted(set(ws))!r}, {math.ceil(share * len(set(ws)) - 1e-9)}, {str(consecutive).lower()})" for label, ws, share, consecutive in templates())
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
templates(label, phrase, words, need, consecutive) AS (VALUES {rows}),
blocks AS (
  SELECT r, k, list_slice(w, k * {STRIDE} + 1, k * {STRIDE} + {2 * STRIDE}) AS b
  FROM (SELECT r, w, unnest(range(0, greatest(CAST(ceil(len(w) / {STRIDE}) AS BIGINT), 1))) AS k FROM docs)),
near AS (
  SELECT r, k, b, label, phrase, consecutive, len(list_intersect(words, b)) / len(words) AS share
  FROM blocks, templates WHERE len(list_intersect(words, b)) >= need),
hits AS (
  SELECT *, CASE WHEN consecutive THEN list_filter(range(0, {STRIDE}), lambda p: list_slice(b, p + 1, p + len(phrase)) = phrase) END AS places FROM near),
good AS (SELECT * FROM hits WHERE NOT consecutive OR len(places) > 0),
found AS (
  SELECT r, sum(len(places)) AS n_base, min(k * {STRIDE} + list_min(places)) AS first_word, max(k * {STRIDE} + list_max(places)) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (consecutive)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM docs LEFT JOIN found USING (r)"""
