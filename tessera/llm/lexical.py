"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so the index groups documents into strata of
equal m. Within a stratum a term's postings are ordered by tf, and an impact (what a unit of the term's
weight adds to a score) is computed once for each tf that occurs. A stratum's bound for a query is the
sum of its weights times the impacts of the largest tf; strata are visited by falling bound, and one
whose bound is under the score of the query's last kept document is left out. Documents of a partition
have near m (range partitioning), each partition keeps its best `top` for each query, and the best of
these rank.

The index holds the postings of the terms of the queries: a row for each document, written once, read for
the statistics and for the search. Queries are worked in blocks of QUERY_BLOCK, whose terms are the only
data sent to all tasks. Scores are 64-bit integers: N, L, n and df come from all documents.

Null and empty texts have no terms: they match nothing and count for nothing. Repeated rows rank each.
Null ids stand last among equal scores. Queries without terms, and empty tables on either side, give no
rows; a query repeated under other ids answers each. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialized

TOP, QUERY_BLOCK = 50, 1000
K_BASE, K_SHARE, UNIT, STEP = 50, 50, 1_000_000_000, 20
#: Documents scored at once: with the block's terms they bound a task's memory.
STRATUM_ROWS = 512
_TERM_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text with repeats: maximal runs of digits, letters and all that is not ASCII; A-Z in lower case."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def postings(docs: DataFrame, wanted: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (arrays, of the wanted terms): documents with a term."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            size, ids, tfs = [], [], []
            for x in batch.column("text"):
                words = terms(x.as_py())
                counts = Counter(words)
                found = sorted((known[w], counts[w]) for w in (counts.keys() & known.keys()))
                size.append(len(words))
                ids.append([t for t, _ in found])
                tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>").where("n > 0")


def _strata(batch: pa.Table, most: int = STRATUM_ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(m, rows, row of each posting, terms, tfs), postings by term and then by falling tf; a stratum of very many rows comes in parts."""
    m = batch["m"].to_numpy()
    lists = batch["terms"].combine_chunks()
    ends = lists.offsets.to_numpy()
    flat, tf = lists.values.to_numpy(), batch["tfs"].combine_chunks().values.to_numpy()
    order = np.argsort(m, kind="stable")
    edges = np.flatnonzero(np.diff(m[order])) + 1
    for part in np.split(order, edges):
        for at in range(0, len(part), most):
            rows = part[at : at + most]
            size = ends[rows + 1] - ends[rows]
            pick = np.arange(size.sum()) + np.repeat(ends[rows] - np.cumsum(size) + size, size)
            row = np.repeat(np.arange(len(rows)), size)
            sort = np.lexsort((-tf[pick], flat[pick]))
            yield int(m[rows[0]]), rows, row[sort], flat[pick][sort], tf[pick][sort]


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What each tf adds for a unit of weight, computed once for each tf."""
    some, back = np.unique(tf, return_inverse=True)
    return ((UNIT * some.astype(np.int64)) // (1000 * some.astype(np.int64) + STEP * m))[back]


class Search:
    """The best documents of one partition for a block of queries: weight is queries x terms."""

    def __init__(self, weight: np.ndarray, top: int):
        self.weight, self.top = weight, top
        self.best: list[list[tuple[int, object]]] = [[] for _ in range(len(weight))]
        self.floor = np.ones(len(weight))  # a score must be above 0
        self.skipped = 0

    def visit(self, strata: list, ids: pa.ChunkedArray) -> None:
        bounds = []
        for m, _, _, term, tf in strata:
            lead = np.flatnonzero(np.diff(term, prepend=-1))  # a term's first posting has its largest tf
            bounds.append(self.weight[:, term[lead]] @ impacts(tf[lead], m).astype(np.float64))
        for k in np.argsort([-b.max(initial=0) for b in bounds], kind="stable"):
            m, rows, row, term, tf = strata[k]
            asked = np.flatnonzero(bounds[k] >= self.floor)
            self.skipped += len(self.weight) - len(asked)
            if not len(asked):
                continue
            used, column = np.unique(term, return_inverse=True)
            dense = np.zeros((len(used), len(rows)))
            dense[column, row] = impacts(tf, m)
            scores = self.weight[np.ix_(asked, used)] @ dense  # whole numbers under 2^53, so sums are exact in any order
            for q, line in zip(asked.tolist(), scores, strict=True):
                good = np.flatnonzero(line >= self.floor[q])
                if not len(good):
                    continue
                if len(good) > self.top:  # what is under the block's own last kept score can't rank; ties stay
                    good = good[line[good] >= -np.partition(-line[good], self.top - 1)[self.top - 1]]
                held = self.best[q] + [(int(line[g]), ids[int(rows[g])].as_py()) for g in good]
                held.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                self.best[q] = held[: self.top]
                if len(held) >= self.top:
                    self.floor[q] = self.best[q][-1][0]


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each query; equal scores stand by doc_id.

    The queries are a stated set, read by the driver in blocks; documents never are.
    """
    asked = queries.select(F.col(f"`{query_id}`").alias("item_id"), F.col(f"`{query_text}`").alias("text")).orderBy("item_id", "text")
    out, block = None, []

    def done(some):
        found = _search(docs, some, top, doc_id, text, asked.schema["item_id"].dataType.simpleString())
        return found if out is None else out.unionByName(found)

    for row in asked.toLocalIterator():
        block.append((row["item_id"], set(terms(row["text"]))))
        if len(block) == QUERY_BLOCK:
            out, block = done(block), []
    return done(block) if block or out is None else out


def _search(docs: DataFrame, asked: list, top: int, doc_id: str, text: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    wanted = {w: i for i, w in enumerate(sorted(set().union(*(t for _, t in asked))))}
    index = materialized(postings(docs, wanted, doc_id, text), "postings")
    size = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(len(wanted), np.int64)
    counted = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a row for each term of the block's queries
    df[counted["t"].to_numpy()] = counted["df"].to_numpy()
    worth = np.floor(1000 * np.log((2 * size["n"] + 2) / (2 * df + 1)))
    weight = np.zeros((len(asked), len(wanted)))
    for q, (_, some) in enumerate(asked):
        for w in some:
            weight[q, wanted[w]] = worth[wanted[w]]
    sent, most = spark.sparkContext.broadcast(weight), STRATUM_ROWS
    id_kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, held, rows = Search(sent.value, top), [], 0

        def visited():
            whole = pa.Table.from_batches(held)
            engine.visit(list(_strata(whole, most)), whole["doc_id"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16 * most:
                visited()
                held, rows = [], 0
        if held:
            visited()
        found = [(q, s, d) for q, best in enumerate(engine.best) for s, d in best]
        if found:
            q, s, d = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.int64()), pa.array(d, pa.int64() if id_kind == "bigint" else None)], names=["q", "score", "doc_id"])

    m = F.lit(K_BASE) + F.expr(f"({K_SHARE} * n * {size['n']}L) DIV {max(1, size['l'])}L")
    # equal lengths may be a third of all rows: the id's hash splits them
    strata = index.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs").repartitionByRange("m", F.xxhash64("doc_id"))
    best = strata.mapInArrow(run, f"q int, score bigint, doc_id {id_kind}")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(asked)], f"q int, item_id {kind}")
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")  # a row for each query of the block


def oracle() -> str:
    """DuckDB SQL for search() of the benchmark in the documents."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spelled = lambda rows: f"regexp_extract_all(translate(coalesce({rows}.text, ''), '{upper}', '{lower}'), '{term}')"
    return f"""WITH d AS (SELECT doc_id, {spelled('documents')} AS t FROM documents),
    s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS words FROM d WHERE len(t) > 0),
    q AS (SELECT DISTINCT item_id, unnest({spelled('benchmark')}) AS term FROM benchmark),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
    scored AS (SELECT item_id, doc_id, sum(w * (({UNIT} * tf) // (1000 * tf + {STEP} * ({K_BASE} + ({K_SHARE} * n * docs) // words))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}"""
