"""Phrase collocations by Rabin-Karp fingerprints.

Texts become arrays of word fingerprints, whose prefix polynomials give the fingerprint of every n-gram
by two lookups. Three scans count fingerprints (words, pairs, longer ones); a scan takes only n-grams
whose words or pairs the scan before found often enough, which loses none, since no phrase is more
frequent than its parts. What is frequent passes on as a bitmap of at most 2^MAX_BITS bits; its false
positives cost rows, not results. The last scan compares every occurrence of a fingerprint with the text
at its pointer (the first occurrence), splits what differs, and materialises frequent phrases only.

Null texts and texts without words count for nothing; a null lang is `und`; repeated rows count each.
Null ids do not matter but for first_doc, which is null if no other row holds the phrase. Of an empty
table nothing returns. Texts of any length are worked in blocks that end at piece borders, where no
phrase crosses. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialized

LEAST, MOST_WORDS, TOP = 100, 5, 2000
BLOCK_BYTES = 4 << 20
MAX_BITS = 28
#: Odd multipliers of the hashes, as in classifier.py.
MIX, BYTE, WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
_INVERSE = {b: np.uint64(pow(int(b), -1, 1 << 64)) for b in (BYTE, WORD)}
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPACE = BREAK.copy()
SPACE[[0x20, 0x09]] = True
_BREAKS = np.flatnonzero(BREAK).astype(np.uint8).tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums of values * base^i, a zero in front."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values), base), out=total[1:])
    return total


class Block:
    """The words of some texts: their fingerprints (the language counts in), the text and piece of each, and where each stands in `flat`, the words with one space behind each."""

    def __init__(self, texts: list[bytes], seeds: list[int]):
        data = np.frombuffer(b"\n".join(texts).translate(LOWER) + b"\n", np.uint8)
        space = SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.concatenate([[0], edge])
        first, last = edge[0::2], edge[1::2]
        total = _prefix(data.astype(np.uint64) + np.uint64(1), BYTE)
        word = (total[last] - total[first]) * _powers(len(data), _INVERSE[BYTE])[first]
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.text = np.searchsorted(starts, first, "right") - 1
        self.offset = first - starts[self.text]
        self.piece = np.cumsum(BREAK[data], dtype=np.int32)[first]
        self.word = _mixed(word + np.array(seeds, np.uint64)[self.text]) if len(first) else word
        self.total = _prefix(self.word, WORD)
        self.back = _powers(len(word) + 1, _INVERSE[WORD])
        keep = ~space
        keep[last] = True
        flat = data[keep].copy()
        self.end = np.cumsum(last - first + 1) - 1
        self.begin = self.end - (last - first)
        flat[self.end] = 0x20
        self.flat = np.concatenate([flat, np.zeros(8, np.uint8)])

    def grams(self, n: int) -> np.ndarray:
        """The fingerprint of the n words from each word on."""
        many = max(0, len(self.word) - n + 1)
        return _mixed((self.total[n : n + many] - self.total[:many]) * self.back[:many] + np.uint64(n))

    def together(self, n: int) -> np.ndarray:
        """Whether the n words from each word on stand in one piece."""
        many = max(0, len(self.word) - n + 1)
        return self.piece[n - 1 : n - 1 + many] == self.piece[:many]

    def same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from a[i] on are, byte for byte, those from b[i] on."""
        size = self.end[a + n - 1] - self.begin[a]
        equal = size == self.end[b + n - 1] - self.begin[b]
        eight = np.lib.stride_tricks.sliding_window_view(self.flat, 8).view(">u8")[:, 0] if len(self.flat) >= 8 else None
        left = np.flatnonzero(equal)
        at = 0
        while len(left):
            rest = np.minimum(size[left] - at, 8)
            cut = (8 * (8 - rest)).astype(np.uint64)
            x, y = eight[self.begin[a[left]] + at], eight[self.begin[b[left]] + at]
            differs = (x >> cut) != (y >> cut)
            equal[left[differs]] = False
            at += 8
            left = left[~differs]
            left = left[size[left] > at]
        return equal

    def spelled(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each of `at` on as strings."""
        size = self.end[at + n - 1] - self.begin[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        picked = np.arange(ends[-1]) + np.repeat(self.begin[at] - ends[:-1], size)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(self.flat[picked].tobytes())])


def _cut(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, part): parts of about `size` bytes that end at piece borders, or later where a piece is longer."""
    at = 0
    while len(text) - at > size:
        last = max(text.rfind(bytes([b]), at, at + size) for b in _BREAKS)
        if last < 0:
            last = min((f for b in _BREAKS if (f := text.find(bytes([b]), at + size)) >= 0), default=len(text) - 1)
        yield at, text[at : last + 1]
        at = last + 1
    yield at, text[at:]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Block, list, list[str], list[int]]]:
    """(block, ids, languages, offsets) for blocks of `size` bytes or some more; texts in a block stand by id (null last), so a first occurrence has the smallest."""
    seed = {}
    for batch in batches:
        ids, langs, texts = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        some, held = [], 0

        def made(some=some):
            for _, lang, _, _ in some:
                if lang not in seed:
                    seed[lang] = int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")
            return Block([t for *_, t in some], [seed[x[1]] for x in some]), [x[0] for x in some], [x[1] for x in some], [x[2] for x in some]

        for i in order:
            for at, part in _cut(texts[i] or b"", size):
                some.append((ids[i], langs[i], at, part))
                held += len(part)
                if held >= size:
                    yield made()
                    some.clear()
                    held = 0
        if some:
            yield made()


def _inside(found: tuple[int, np.ndarray] | None, grams: np.ndarray) -> np.ndarray:
    """Whether a bitmap holds the fingerprints."""
    bits, words = found
    at = grams >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _counts(docs: DataFrame, sizes: tuple[int, ...], known: dict, least: int) -> DataFrame:
    """fp, c, n of the n-grams of these sizes that occur `least` times or more, known: the bitmap of one smaller size."""
    sent, size = docs.sparkSession.sparkContext.broadcast(known), BLOCK_BYTES

    def run(batches):
        for block, *_ in _blocks(batches, size):
            for n in sizes:
                grams, take = block.grams(n), block.together(n)
                for m, found in sent.value.items():
                    part = _inside(found, block.grams(m))
                    for k in range(n - m + 1):
                        take &= part[k : k + len(take)]
                fps, c = np.unique(grams[take], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(c), pa.array(np.full(len(c), n, np.int8))], names=["fp", "c", "n"])

    rows = docs.mapInArrow(run, "fp bigint, c bigint, n tinyint")
    return rows.groupBy("fp", "n").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def _bitmaps(counted: DataFrame, sizes: tuple[int, ...]) -> dict[int, tuple[int, np.ndarray]]:
    """A bitmap for each size: at least 32 bits a fingerprint, up to 2^MAX_BITS bits. Only its words (2^(MAX_BITS - 6) at most) reach the driver."""
    out = {}
    many = {r["n"]: r["count"] for r in counted.groupBy("n").count().collect()}  # a row for each size
    for n in sizes:
        bits = min(MAX_BITS, max(10, (32 * many.get(n, 0)).bit_length()))
        at = F.shiftrightunsigned("fp", 64 - bits)
        rows = counted.where(F.col("n") == n).select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(fp, {64 - bits}) & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
        out[n] = bits, words
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """lang, phrase, size (in words), a: every phrase of 1 to most_words words that occurs `least` times or more in a language, with its exact count,
    and first_doc, first_byte: its place in the document of smallest id. A row with a null phrase for each language has all its words' number."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))
    known: dict[int, tuple[int, np.ndarray]] = {}
    below: dict[int, tuple[int, np.ndarray]] = {}
    for sizes in ((1,), (2,), tuple(range(3, most_words + 1))):
        sizes = tuple(n for n in sizes if n <= most_words)
        if sizes:
            below = _bitmaps(materialized(_counts(rows, sizes, below, least), "fingerprints"), sizes)
            known |= below
    sent, size = spark.sparkContext.broadcast(known), BLOCK_BYTES
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        def out(langs, phrases, sizes, counts, docs_, at):
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), phrases, pa.array(sizes, pa.int32()), pa.array(counts, pa.int64()), pa.array(docs_), pa.array(at, pa.int64())], names=["lang", "phrase", "size", "a", "doc", "byte"])

        for block, ids, langs, base in _blocks(batches, size):
            here = np.bincount(block.text, minlength=len(ids))
            tongue = np.unique(langs, return_inverse=True)[1]
            per = {}
            for x, c in zip(langs, here.tolist(), strict=True):
                per[x] = per.get(x, 0) + c
            nothing = pa.nulls(len(per), pa.large_string())
            yield out(list(per), nothing.cast(pa.string()), [0] * len(per), list(per.values()), _typed([None] * len(per), kind), [None] * len(per))
            for n, found in sent.value.items():
                grams = block.grams(n)
                at = np.flatnonzero(block.together(n) & _inside(found, grams))
                _, first, group, c = np.unique(grams[at], return_index=True, return_inverse=True, return_counts=True)
                place = at[first][group]
                apart = np.flatnonzero(~block.same(at, place, n) | (tongue[block.text[at]] != tongue[block.text[place]]))  # another phrase with the same fingerprint
                c -= np.bincount(group[apart], minlength=len(c))
                at = np.concatenate([at[first], at[apart]])
                c = np.concatenate([c, np.ones(len(apart), np.int64)])
                owner = block.text[at]
                yield out([langs[i] for i in owner], block.spelled(at, n).cast(pa.string()), np.full(len(at), n), c, _typed([ids[i] for i in owner], kind), block.offset[at] + np.array(base)[owner])

    spelled = rows.mapInArrow(run, f"lang string, phrase string, size int, a bigint, doc {kind}, byte bigint")
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "byte")))
    return spelled.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"), first.alias("p")).where(F.col("phrase").isNull() | (F.col("a") >= least)).select("lang", "phrase", "size", "a", F.col("p.doc").alias("first_doc"), F.col("p.byte").alias("first_byte"))


def _typed(values: list, kind: str) -> pa.Array:
    return pa.array(values, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])


def _head(k: Column) -> Column:
    return F.substring_index("phrase", " ", k)


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, **columns: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, first_doc, first_byte: each language's `top` phrases by their weakest cut.

    A cut after the first k words scores 1000 * a * n div (l * r) in exact decimals; a phrase inside a longer one that is as frequent is dropped.
    The counts are written to the shared folder, since four steps read them.
    """
    counts = materialized(phrase_counts(docs, least, most_words, **columns), "phrases")
    known = counts.where("phrase IS NOT NULL").select("lang", "phrase", "size", "a", "first_doc", "first_byte")
    words = counts.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
    found = known.where("size >= 2")
    # if a longer phrase is as frequent, so is the one with one word more on its way
    whole = found.where("size >= 3").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase")).distinct()
    alone = found.join(whole, ["lang", "phrase", "a"], "left_anti")
    cuts = alone.select("lang", "phrase", "size", "a", "first_doc", "first_byte", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    part = lambda side, c: known.select("lang", F.col("phrase").alias(side), F.col("a").alias(c))
    valued = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(words, "lang")
    number = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    valued = valued.withColumn("score", F.expr(f"({number('1000 * a')} * {number('n')}) DIV ({number('l')} * {number('r')})"))
    weakest = valued.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n", "first_doc", "first_byte")).alias("s")).select("lang", "phrase", "s.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = weakest.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "first_doc", "first_byte")


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs).drop("first_doc", "first_byte")


def oracle() -> str:
    """DuckDB SQL for report(): every phrase is counted."""
    sizes = range(1, MOST_WORDS + 1)
    spelled = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i : i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})" for n in sizes)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH pieces AS (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM ({spelled}) GROUP BY ALL HAVING count(*) >= {LEAST}),
    words AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
    cuts AS (SELECT lang, phrase, size, a, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
    valued AS (
        SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, words.n, (1000::HUGEINT * c.a * words.n) // (x.a::HUGEINT * y.a) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN words ON words.lang = c.lang
        WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = c.lang AND g.size > c.size AND g.a = c.a AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
    weakest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM weakest)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}"""
