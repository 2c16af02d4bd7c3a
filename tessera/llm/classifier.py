"""A supervised quality classifier on subword embeddings.

Words, character n-grams (over bytes, inside words with their borders) and the bigram of a
word with itself are hashed into buckets; each bucket has a learned vector; a document is
the mean of its vectors; a linear layer with softmax gives the labels' probabilities.
Without that bigram a word said over and over looks like prose: of 788 held-out junk
documents 76 % were found then, all of them with it. Stochastic gradient descent in numpy
trains on a bounded sample of labelled rows (MAX_TRAIN_ROWS, a documented bound), each of any length: the tasks turn
a whole text into its buckets and their shares, of which a text's MOST_BUCKETS most frequent teach; they reach the driver packed and are unpacked a step at a time; the cost does not grow with the corpus. As the score is linear in the mean, each bucket's
vector folds into one number, and whole texts are scored by array operations in the tasks.

Null and empty texts have one feature, the end mark, and so a score. Labels that repeat for
a doc_id count by their mean (0.5 or more is 1); null labels or ids teach nothing; of rows
that share a doc_id the smallest text teaches. Repeated rows get the same score each. Extra columns are not read. With no labelled rows
of both kinds at hand every score is the share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows

BUCKETS = 1 << 17
DIM = 8
#: The labelled rows that training takes at most (those with the smallest hash of their id).
MAX_TRAIN_ROWS = 4000
#: Buckets of a text that teach at most (texts of up to some 10,000 characters have fewer); so the driver gets 0.5 GB at the very most, before packing.
MOST_BUCKETS = 1 << 14
EPOCHS, BATCH, RATE = 5, 32, 0.5
NGRAMS = (3, 5)
THRESHOLD = 0.3
#: Odd multipliers of the hashes: the fractional parts of the golden ratio and of the square root of 2 in 64 bits.
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x6A09E667F3BCC909)
SHIFT = np.uint64(64 - 17)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
END, AGAIN = 0, 1  # the buckets of the end mark, and of the bigram of any word with itself


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and the document of each, of texts whose bytes are data[offsets[i]:offsets[i + 1]].

    Every text has a space before and after it that stands for the borders.
    """
    docs = len(offsets) - 1
    doc_of = np.repeat(np.arange(docs, dtype=np.int32), np.diff(offsets))
    space = _SPACE[data]
    value = np.where(space, 1, data.astype(np.uint64) + np.uint64(2))
    buckets, owners = [np.full(docs, END, np.int64)], [np.arange(docs, dtype=np.int32)]
    n = len(data)
    # words: the difference of prefix sums of value * BASE^i, moved back to the word's start
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if n and not space[0]:
        edge = np.concatenate([[0], edge])
    if n and not space[-1]:
        edge = np.concatenate([edge, [n]])
    starts, ends = edge[0::2], edge[1::2]
    if len(starts):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(n, BASE))])
        word = (total[ends] - total[starts]) * _powers(n, _INVERSE)[starts]
        buckets.append(((word * MIX) >> SHIFT).astype(np.int64))
        owners.append(doc_of[starts])
        again = np.flatnonzero((word[1:] == word[:-1]) & (doc_of[starts[1:]] == doc_of[starts[:-1]])) + 1
        buckets.append(np.full(len(again), AGAIN, np.int64))
        owners.append(doc_of[starts[again]])
    for size in NGRAMS:
        if n < size:
            continue
        inner = np.zeros(n - size + 1, np.int8)
        for k in range(1, size - 1):
            inner |= space[k : n - size + 1 + k].view(np.int8)
        at = np.flatnonzero(inner == 0)  # a border may be first or last, not inside
        at = at[doc_of[at] == doc_of[at + size - 1]]
        gram = np.full(len(at), size, np.uint64)
        for k in range(size):
            gram = gram * BASE + value[at + k]
        buckets.append(((gram * MIX) >> SHIFT).astype(np.int64))
        owners.append(doc_of[at])
    return np.concatenate(buckets), np.concatenate(owners)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each between two spaces, and the offsets."""
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])


class Model:
    """bias plus the mean of `weight` over a text's features is the logit of label 1."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        a = 0
        while a < len(texts):  # blocks bound the memory, whatever the texts' lengths
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) < 1 << 18):
                size += len(texts[b])
                b += 1
            buckets, owners = features(*joined(texts[a:b]))
            total = np.bincount(owners, self.weight[buckets], b - a)
            out[a:b] = total / np.bincount(owners, minlength=b - a) + self.bias
            a = b
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def shares(text: bytes, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their shares of its features: the MOST_BUCKETS most frequent, ties by bucket.

    Long texts are counted in blocks that end at white space; an n-gram keeps to its word, so none is cut but in a word longer than a block.
    """
    counts = np.zeros(BUCKETS, np.int64)
    at = 0
    while at < len(text) or not at:
        end = at + block
        if end < len(text):
            cut = max(text.rfind(s, at, end) for s in (b" ", b"\n", b"\t"))
            end = cut + 1 if cut > at else end
        counts += np.bincount(features(*joined([text[at:end]]))[0], minlength=BUCKETS)
        at = max(end, 1)
    counts[END] = 1
    ids = np.flatnonzero(counts)
    total = counts[ids].sum()
    if len(ids) > MOST_BUCKETS:
        ids = np.sort(ids[np.lexsort((ids, -counts[ids]))[:MOST_BUCKETS]])
    return ids.astype(np.int32), (counts[ids] / total).astype(np.float32)


def packed(ids: np.ndarray, share_of: np.ndarray) -> bytes:
    """What shares() gives; sorted buckets lie close together and few shares differ, so both compress well."""
    return zlib.compress(np.diff(ids, prepend=np.int32(0)).astype("<i4").tobytes() + share_of.astype("<f4").tobytes(), 1)


class Lessons(Sequence):
    """Texts' buckets and shares, kept packed and unpacked when asked for, so the driver never holds them all."""

    def __init__(self, texts: pa.ChunkedArray):
        self.texts, self.nbytes = texts, texts.nbytes

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i >= len(self):
            raise IndexError(i)
        data = zlib.decompress(self.texts[int(i)].as_buffer())
        n = len(data) // 8
        return np.cumsum(np.frombuffer(data, "<i4", n), dtype=np.int32), np.frombuffer(data, "<f4", n, 4 * n)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    return train_on([shares(t) for t in texts], labels, seed)


def train_on(parts: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Gradient descent on the vectors and the softmax layer, from each text's buckets and shares. Classes weigh as their numbers' square roots, so rare junk counts."""
    share = float(np.mean(labels)) if len(labels) else 0.5
    if not 0 < share < 1:
        logit = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Model(np.zeros(BUCKETS), logit if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    weigh = np.sqrt(0.5 / np.array([1 - share, share], np.float32))
    steps, step = EPOCHS * -(-len(parts) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(parts))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            taken = [parts[i] for i in some]
            ids = np.concatenate([i for i, _ in taken])
            share_of = np.concatenate([s for _, s in taken])
            first = np.concatenate([[0], np.cumsum([len(i) for i, _ in taken])[:-1]])
            mean = np.add.reduceat(table[ids] * share_of[:, None], first, axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[some]
            p[np.arange(len(some)), y] -= 1
            p *= weigh[y][:, None]
            rate = RATE * (1 - step / steps)
            back = np.repeat(p @ layer.T, np.diff(np.append(first, len(ids))), axis=0) * share_of[:, None]
            layer -= rate * (mean.T @ p)
            bias -= rate * p.sum(0) / BATCH
            np.subtract.at(table, ids, rate * len(some) / 2 * back)
            step += 1
    w = (layer[:, 1] - layer[:, 0]).astype(np.float64)
    return Model(table.astype(np.float64) @ w, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learns from at most max_rows labelled documents, of any length, that are not held out."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    taught = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most max_rows ids are broadcast

    def counted(batches):
        for b in batches:
            found = [packed(*shares(t.as_py() or b"")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "lesson"])

    kind = taught.schema["doc_id"].dataType.simpleString()
    rows = taught.mapInArrow(counted, f"doc_id {kind}, label int, lesson binary").toArrow().sort_by("doc_id")
    return train_on(Lessons(rows["lesson"]), np.array(rows["label"].to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """`keep`, then `name`: the score (0 to 1). The model is one number a bucket (1 MB), whatever the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            return [pa.array(sent.value.score(texts), pa.float64())]

        return work

    return map_rows(docs, make, f"{name} double", list(keep))
