"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two spans of text sums, over all sequences of three or four letters that both hold in this
order within REACH characters, the products of DECAY ^ (characters spanned). Gaps may hold anything, so an
insult keeps most of its subsequences when characters are put in or left out (`idxiot`). Spans are windows:
WINDOW starting places in a row, in the lower-cased text of a document without signs and digits, where white
space is one space and three or more single letters in a row are one word (`i.d.i.o.t`, `i d i o t`).

A label says that a document is toxic, not where. A toxic text's witnesses are its best windows by the log
odds of their subsequences, WITNESSES at most, the first in any case, others if clean texts hardly have such;
each also teaches with a letter put in. Of clean texts teach windows at even distances and, in ROUNDS
rounds, those that the machine so far takes for the most toxic. The kernel to LANDMARKS windows
gives Nyström features, on which a linear machine is trained by dual coordinate ascent. As subsequences are
few for a short window, the sum over landmarks folds into one weight for each hashed subsequence: scoring
needs no landmark and is linear in the text. A document's score is a logistic function of its best window.

Texts are reduced in the tasks, whatever their length: per-bucket document counts, then some windows of
WINDOW + FAR characters for each labelled document. The driver gets those of at most MAX_TRAIN_ROWS documents of each
label (those with the smallest hashes; a documented bound) and a table of BUCKETS counts.

Null and empty texts score as a window of nothing does. Labels that repeat for an id count by their mean
(0.5 or more is 1); null ids and labels teach nothing; of rows that share an id the smallest text teaches.
Repeated rows score alike. Without labels of both kinds every score is the share of label 1 (0 if there are none).
Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifier import held_out
from .common import bound_batches, map_rows, materialized

#: Spans that three and four letters may take.
REACH = {3: 5, 4: 6}
FAR = max(REACH.values())
DECAY, WINDOW = 0.75, 8
BITS = 19
BUCKETS = 1 << BITS
#: Labelled documents of each label that teach (those with the smallest hash of their id).
MAX_TRAIN_ROWS = 4000
LANDMARKS, WITNESSES, ROUNDS, EPOCHS, COST = 512, 6, 3, 15, 1.0
#: Toxic windows that teach at most. Windows of clean texts at even distances in each, and those that a round adds: the hardest.
MOST_TOXIC, EVEN, HARDEST = 5000, 2, 4000
#: With fewer documents of a label all teach, and the cut is set by the same ones.
FEW = 90
THRESHOLD = 0.5
#: Characters that pad texts, so that no window meets two of them.
PAD = WINDOW + FAR
BLOCK_BYTES = 1 << 18
_MIX = np.uint32(0x9E3779B1)
_BASE = np.uint32(0x85EBCA6B)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WHITE = bytes([0x20, *range(0x09, 0x0E)])
_SIGNS = bytes(c for c in range(128) if not bytes([c]).isalpha() and c not in _WHITE)
_APART = re.compile(rb"(?<![^ ])[^ ](?: [^ ]){2,}(?![^ ])")


def squeezed(text: bytes) -> bytes:
    """Lower case without signs and digits, one space for white space, single letters in a row joined."""
    plain = b" ".join(text.translate(_LOWER, _SIGNS).split())
    return _APART.sub(lambda m: m[0].replace(b" ", b""), plain)


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The squeezed texts' bytes with PAD spaces behind each, and their starts (and the end)."""
    parts = [squeezed(t) + b" " * PAD for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def subsequences(data: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, buckets, valid) for each shape of gaps: the subsequence that starts at each place, valid if all its characters are letters."""
    many = max(0, len(data) - FAR + 1)
    value, letter = data.astype(np.uint32), data != 32
    mixed = lambda code: (code ^ (code >> np.uint32(15))) * _MIX >> np.uint32(32 - BITS)
    more = lambda code, fine, at: ((code + value[at : at + many]) * _BASE, fine & letter[at : at + many])
    for i in range(1, FAR - 1):
        two = more(value[:many] * _BASE, letter[:many], i)
        for j in range(i + 1, FAR):
            three = more(*two, j)
            if j < REACH[3]:
                yield DECAY ** (j + 1), mixed(three[0]), three[1]
            for k in range(j + 1, REACH[4]):
                four = more(*three, k)
                yield DECAY ** (k + 1), mixed(four[0]), four[1]


def places(data: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What the subsequences that start at each place add."""
    out = np.zeros(max(0, len(data) - FAR + 1), np.float32)
    for decay, bucket, valid in subsequences(data):
        out += np.float32(decay) * np.where(valid, weight[bucket], np.float32(0))
    return out


def windows(value: np.ndarray) -> np.ndarray:
    """Sums over WINDOW places from each place on."""
    total = np.concatenate([np.zeros(1), np.cumsum(value, dtype=np.float64)])
    total = np.concatenate([total, np.full(WINDOW - 1, total[-1])])
    return total[WINDOW:] - total[:-WINDOW]


def best(texts: list[bytes], weight: np.ndarray) -> np.ndarray:
    """The best window's sum of each text."""
    out, a = np.zeros(len(texts)), 0
    while a < len(texts):  # blocks bound the memory
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < BLOCK_BYTES):
            size += len(texts[b])
            b += 1
        if size > 4 * BLOCK_BYTES:  # one long text: parts that overlap by a window
            whole = squeezed(texts[a])
            step = BLOCK_BYTES
            out[a] = max(float(windows(places(np.frombuffer(whole[k : k + step + PAD] + b" " * PAD, np.uint8), weight)).max()) for k in range(0, max(1, len(whole)), step))
        else:
            data, starts = stream(texts[a:b])
            sums = windows(places(data, weight))
            ends = starts[1:] - PAD + 1  # later windows would reach the next text
            out[a:b] = np.maximum.reduceat(sums, np.stack([starts[:-1], ends], 1).ravel())[::2]
        a = b
    return out


def picked(text: bytes, weight: np.ndarray, many: int, even: int = 0, gap: int = 2 * WINDOW) -> tuple[list[bytes], float]:
    """The text's `many` best windows, apart by `gap` places, best first, then `even` at even distances; and the best sum."""
    data, _ = stream([text])
    sums = windows(places(data, weight))
    found: list[int] = []
    for at in np.argsort(-sums, kind="stable")[: 64 * many].tolist():
        if all(abs(at - f) >= gap for f in found):
            found.append(at)
            if len(found) == many:
                break
    found += [(2 * k + 1) * len(sums) // (2 * even) for k in range(even)]
    return [data[f : f + PAD].tobytes() for f in found], float(sums.max())


def kernel_rows(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, bucket, value): the hashed subsequences of each span's WINDOW starting places, repeats apart."""
    data = np.frombuffer(b"".join(s[:PAD].ljust(PAD) for s in spans), np.uint8)
    row, col, val = [], [], []
    for decay, bucket, valid in subsequences(data):
        at = np.flatnonzero(valid)
        at = at[at % PAD < WINDOW]
        row.append(at // PAD)
        col.append(bucket[at])
        val.append(np.full(len(at), decay, np.float32))
    return np.concatenate(row), np.concatenate(col).astype(np.int64), np.concatenate(val)


class Machine:
    """A weight for each hashed subsequence (the landmarks' sum, folded) and the logistic scale of the best window's sum."""

    def __init__(self, weight: np.ndarray, scale: float, shift: float):
        self.weight, self.scale, self.shift = weight.astype(np.float32), scale, shift

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * best(texts, self.weight) + self.shift, -50, 50)))


def machine(spans: list[bytes], toxic: np.ndarray, seed: int = 11) -> np.ndarray:
    """Trains on windows; returns the weight of each bucket.

    Nyström: landmarks are half toxic, half clean windows; features are the kernel to them times the inverse root of their own
    kernel. A linear machine with hinge loss learns by dual coordinate ascent.
    """
    rng = np.random.default_rng(seed)
    pick = np.concatenate([rng.permutation(np.flatnonzero(toxic == side))[: LANDMARKS // 2] for side in (1, 0)])
    marks = list(dict.fromkeys(spans[i] for i in pick))
    row, col, val = kernel_rows(marks)
    used, col = np.unique(col, return_inverse=True)
    phi = np.zeros((len(used), len(marks)), np.float32)
    np.add.at(phi, (col, row), val)
    own, vectors = np.linalg.eigh((phi.T @ phi).astype(np.float64))
    good = own > 1e-6 * max(own.max(initial=0), 1e-12)
    root = vectors[:, good] / np.sqrt(own[good])
    z = np.ones((len(spans), root.shape[1] + 1), np.float32)  # the last is the bias
    for k in range(0, len(spans), 256):  # blocks of windows bound the memory
        row, col, val = kernel_rows(spans[k : k + 256])
        place = np.minimum(np.searchsorted(used, col), len(used) - 1)
        hit = used[place] == col
        part = np.zeros((len(spans[k : k + 256]), len(used)), np.float32)
        np.add.at(part, (row[hit], place[hit]), val[hit])
        z[k : k + 256, :-1] = part @ phi @ root
    size = float(np.sqrt(np.mean(np.square(z[:, :-1]).sum(1, dtype=np.float64)))) or 1.0
    z[:, :-1] /= size
    y, square = np.where(toxic == 1, 1.0, -1.0), np.square(z).sum(1, dtype=np.float64)
    alpha, v = np.zeros(len(y)), np.zeros(z.shape[1])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)).tolist():
            to = min(max(alpha[i] - (y[i] * (z[i] @ v) - 1) / square[i], 0.0), COST)
            if to != alpha[i]:
                v += (to - alpha[i]) * y[i] * z[i]
                alpha[i] = to
    weight = np.zeros(BUCKETS)
    weight[used] = phi @ (root @ v[:-1] / size)
    return weight


def calibrated(weight: np.ndarray, sums: np.ndarray, toxic: np.ndarray) -> Machine:
    """The logistic scale: 0.5 midway between clean documents' best windows (their largest, but for one in 500) and toxic ones' (their smallest, but for one in 50)."""
    high, low = np.quantile(sums[toxic == 0], 0.998), np.quantile(sums[toxic == 1], 0.02)
    if low <= high:  # the two overlap: where most are right
        edges = np.unique(sums)
        right = [((sums >= e) == (toxic == 1)).mean() for e in edges]
        cut = float(edges[int(np.argmax(right))])
        width = float(np.std(sums)) / 4 or 1.0
    else:
        cut, width = float(low + high) / 2, float(low - high) / 8
    return Machine(weight, 1 / width, -cut / width)


def _odds(train: DataFrame) -> np.ndarray:
    """A first weight for each bucket: the log odds of documents that hold a subsequence, toxic against clean, less twice their standard error; under 0 is 0.

    Counted in the tasks, summed by Spark; BUCKETS rows at most reach the driver.
    """

    def run(batches):
        for batch in batches:
            held = np.zeros((2, BUCKETS), np.int64)
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                data, _ = stream([text.as_py() or b""])
                seen = np.zeros(BUCKETS, bool)
                for _, bucket, valid in subsequences(data):
                    seen[bucket[valid]] = True
                held[label] += seen
            at = np.flatnonzero(held.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0][at]), pa.array(held[1][at])], names=["b", "clean", "toxic"])

    rows = train.select("text", "label").mapInArrow(run, "b bigint, clean bigint, toxic bigint").groupBy("b").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    sides = train.groupBy("label").count().collect()
    many = {r["label"]: r["count"] for r in sides}
    out = np.zeros(BUCKETS)
    clean, toxic = (rows[c].to_numpy() + 0.5 for c in ("clean", "toxic"))
    out[rows["b"].to_numpy()] = np.maximum(0, np.log(toxic / (many[1] + 1) / clean * (many[0] + 1)) - 2 * np.sqrt(1 / toxic + 1 / clean))
    return out


def _spans(train: DataFrame, weight: np.ndarray) -> pa.Table:
    """label, sum and the windows of each document that teaches; a row of some hundred bytes for each."""
    sent = train.sparkSession.sparkContext.broadcast(weight.astype(np.float32))

    def run(batches):
        for batch in batches:
            label = batch.column("label").to_pylist()
            found = [picked(t.as_py() or b"", sent.value, WITNESSES, 0 if y else EVEN) for t, y in zip(batch.column("text"), label, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(label, pa.int32()), pa.array([s for _, s in found], pa.float64()), pa.array([w for w, _ in found], pa.list_(pa.binary()))], names=["doc_id", "label", "sum", "spans"])

    kind = train.schema["doc_id"].dataType.simpleString()
    return train.mapInArrow(run, f"doc_id {kind}, label int, sum double, spans array<binary>").toArrow().sort_by("doc_id")


def taught(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, label, text: at most max_rows labelled documents of each label that are not held out, whole."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    side = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    some = side(0).unionByName(side(1))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 * max_rows ids are broadcast


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """Learns from at most max_rows documents of each label that are not held out."""
    spark = docs.sparkSession
    bound_batches(spark)
    train = materialized(taught(docs, labels, label, max_rows).repartition(max(8, spark.sparkContext.defaultParallelism)), "taught")
    kinds = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return Machine(np.zeros(BUCKETS), 0.0, 0.0 if not kinds else -50.0 if 0 in kinds else 50.0) if kinds else Machine(np.zeros(BUCKETS), 0.0, -50.0)
    weight, lesson = _odds(train), Lesson()
    for _ in range(ROUNDS):
        rows = _spans(train, weight)
        label_of, sums = rows["label"].to_numpy(), rows["sum"].to_numpy()
        apart = _apart(label_of)
        taught_by = np.flatnonzero(~apart)
        lesson.add(label_of[taught_by], sums[taught_by], rows["spans"].take(taught_by).to_pylist(), weight)
        weight = machine(*lesson.all())
    rows = _spans(train, weight)
    label_of, sums = rows["label"].to_numpy(), rows["sum"].to_numpy()
    known = apart if apart.any() else np.ones(len(sums), bool)
    return calibrated(weight, sums[known], label_of[known])


def _apart(label: np.ndarray) -> np.ndarray:
    """Documents (every third) whose windows do not teach, so that their sums tell where to cut; none where a label has fewer than FEW."""
    few = min((label == 0).sum(), (label == 1).sum()) < FEW
    return np.arange(len(label)) % 3 == 1 if not few else np.zeros(len(label), bool)


class Lesson:
    """The windows that teach, each once: witnesses as the first round finds them, clean ones of all rounds."""

    def __init__(self):
        self.toxic: list[bytes] = []
        self.clean: dict[bytes, None] = {}

    def add(self, label: np.ndarray, sums: np.ndarray, lists: list[list[bytes]], weight: np.ndarray) -> None:
        own = _sums(lists, weight)
        floor = np.quantile(sums[label == 0], 0.99)
        clean = [(-v, s) for y, some, values in zip(label.tolist(), lists, own, strict=True) if not y for s, v in zip(some, values.tolist(), strict=True)]
        if not self.toxic:
            bad = dict.fromkeys(s for y, some, values in zip(label.tolist(), lists, own, strict=True) if y for k, (s, v) in enumerate(zip(some, values.tolist(), strict=True)) if k == 0 or v > floor)
            self.toxic = list(bad)[:: -(-len(bad) // MOST_TOXIC) or 1]
            self.clean = dict.fromkeys(s for y, some in zip(label.tolist(), lists, strict=True) if not y for s in some[-EVEN:])
        self.clean |= dict.fromkeys(s for _, s in sorted(clean)[:HARDEST])

    def all(self) -> tuple[list[bytes], np.ndarray]:
        rng = np.random.default_rng(3)
        clean = list(self.clean)
        letters = [c for c in b"".join(clean) if 97 <= c <= 122] or [120]
        put = [s[:at] + bytes([letters[c]]) + s[at:-1] for s in self.toxic for at, c in zip(rng.integers(1, max(2, WINDOW), 2), rng.integers(0, len(letters), 2), strict=True)]
        return self.toxic + put + clean, np.repeat([1, 0], [len(self.toxic) + len(put), len(clean)])


def _sums(lists: list[list[bytes]], weight: np.ndarray) -> list[np.ndarray]:
    row, col, val = kernel_rows([s for some in lists for s in some])
    flat = np.bincount(row, val * weight[col], sum(map(len, lists)))
    return np.split(flat, np.cumsum([len(x) for x in lists])[:-1])


def score(docs: DataFrame, model: Machine, keep: list[str] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """`keep`, then `name`: the score (0 to 1). The model is BUCKETS numbers (1 MB), whatever the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(sent.value.score([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]), pa.float64())]

        return work

    return map_rows(docs, make, f"{name} double", list(keep))
