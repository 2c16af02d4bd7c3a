"""Substring dedup by content-defined chunks.

A gear hash rolls over the last 32 bytes; a chunk ends where its highest bits are zero, so
borders depend on content alone and come back soon behind any insertion. Chunks are told
apart by a 128-bit digest. Every chunk, however short, is looked up; it is a copy if a
document with a smaller doc_id holds it. In a document, copies that touch form a run; runs
of MIN_RUN bytes or more are removed, so every removed byte lies in a chunk that was found.

Documents are dealt into groups of bounded size. A group names each of its different
chunks once, with the smallest doc_id; digests meet in buckets, and a bucket tells a group
only the owners that are smaller than the group's own. So a chunk that stands everywhere
crosses the network once for each group.

Null texts are empty. Rows of one doc_id do not cut each other; a null doc_id counts as
2^63 - 1, and such rows do not cut each other. Repeated rows get the same result each.
Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_dedup import _by_bucket, _docs, dealt_groups

WINDOW = 32
#: Highest bits that are zero at a border: chunks of 32 bytes on average.
BITS = 5
#: Every chunk is looked up.
MIN_CHUNK = 1
MIN_RUN = 48
#: Documents and text bytes in a group, text bytes behind a bucket of digests, and in one task.
GROUP_DOCS, GROUP_BYTES, BUCKET_BYTES, TASK_BYTES = 4096, 4_000_000, 32_000_000, 32_000_000
#: A number for each byte, from the SHA-256 of the byte.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def borders(text: np.ndarray) -> np.ndarray:
    """Where chunks end (exclusive), as far as the bytes before decide; the text's end is not among them."""
    h = GEAR[text]
    width = 1
    while width < WINDOW:  # h[i] covers bytes i - width + 1 .. i, later bytes shifted less
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def chunks(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """(start, end) of every chunk of each text. Texts are hashed in blocks, each behind zero bytes, so none sees another."""
    out: list[list[tuple[int, int]]] = []
    a, gap = 0, b"\0" * WINDOW
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < 1 << 20):
            size += len(texts[b]) + WINDOW
            b += 1
        at = np.cumsum([WINDOW + len(t) for t in texts[a:b]])
        found = borders(np.frombuffer(b"".join(gap + t for t in texts[a:b]), np.uint8))
        place = np.searchsorted(found, np.concatenate([[0], at]), side="right")
        for k, t in enumerate(texts[a:b]):
            start = int(at[k]) - len(t)
            ends = [e for e in (found[place[k] : place[k + 1]] - start).tolist() if 0 < e < len(t)]
            out.append(list(zip([0, *ends], [*ends, len(t)], strict=True)) if t else [])
        a = b
    return out


def runs(found: list[tuple[int, int]], min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Runs of touching copies from sorted (start, end)."""
    out: list[list[int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= min_run]


def _entries(texts: list[bytes], ids: list[int]):
    """Each text's chunks; each chunk's entry, text by text; of each entry (a different chunk) its digest as two numbers and its smallest id."""
    cut = chunks(texts)
    number: dict[bytes, int] = {}
    entry, least = [], []
    digest = xxhash.xxh3_128_digest
    for t, i, spans in zip(texts, ids, cut, strict=True):  # documents come by id, so the first has the smallest
        for x, y in spans:
            e = number.setdefault(digest(t[x:y]), len(least))
            if e == len(least):
                least.append(i)
            entry.append(e)
    return cut, entry, np.frombuffer(b"".join(number), "<u8").reshape(-1, 2), np.array(least, np.int64)


def _listed(buckets: int):
    """In the groups: a row for each bucket, entries in an order that _cut() repeats."""

    def run(t: pa.Table) -> pa.Table:
        ids, texts, _ = _docs(t)
        _, _, digest, least = _entries(texts, ids)
        order, _, parts = _by_bucket(digest[:, 0], buckets)
        g = t["g"][0].as_py()
        return pa.table({
            "b": pa.array([b for b, _, _ in parts], pa.int64()), "g": pa.array([g] * len(parts), pa.int64()),
            "digests": pa.array([digest[order[x:y]].tobytes() for _, x, y in parts], pa.binary()), "least": pa.array([least[order[x:y]].tobytes() for _, x, y in parts], pa.binary()),
        })

    return run


_OWNER = np.dtype([("entry", "<i4"), ("owner", "<i8")])


def _owners(t: pa.Table) -> pa.Table:
    """In a bucket: for each group the entries that another group holds under a smaller id."""
    digest = np.frombuffer(b"".join(t["digests"].to_pylist()), "<u8").reshape(-1, 2)
    least = [np.frombuffer(x, np.int64) for x in t["least"].to_pylist()]
    size = [len(x) for x in least]
    least = np.concatenate(least)
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    sorted_ = digest[order]
    new = np.append(True, (sorted_[1:] != sorted_[:-1]).any(axis=1))
    owner = np.empty_like(least)
    owner[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    g, payload, at = [], [], 0
    for group, n in zip(t["g"].to_pylist(), size, strict=True):
        some = np.flatnonzero(owner[at : at + n] < least[at : at + n])
        if len(some):
            told = np.empty(len(some), _OWNER)
            told["entry"], told["owner"] = some, owner[at + some]
            g.append(group)
            payload.append(told.tobytes())
        at += n
    return pa.table({"g": pa.array(g, pa.int64()), "b": pa.array([t["b"][0].as_py()] * len(g), pa.int64()), "payload": pa.array(payload, pa.binary())})


def _cut(buckets: int):
    """In the groups: the bytes that stay."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts, docs = _docs(docs)
        cut, entry, digest, owner = _entries(texts, ids)
        order, _, parts = _by_bucket(digest[:, 0], buckets)
        place = {b: order[x:y] for b, x, y in parts}
        for b, payload in zip(told["b"].to_pylist(), told["payload"].to_pylist(), strict=True):
            more = np.frombuffer(payload, _OWNER)
            owner[place[b][more["entry"]]] = more["owner"]
        first = owner[np.array(entry, np.int64)].tolist()
        removed, spans, owners, kept, k = [], [], [], [], 0
        for t, i, each in zip(texts, ids, cut, strict=True):
            found = [(x, y, o) for (x, y), o in zip(each, first[k : k + len(each)], strict=True) if o < i]
            k += len(each)
            gone = runs([(x, y) for x, y, _ in found])
            parts, at = [], 0
            for x, y in gone:
                parts.append(t[at:x])
                at = y
            removed.append(sum(y - x for x, y in gone))
            spans.append(len(gone))
            owners.append(sorted({o for x, y, o in found if any(a <= x and y <= b for a, b in gone)}) if gone else [])
            kept.append(b"".join([*parts, t[at:]]))
        return pa.table({
            "doc_id": docs["doc_id"], "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
            "owners": pa.array(owners, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary()),
        })

    return run


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, owners (doc_ids that hold removed chunks first), kept (binary)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    dealt, size, tasks = dealt_groups(rows, GROUP_DOCS, GROUP_BYTES, TASK_BYTES)
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    listed = dealt.groupBy("g").applyInArrow(_listed(buckets), "b long, g long, digests binary, least binary")
    told = listed.repartition(tasks, "b").groupBy("b").applyInArrow(_owners, "g long, b long, payload binary")
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_cut(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, owners array<bigint>, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, owners, kept_sha256."""
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "owners", F.sha2("kept", 256).alias("kept_sha256"))
