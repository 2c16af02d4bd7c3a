"""Removal of byte strings of 50 bytes or more that an earlier document holds.

Every 50-byte string has an anchor: the smallest hash among its 20-byte grams. A run of
window starts with one anchor is a piece of text; equal 50-byte strings have the same
anchor wherever they stand, so they meet in the shard that the anchor names.

1. Documents are dealt into groups of a few MB; each group lists its anchors once, with
   the number of pieces that each has there.
2. Anchors that two documents share are found in buckets and told to the groups. One with
   HOT_PIECES pieces or more (a passage that many documents quote, each with other text
   around it) is told as hot: its pieces are sent window by window, each to the shard that
   the hash of its own 50 bytes names, so that no anchor gathers in one shard.
3. Groups send the pieces of shared anchors (equal pieces once, with their smallest
   doc_id) to the shards. A shard builds suffix arrays (Larsson-Sadakane) and common
   prefixes (Kasai) over blocks of its distinct pieces; neighbours that share 50 bytes form
   classes whose owner is the smallest doc_id. The blocks' sorted classes are merged by
   binary search.
4. Owners smaller than a group's own go back; each document is cut where a class's owner
   is smaller than its doc_id.

A string in a third of all documents crosses the network once for each group. What
is equal is decided by bytes alone; hashes only bring candidates together.

Null texts are empty. Rows of one doc_id never cut each other. A null doc_id counts as
larger than all others, so such a row is cut by others and cuts none. Repeated rows get
the same result each. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixes import common_prefixes, suffix_array

LENGTH = 50
GRAM = 20
#: Documents and text bytes in a group, text bytes behind a bucket, text bytes in one suffix array, and in one task.
GROUP_DOCS, GROUP_BYTES, BUCKET_BYTES, BLOCK, TASK_BYTES = 4096, 4_000_000, 6_000_000, 1_500_000, 32_000_000
#: Pieces of one anchor from which they are sent window by window; results do not depend on it.
HOT_PIECES = 4096
#: Text bytes hashed at a time.
SLICE = 1 << 19
LAST = np.iinfo(np.int64).max
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each 20-byte gram, by doubling."""
    size = {1: text.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        h = size[k]
        size[2 * k] = h[:-k] * _power(k) + h[k:]
    h = size[16][:-4] * _power(4) + size[4][16:]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def pieces(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first start, last start, document of every run of 50-byte windows; document i is text[offsets[i]:offsets[i + 1]].

    Text is hashed in slices; a run that lies in two of them is two runs.
    """
    inside = np.ones(len(text), bool)  # windows that lie in one document
    for e in offsets[1:].tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    found = [_pieces(text[a : a + SLICE + LENGTH - 1], inside[a : a + SLICE], a) for a in range(0, len(text) - LENGTH + 1, SLICE)]
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    anchor, first, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    return anchor, first, stop, np.searchsorted(offsets, first, side="right") - 1


def _pieces(text: np.ndarray, valid: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    least = gram_hashes(text)
    window, width = LENGTH - GRAM + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        rest = window - width
        least = np.minimum(least[:-rest], least[rest:])
    valid = valid[: len(least)]
    border = np.append(True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]))
    first = np.flatnonzero(border & valid)
    stop = np.flatnonzero(np.append(border[1:], True) & valid)
    return least[first], first + at, stop + at


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _docs(t: pa.Table) -> tuple[list[int], list[bytes], pa.Table]:
    """Ids (null: last), texts, and the table, in an order that every pass repeats."""
    t = t.sort_by([("doc_id", "ascending"), ("key", "ascending")])
    return [LAST if x is None else x for x in t["doc_id"].to_pylist()], [x or b"" for x in t["text"].to_pylist()], t


def _codes(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket in the highest 24 bits, then its own highest 40.

    A bucket has some 400,000 anchors at any input size, so equal codes nearly always mean equal anchors; if not, a piece is looked at in vain.
    """
    return anchor >> np.uint64(24) | anchor % np.uint64(buckets) << np.uint64(40)


def _packed(code: np.ndarray) -> bytes:
    """The codes without their bucket, 5 bytes each."""
    return np.ascontiguousarray(code).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(packed: bytes, bucket: int) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel() | np.uint64(bucket << 40)


def _parts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run in sorted buckets."""
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]).tolist()
    return [(int(bucket[a]), a, b) for a, b in zip(edge, [*edge[1:], len(bucket)], strict=False)]


def _by_bucket(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of each in it."""
    bucket = (anchor % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket, _parts(bucket[order])


def _anchors(buckets: int):
    """Step 1. The anchors of a group's documents, each once; its mark is twice its number of pieces (127 at most) and one more if two doc_ids of the group share it."""

    def run(t: pa.Table) -> pa.Table:
        ids, texts, _ = _docs(t)
        anchor, _, _, doc = pieces(*_joined(texts))
        code = _codes(anchor, buckets)
        owner = np.array(ids, np.int64)[doc]
        order = np.argsort(code)
        code, owner = code[order], owner[order]
        at = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        mark = np.zeros(0, np.uint8)
        if len(at):
            mark = (2 * np.minimum(np.diff(np.append(at, len(code))), 127) + (np.maximum.reduceat(owner, at) != np.minimum.reduceat(owner, at))).astype(np.uint8)
        code, g = code[at], t["g"][0].as_py()
        parts = _parts((code >> np.uint64(40)).astype(np.int64))
        return pa.table({
            "b": pa.array([b for b, _, _ in parts], pa.int64()), "g": pa.array([g] * len(parts), pa.int64()),
            "anchors": pa.array([_packed(code[x:y]) for _, x, y in parts], pa.binary()), "marks": pa.array([mark[x:y].tobytes() for _, x, y in parts], pa.binary()),
        })

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Step 2. Of one bucket: the anchors that two documents have, for each group that has them, and which of them are hot."""
    b = t["b"][0].as_py()
    each = [_unpacked(x, b) for x in t["anchors"].to_pylist()]
    group = np.repeat(np.array(t["g"].to_pylist(), np.int64), [len(x) for x in each])
    code = np.concatenate(each)
    mark = np.concatenate([np.frombuffer(x, np.uint8) for x in t["marks"].to_pylist()])
    order = np.argsort(code)
    code, group, mark = code[order], group[order], mark[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    size = np.diff(np.append(at, len(code)))
    shared = np.repeat((size > 1) | (np.bitwise_or.reduceat(mark & 1, at) > 0), size)
    hot = np.repeat(np.add.reduceat((mark >> 1).astype(np.int64), at) >= HOT_PIECES, size)
    code, group, hot = code[shared], group[shared], hot[shared]
    order = np.argsort(group, kind="stable")  # codes stay in order
    parts = _parts(group[order])
    return pa.table({
        "g": pa.array([g for g, _, _ in parts], pa.int64()), "b": pa.array([b] * len(parts), pa.int64()), "cuts": pa.array([False] * len(parts), pa.bool_()),
        "payload": pa.array([_packed(code[order[x:y]]) for _, x, y in parts], pa.binary()),
        "hot": pa.array([hot[order[x:y]].tobytes() if hot[order[x:y]].any() else b"" for _, x, y in parts], pa.binary()),
    }, schema=_REPLY)


_REPLY = pa.schema([("g", pa.int64()), ("b", pa.int64()), ("cuts", pa.bool_()), ("payload", pa.binary()), ("hot", pa.binary())])
_CUT = np.dtype([("entry", "<i4"), ("first", "<i4"), ("last", "<i4"), ("owner", "<i8")])


def _entries(text: np.ndarray, offsets: np.ndarray, ids: np.ndarray, told: pa.Table, buckets: int):
    """The pieces of shared anchors: of each run its first and last start, document and entry; of each entry its bytes, anchor and smallest id."""
    known, hot = [], []
    for payload, b, cuts, h in zip(told["payload"].to_pylist(), told["b"].to_pylist(), told["cuts"].to_pylist(), told["hot"].to_pylist(), strict=True):
        if not cuts:
            known.append(_unpacked(payload, b))
            hot.append(np.frombuffer(h, bool) if h else np.zeros(len(known[-1]), bool))
    if not known:
        return None
    known, hot = np.concatenate(known), np.concatenate(hot)
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    anchor, first, stop, doc = pieces(text, offsets)
    code = _codes(anchor, buckets)
    place = np.minimum(np.searchsorted(known, code), len(known) - 1)
    some = known[place] == code
    anchor, first, stop, doc, hot = anchor[some], first[some], stop[some], doc[some], hot[place[some]]
    raw = text.tobytes()
    if hot.any():  # a run for each window, named by its own 50 bytes
        many = stop[hot] - first[hot] + 1
        start = np.repeat(first[hot] - np.cumsum(many) + many, many) + np.arange(many.sum())
        own = np.array([xxhash.xxh3_64_intdigest(raw[x : x + LENGTH]) for x in start.tolist()], np.uint64)
        cold = ~hot
        anchor, first, stop = np.concatenate([anchor[cold], own]), np.concatenate([first[cold], start]), np.concatenate([stop[cold], start])
        doc = np.concatenate([doc[cold], np.repeat(doc[hot], many)])
        order = np.argsort(first)
        anchor, first, stop, doc = anchor[order], first[order], stop[order], doc[order]
    number: dict[bytes, int] = {}
    entry = np.array([number.setdefault(raw[x:y], len(number)) for x, y in zip(first.tolist(), (stop + LENGTH).tolist(), strict=True)], np.int64)
    seen, least = np.unique(entry, return_index=True)  # documents come by id, so an entry's first run has the smallest
    return first, stop, doc, entry, list(number), anchor[least], ids[doc[least]]


def _send(buckets: int):
    """Step 3, in the groups: rows for the shards, entries in an order that step 4 repeats."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        made = None
        if docs.num_rows and told.num_rows:
            ids, texts, _ = _docs(docs)
            made = _entries(*_joined(texts), np.array(ids, np.int64), told, buckets)
        rows = {"b": [], "g": [], "ids": [], "sizes": [], "bytes": []}
        if made:
            *_, content, anchor, least = made
            order, _, parts = _by_bucket(anchor, buckets)
            content = [content[i] for i in order.tolist()]
            size, least = np.fromiter(map(len, content), "<i4", len(content)), least[order]
            for b, x, y in parts:
                rows["b"].append(b)
                rows["g"].append(docs["g"][0].as_py())
                rows["ids"].append(least[x:y].tobytes())
                rows["sizes"].append(size[x:y].tobytes())
                rows["bytes"].append(b"".join(content[x:y]))
        return pa.table({k: pa.array(v, pa.int64() if k in "bg" else pa.binary()) for k, v in rows.items()})

    return run


def classes(content: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: for each byte of the joined strings its class (-1: no whole window starts there); for each class its owner and a place.

    Classes come in the order of their strings.
    """
    text, offsets = _joined(content)
    size = np.diff(offsets)
    end = np.repeat(offsets[1:], size)
    owner = np.repeat(ids, size)
    sa = suffix_array(text, end)
    joined = common_prefixes(text, end, sa) >= LENGTH
    whole = (end - np.arange(len(text)))[sa] >= LENGTH
    sa, joined = sa[whole], joined[whole]
    joined[:1] = False
    number = np.cumsum(~joined) - 1
    of = np.full(len(text), -1, np.int64)
    of[sa] = number
    at = np.flatnonzero(~joined)
    return of, np.minimum.reduceat(owner[sa], at) if len(at) else owner[:0], sa[at] if len(at) else sa


def _strings(content: list[bytes], place: np.ndarray) -> np.ndarray:
    """The 50-byte strings at these places; a closing byte keeps zero bytes at an end."""
    text = np.append(_joined(content)[0], np.uint8(1))
    out = np.ones((len(place), LENGTH + 1), np.uint8)
    for k in range(LENGTH):
        out[:, k] = text[place + k]
    return np.ascontiguousarray(out).view(f"S{LENGTH + 1}").ravel()


def _owned(content: list[bytes], ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that holds the 50 bytes from each window start of each string, and where each string's windows begin."""
    size = np.array([len(c) for c in content], np.int64)
    cut = np.cumsum(size) // block
    done = []
    for c in np.unique(cut):
        a, b = np.searchsorted(cut, [c, c + 1])
        done.append((a, b, *classes(content[a:b], ids[a:b])))
    if len(done) > 1:  # merge the blocks' sorted classes by binary search
        runs = [_strings(content[a:b], place) for a, b, _, _, place in done]
        merged, least = runs[0], done[0][3]
        for run, (_, _, _, own, _) in zip(runs[1:], done[1:], strict=True):
            at = np.searchsorted(merged, run)
            found = merged[np.minimum(at, len(merged) - 1)] == run if len(merged) else np.zeros(len(run), bool)
            least[at[found]] = np.minimum(least[at[found]], own[found])
            merged, least = np.insert(merged, at[~found], run[~found]), np.insert(least, at[~found], own[~found])
        done = [(a, b, of, least[np.searchsorted(merged, run)], place) for run, (a, b, of, _, place) in zip(runs, done, strict=True)]
    found = [own[of[of >= 0]] if len(own) else own for _, _, of, own, _ in done]  # every whole window has a class
    return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([[0], np.cumsum(np.maximum(size - LENGTH + 1, 0))]).astype(np.int64)


def owners(content: list[bytes], ids: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """For each string, the smallest id that holds the 50 bytes from each of its window starts."""
    own, at = _owned(content, ids, block)
    return [own[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] numbers) for each i."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _shard(t: pa.Table) -> pa.Table:
    """Step 3, in a shard: for each group the window starts whose owner is smaller than the entry's own id."""
    t = t.sort_by("g")
    b = t["b"][0].as_py()
    number: dict[bytes, int] = {}
    at, own, count = [], [], []
    for ids, sizes, raw in zip(*(t[c].to_pylist() for c in ("ids", "sizes", "bytes")), strict=True):
        stop = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
        at += [number.setdefault(raw[x:y], len(number)) for x, y in zip([0, *stop], stop, strict=False)]
        own.append(np.frombuffer(ids, np.int64))
        count.append(len(stop))
    at, own = np.array(at, np.int64), np.concatenate(own)
    least = np.full(len(number), LAST)
    np.minimum.at(least, at, own)
    content = list(number)
    del number
    found, window = _owned(content, least)
    # runs of windows with one owner; of each place of an entry, those whose owner is smaller
    edge = np.append(True, found[1:] != found[:-1])[: len(found)]
    edge[window[:-1][window[:-1] < len(found)]] = True
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(found)) - 1
    run = np.searchsorted(first, window)
    many = (run[1:] - run[:-1])[at]
    which, place = _spread(run[at], many), np.repeat(np.arange(len(at)), many)
    less = found[first[which]] < own[place]
    which, place = which[less], place[less]
    row = np.concatenate([[0], np.cumsum(count)])
    of = np.searchsorted(row, place, side="right") - 1
    cuts = np.empty(len(which), _CUT)
    cuts["entry"], cuts["owner"] = place - row[of], found[first[which]]
    cuts["first"], cuts["last"] = first[which] - window[at[place]], last[which] - window[at[place]]
    groups = t["g"].to_pylist()
    parts = _parts(of)
    return pa.table({
        "g": pa.array([groups[k] for k, _, _ in parts], pa.int64()), "b": pa.array([b] * len(parts), pa.int64()), "cuts": pa.array([True] * len(parts), pa.bool_()),
        "payload": pa.array([cuts[x:y].tobytes() for _, x, y in parts], pa.binary()), "hot": pa.array([b""] * len(parts), pa.binary()),
    }, schema=_REPLY)


def _cut(buckets: int):
    """Step 4: the bytes that stay."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts, docs = _docs(docs)
        ids = np.array(ids, np.int64)
        text, offsets = _joined(texts)
        step = np.zeros(len(text) + 1, np.int32)
        made = _entries(text, offsets, ids, told, buckets) if told.num_rows else None
        if made:
            first, stop, doc, entry, content, anchor, least = made
            order, _, parts = _by_bucket(anchor, buckets)
            place = {b: order[x:y] for b, x, y in parts}
            cuts, of = [np.zeros(0, _CUT)], [np.zeros(0, np.int64)]
            for b, is_cut, payload in zip(told["b"].to_pylist(), told["cuts"].to_pylist(), told["payload"].to_pylist(), strict=True):
                if is_cut:
                    cuts.append(np.frombuffer(payload, _CUT))
                    of.append(place[b][cuts[-1]["entry"]])
            cuts, of = np.concatenate(cuts), np.concatenate(of)
            order = np.argsort(of)
            cuts, at = cuts[order], np.searchsorted(of[order], np.arange(len(content) + 1))
            whole = least[entry] < ids[doc]  # the group itself holds the piece under a smaller id
            np.add.at(step, first[whole], 1)
            np.add.at(step, stop[whole] + LENGTH, -1)
            rest = ~whole
            many = (at[1:] - at[:-1])[entry[rest]]
            some = cuts[_spread(at[:-1][entry[rest]], many)]
            start = np.repeat(first[rest], many)
            less = some["owner"] < np.repeat(ids[doc[rest]], many)
            np.add.at(step, (start + some["first"])[less], 1)
            np.add.at(step, (start + some["last"] + LENGTH)[less], -1)
        gone = np.cumsum(step[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][offsets[:-1] < len(text)]] = gone[offsets[:-1][offsets[:-1] < len(text)]]
        so_far = lambda flags: np.concatenate([[0], np.cumsum(flags)])[offsets]
        removed = np.diff(so_far(gone))
        at = offsets - so_far(gone)
        left = text[~gone].tobytes()
        return pa.table({
            "doc_id": docs["doc_id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(np.diff(so_far(begins)), pa.int64()),
            "kept": pa.array([left[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
        })

    return run


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the remaining bytes)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    dealt, size, tasks = dealt_groups(rows, GROUP_DOCS, GROUP_BYTES, TASK_BYTES)
    buckets = min(1 << 24, max(1, math.ceil(size / BUCKET_BYTES)))
    reply = "g long, b long, cuts boolean, payload binary, hot binary"
    anchors = dealt.groupBy("g").applyInArrow(_anchors(buckets), "b long, g long, anchors binary, marks binary")
    shared = anchors.repartition(tasks, "b").groupBy("b").applyInArrow(_shared, reply)
    sent = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_send(buckets), "b long, g long, ids binary, sizes binary, bytes binary")
    told = shared.unionByName(sent.repartition(tasks, "b").groupBy("b").applyInArrow(_shard, reply))
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_cut(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dealt_groups(rows: DataFrame, group_docs: int, group_bytes: int, task_bytes: int) -> tuple[DataFrame, int, int]:
    """g, doc_id, key, text of rows (doc_id, text) in groups of bounded rows and bytes, all of a group in one task; the bytes of all texts, and the number of tasks, which grows with them.

    A row is dealt by its id and text, so copies spread. This is the one shuffle of texts; all steps read it.
    """
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, math.ceil(size["n"] / group_docs), math.ceil(size["bytes"] / group_bytes))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["bytes"] / task_bytes))
    keyed = rows.withColumn("key", F.xxhash64("text")).select(F.pmod(F.xxhash64("doc_id", "key"), F.lit(groups)).alias("g"), "doc_id", "key", "text")
    return keyed.repartition(tasks, "g"), size["bytes"], tasks


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
