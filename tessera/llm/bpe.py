"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern; each piece is encoded on its own. Bytes are
mapped to Latin-1 so that an Aho-Corasick automaton finds the longest token at every
offset in one pass. Encoding walks the piece from longest matches, steps to a shorter
token (or back) when two neighbours could not stand side by side after the merges, and
remembers which neighbours can; each offset fails at most once, so work is linear.
The ids equal those of applying the merges in rank order.

Null texts are empty: no ids, decoded to the empty byte string. Repeated rows, ties and
extra columns do not matter, as each row is encoded alone; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, strings

#: Pieces whose ids a worker remembers; beyond it the memory is emptied, never the result.
CACHE = 1 << 17


class Pieces(dict):
    """A piece's ids as little-endian bytes. Two generations bound it; what is used again moves to the new one."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = array("I", self.vocabulary.encode_piece(piece.encode())).tobytes()
            if sys.byteorder != "little":
                packed = np.frombuffer(packed, "u4").astype("<u4").tobytes()
        if len(piece) < 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Vocabulary:
    """Ranks of byte strings, the pair that made each token, and the neighbour test."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pieces = Pieces(self)
        self.size = [0] * (max(ranks.values(), default=0) + 1)
        self.shorter = [-1] * len(self.size)
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            elif len(parts := self._merge_below(token, rank)) == 2:
                self.pair[parts[0], parts[1]] = rank
                self.halves[rank] = (parts[0], parts[1])
            else:  # no sequence of merges makes it; it can only be a piece of its own
                continue
            self.size[rank] = len(token)
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        for rank in self.halves:
            token = self.bytes_of[rank]
            self.shorter[rank] = next((s for n in range(len(token) - 1, 0, -1) if (s := ranks.get(token[:n], -1)) in self.halves), -1)
        self.automaton.make_automaton()

    def _merge_below(self, token: bytes, rank: int) -> list[int]:
        """The token's bytes after all merges of a lower rank."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts] if all(p in self.ranks for p in parts) else []

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side; remembered."""
        if len(self.fits) >= CACHE * 2:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undoes both tokens' merges from the latest: none may cross the border earlier."""
        bound = 1 << 62
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < bound:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    inner = self.halves[left][1]
                    if inner != left:
                        bound, left = left, inner
                        break
                else:
                    inner = self.halves[right][0]
                    if inner != right:
                        bound, right = right + 1, inner
                        break
                bound = right + 1 if undo_left else left
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, fits = len(piece), self.size, self.shorter, self.fits
        longest = [self.single[b] for b in piece]
        for end, (before, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = token  # ends come in order, so the longest stays
        longest.append(-1)
        open_ = bytearray(b"\1") * (n + 1)  # offsets from which the rest may still be encoded
        ids: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + size[token]
                if open_[end]:
                    fit = True if last < 0 else fits.get(last << 32 | token)
                    if fit is None:
                        fit = self.compatible(last, token)
                    if fit:
                        ids.append(token)
                        at, last, token = end, token, longest[end]
                        break
                token = shorter[token]
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte of this piece")
                open_[at] = 0
                token = ids.pop()
                at -= size[token]
                last = ids[-1] if ids else -1
        return ids


def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


@functools.lru_cache(maxsize=4)
def _vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(_ranks(content))


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoder(content: bytes, pattern: str):
    pieces, split = _vocabulary(content).pieces, regex.compile(pattern).findall
    return lambda text: b"".join(map(pieces.__getitem__, split(text)))


def _decoder(content: bytes):
    bytes_of = {r: b for b, r in _ranks(content).items()}.__getitem__
    return lambda packed: b"".join(map(bytes_of, array("I", _native(packed))))


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", keep: list[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """`keep`, then `ids` (binary: little-endian unsigned 32-bit) and n_tokens (long).

    The driver reads the vocabulary file (about 1 MB, whatever the corpus) and broadcasts it.
    """
    content = docs.sparkSession.sparkContext.broadcast(_file(vocabulary_path))

    def make():
        encoded = _encoder(content.value, pattern)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out = [encoded(t) for t in strings(batch, text)]
            return [pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())]

        return work

    return map_rows(docs.select(*dict.fromkeys([*keep, text])), make, f"{ids} binary, n_tokens bigint", list(keep))


def decode(encoded: DataFrame, vocabulary_path: str, keep: list[str] = ("doc_id",), ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`keep`, then the bytes that `ids` stand for (null ids: none)."""
    content = encoded.sparkSession.sparkContext.broadcast(_file(vocabulary_path))

    def make():
        back = _decoder(content.value)
        return lambda batch: [pa.array([back(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())]

    return map_rows(encoded, make, f"{decoded} binary", list(keep))


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", keep: list[str] = ("doc_id",), with_decoded: bool = False) -> DataFrame:
    """encode() and decode() in one pass, with half the Python workers: `keep`, n_tokens, ids, round_trip (whether decoding gives the text) and, if asked, decoded."""
    content = docs.sparkSession.sparkContext.broadcast(_file(vocabulary_path))

    def make():
        encoded, back = _encoder(content.value, pattern), _decoder(content.value)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = strings(batch, text)
            ids = [encoded(t) for t in texts]
            plain = [back(x) for x in ids]
            same = [p == t.encode() for p, t in zip(plain, texts, strict=True)]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(same, pa.bool_()), *([pa.array(plain, pa.binary())] if with_decoded else [])]

        return work

    return map_rows(docs.select(*dict.fromkeys([*keep, text])), make, "n_tokens bigint, ids binary, round_trip boolean" + ", decoded binary" * with_decoded, list(keep))


def _native(packed: bytes) -> bytes:
    return packed if sys.byteorder == "little" else np.frombuffer(packed, "<u4").astype("u4").tobytes()


def digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids."""
    both = round_trip(docs, vocabulary_path, pattern, with_decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
