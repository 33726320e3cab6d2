"""Byte-level BPE encoding and decoding by numpy matrices.

Texts are cut into words by the vocabulary's pattern, each word apart. Distinct words of similar length stand in padded
matrices, one word a row, of token ids that begin as single bytes. In each round every row looks up the ranks of its
neighbouring pairs in a hash table, merges the leftmost pair of least rank, and closes the gap; rows that have no pair
left are written out and leave the matrix. Words over LONG bytes, for which rounds would take quadratic time, make the
same merges one by one from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Memory

#: The widest matrix row; cells of one matrix.
LONG, CELLS = 256, 1 << 20
_NONE = np.int32(np.iinfo(np.int32).max)
_LOADED: dict[tuple[str, str], Vocabulary] = {}


class Vocabulary:
    """Ranks from a file with one base64 token and its rank a line, and the pattern that cuts words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.memory = Memory(self._encode_pieces, b"".join)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), 1
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        left, step = np.arange(len(keys)), 0
        while len(left):  # the first of those that want a free slot gets it, the others try the next
            slot = (self._slot(keys[left]) + step) & (size - 1)
            free = self.keys[slot] == -1
            one = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[one]
            self.keys[slot[won]], self.values[slot[won]] = keys[left[won]], values[left[won]]
            left, step = np.delete(left, won), step + 1
        self.probes = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make together, _NONE where there is none. Ids below 0 make none."""
        keys = (a.astype(np.int64) << 32 | b).ravel()
        out = np.full(len(keys), _NONE, np.int32)
        ask, at = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0)), 0
        slot = self._slot(keys[ask])
        while len(ask) and at < self.probes:
            here = self.keys[slot]
            hit = here == keys[ask]
            out[ask[hit]] = self.values[slot[hit]]
            on = ~hit & (here != -1)
            ask, slot, at = ask[on], (slot[on] + 1) & (len(self.keys) - 1), at + 1
        return out.reshape(a.shape)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = self._merge_long(w)
            elif w:
                size.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, rows in size.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                self._merge_rows(words, rows[at : at + step], width, out)
        return out

    def _merge_rows(self, words: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        flat = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(-1, width)
        size = np.array([len(words[i]) for i in rows])
        ids = np.where(np.arange(width) < size[:, None], self.first[flat], np.int32(-1))
        ranks, at = self.pair_ranks(ids[:, :-1], ids[:, 1:]), np.array(rows)
        while len(at):
            place = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[np.arange(len(at)), place]
            done = least == _NONE
            if done.any():
                full = ids[done].astype("<u4").view(np.uint8).reshape(int(done.sum()), -1)
                for i, n, raw in zip(at[done].tolist(), size[done].tolist(), full, strict=True):
                    out[i] = raw[: 4 * n].tobytes()
                ids, ranks, at, size, place, least = ids[~done], ranks[~done], at[~done], size[~done], place[~done], least[~done]
                if not len(at):
                    return
            n, w = ids.shape
            line = np.arange(n)
            ids[line, place] = least
            gap = np.ones((n, w), bool)
            gap[line, place + 1] = False
            ids = ids[gap].reshape(n, w - 1)
            ranks = ranks[gap[:, 1:]].reshape(n, w - 2)
            size -= 1
            if w == 2:
                ranks = np.full((n, 1), _NONE, np.int32)
                continue
            for side in (place - 1, place):  # only the pairs beside the merged token are new
                ok = (side >= 0) & (side < w - 2)
                ranks[line[ok], side[ok]] = self.pair_ranks(ids[line[ok], side[ok]], ids[line[ok], side[ok] + 1])

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two is gone
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([t for t in ids if t >= 0], "<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        words = [self.pattern.findall(p) for p in pieces]
        distinct = list(set().union(*words))
        coded = dict(zip(distinct, self.encode_words([w.encode() for w in distinct]), strict=True))
        return [b"".join(map(coded.__getitem__, ws)) for ws in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as in encode_words; distinct pieces of the texts are encoded once."""
        return self.memory.values(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _load(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def _map(df: DataFrame, into: str, kind: str, column: str, work) -> DataFrame:  # noqa: ANN001
    """df with the column replaced by one named into: work over lists of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(work(part[column].to_pylist()), pa.binary())], ["id", into])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, {into} {kind}")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: the whole text's ids, little-endian unsigned 32-bit, without special tokens.

    Null texts count as empty and have no ids. Null ids and repeated rows are kept. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _map(docs, "ids", "binary", "text", lambda texts: _load(path, pattern).encode(texts))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, bytes) of rows (id, ids). Bytes need not be valid UTF-8 if the ids came from elsewhere; unknown ids fail.
    Null ids columns give null."""
    return _map(encoded, "bytes", "binary", "ids", lambda many: [None if i is None else _load(path, pattern).decode(i) for i in many])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, bytes) of every row: encode, then decode of the same ids, in one pass of one worker.

    Null texts count as empty, which have no ids and no bytes. Texts of any length are encoded whole. Null ids and
    repeated rows are kept as they are. An empty table gives an empty result. Other columns are not read, whatever their
    names.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vocabulary = _load(path, pattern)
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids = vocabulary.encode(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(ids, pa.binary()), pa.array(map(vocabulary.decode, ids), pa.binary())], ["id", "ids", "bytes"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids binary, bytes binary")
