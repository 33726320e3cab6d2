"""Document fingerprints from prefix polynomial hashes.

With c the code points of a text plus one, h[i] is the sum of c[j] * BASE^j over j < i, modulo the prime MOD. The span from
a to b then has the hash (h[b] - h[a]) / BASE^a, whatever stands before it, so that spans of any texts are compared in
constant time, and the longest common extension from two places is found by binary search over span lengths. Two bases
are used where equality is concluded; equal hashes of unequal spans of n characters have a chance of (n / MOD)^2.

A fingerprint is the text's length, the hash of the whole, and the SKETCH least mixed hashes of the spans of up to SPAN
characters that end at each of its characters; all spans come from one prefix array. Two fingerprints are as alike as
the texts' sets of spans: twice the common ones over the sum of both, 1 for equal texts, estimated from the least values
of both sets together, and exact if these are all. So a text whose last third is exchanged is alike by about two thirds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MOD = (1 << 31) - 1
#: Bases of the two hashes; any numbers between 2^21 (beyond all code points) and MOD would do.
BASES = (911_382_323, 1_347_520_651)
SPAN, SKETCH = 24, 64
#: Characters whose prefix array is made at once; longer texts go block by block, blocks overlapping by a span.
BLOCK = 1 << 16
#: Documents worked out at once in a task.
SLICE = 128

_POWERS: dict[int, np.ndarray] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """Numbers under 2^62 modulo MOD, without division."""
    x = (x & MOD) + (x >> 31)
    x = (x & MOD) + (x >> 31)
    return np.where(x >= MOD, x - MOD, x)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo MOD, by doubling; the longest asked for is kept, up to a block."""
    have = _POWERS.get(base, np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, fold(have * pow(base, len(have), MOD))])
    if len(have) <= 2 * BLOCK:
        _POWERS[base] = have
    return have[:n]


def codes(text: str) -> np.ndarray:
    """Code points plus one."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


def prefixes(c: np.ndarray, base: int) -> np.ndarray:
    """h of a text's codes, one entry more than it has characters. Sums stay under 2^63 for texts of 4 billion."""
    h = np.zeros(len(c) + 1, np.int64)
    np.cumsum(fold(c * powers(base, len(c))), out=h[1:])
    return fold(h)


class Prefixed:
    """A text's prefix arrays."""

    def __init__(self, text: str):
        self.c = codes(text)
        self.h = [prefixes(self.c, b) for b in BASES]

    def __len__(self) -> int:
        return len(self.c)

    def span(self, a: int, b: int) -> tuple[int, ...]:
        """The hashes of the characters from a to b, equal for equal spans of any texts."""
        return tuple((int(h[b]) - int(h[a])) * pow(base, -a, MOD) % MOD for h, base in zip(self.h, BASES, strict=True))

    def same(self, a: int, other: Prefixed, b: int, n: int) -> bool:
        """Whether n characters from a on are those of the other from b on. False if either has fewer."""
        if a + n > len(self) or b + n > len(other):
            return False
        for h, g, base in zip(self.h, other.h, BASES, strict=True):
            x, y = int(h[a + n]) - int(h[a]), int(g[b + n]) - int(g[b])
            if a != b:  # the one that starts earlier lacks base^|a - b|
                x, y = (x * pow(base, b - a, MOD), y) if a < b else (x, y * pow(base, a - b, MOD))
            if (x - y) % MOD:
                return False
        return True

    def extension(self, other: Prefixed, a: int = 0, b: int = 0) -> int:
        """The longest n for which same(a, other, b, n), by binary search."""
        low, high = 0, min(len(self) - a, len(other) - b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(a, other, b, mid) else (low, mid - 1)
        return low

    def back(self, other: Prefixed) -> int:
        """Characters that both texts end with, likewise."""
        low, high = 0, min(len(self), len(other))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(len(self) - mid, other, len(other) - mid, mid) else (low, mid - 1)
        return low

    def whole(self) -> int:
        one, two = self.span(0, len(self))
        return one << 31 | two


def mixed(h: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Span hashes and lengths as 32-bit numbers without order."""
    x = (h + (np.asarray(n, np.int64) << 32)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(32)


def least(x: np.ndarray, k: int) -> np.ndarray:
    """The k least distinct values, in order."""
    if len(x) > 16 * k:
        some = np.unique(np.partition(x, 4 * k)[: 4 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(x)[:k]


def sketch(c: np.ndarray, h: np.ndarray | None = None, span: int = SPAN, k: int = SKETCH) -> np.ndarray:
    """The k least mixed hashes of the spans of up to `span` characters that end at each character of codes c; h is their
    prefix array of the first base, if there is one. Fewer, if there are not as many different spans."""
    base, kept = BASES[0], np.empty(0, np.uint64)
    inverse = powers(pow(base, -1, MOD), min(len(c), BLOCK + span))
    for at in range(0, len(c), BLOCK):
        begin, end = max(0, at - span + 1), min(len(c), at + BLOCK)
        p = h[: end + 1] if h is not None and begin == 0 else prefixes(c[begin:end], base)
        n = end - begin
        full = fold((p[span:] - p[: n - span + 1] + MOD) * inverse[: n - span + 1]) if n >= span else np.empty(0, np.int64)
        found = [mixed(full, span)]
        if begin == 0:  # spans that begin with the text
            m = min(span - 1, n)
            found.append(mixed(p[1 : m + 1], np.arange(1, m + 1)))
        kept = least(np.concatenate([kept, *found]), k)
    return kept


def packed(p: Prefixed) -> bytes:
    """A fingerprint: length and hash of the whole in 4 and 8 bytes, then the values in 4 each, least first."""
    return len(p).to_bytes(4) + p.whole().to_bytes(8) + sketch(p.c, p.h[0]).astype(">u4").tobytes()


def fingerprint(text: str) -> str:
    """In hexadecimal digits."""
    return packed(Prefixed(text)).hex()


def likeness(one: bytes, two: bytes, k: int = SKETCH) -> float:
    """Of two packed fingerprints, from 0 to 1; 1 if the texts are equal, 0 if one of them is empty."""
    if one[:12] == two[:12]:
        return 1.0
    a, b = (np.frombuffer(f[12:], ">u4") for f in (one, two))
    if not len(a) or not len(b):
        return 0.0
    both = np.union1d(a, b)[:k]
    common = np.isin(both, a) & np.isin(both, b)
    j = float(common.sum()) / len(both)
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """The last third, rounded down, replaced by as many of the following text's first characters, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_ROW = "fingerprint binary, edited_sha256 binary, edited_fingerprint binary, near_edited double, near_next double, common_edited long, common_next long"


def compare(text: str, mine: tuple[Prefixed, bytes], following: str, its: tuple[Prefixed, bytes]) -> tuple:
    """What _ROW names: fingerprints, likenesses, and the longest common extensions from the texts' starts."""
    new = edited(text, following)
    p, f = mine
    q = Prefixed(new)
    g = packed(q)
    return f, hashlib.sha256(new.encode()).digest(), g, likeness(f, g), likeness(f, its[1]), p.extension(q), p.extension(its[0])


def _made(text: str) -> tuple[Prefixed, bytes]:
    p = Prefixed(text)
    return p, packed(p)


def chained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next, common_edited, common_next) of
    every row: its text against itself edited with the next row's text, and against that text. The next row is that with
    the next smaller id; after the smallest comes the largest. A table of one row is its own next.

    Null texts count as empty: an empty text's fingerprint has no spans, and it is alike to empty ones only. Rows of one
    id follow each other by their text's XXH64; equal rows give equal results in whatever order. Null ids come last.
    Texts are read whole; a text's prefix arrays take 24 bytes a character, its spans are worked out block by block. An empty table gives an empty result. Other columns are not read.

    Texts are shuffled once, into ranges of ids. Each range leaves its first and last row open, a row of texts each, and
    these few are put together in a second step.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("at"))
    ordered = rows.orderBy(F.desc_nulls_last("id"), "mark", "at").select("id", "text", F.spark_partition_id().alias("part"))
    schema = f"id {kind}, n_chars long, {_ROW}, part int, place string, text string"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = None, None
        kind_of = pa.string()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                kind_of, out = s["id"].type, []
                for i, t, part in zip(s["id"].to_pylist(), s["text"].to_pylist(), s["part"].to_pylist(), strict=True):
                    made = _made(t)
                    if before is None:
                        out.append((i, len(t), *[None] * 7, part, "first", t))
                    else:
                        out.append((before[0], len(before[1]), *compare(before[1], before[2], t, made), part, None, None))
                    before = (i, t, made)
                yield _batch(out, kind_of, names)
        if before is not None:
            yield _batch([(before[0], len(before[1]), *[None] * 7, part, "last", before[1])], kind_of, names)

    done = stored(ordered.mapInArrow(run, schema), "fingerprints")
    ends = done.where("place is not null")
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # two rows a range
    numbers = ends.where("place = 'first'").select("part", F.row_number().over(order).alias("no"))
    n = F.broadcast(numbers.agg(F.count(F.lit(1)).alias("ranges")))
    follows = ends.where("place = 'first'").join(numbers, "part").select("no", F.col("text").alias("following"))
    last = ends.where("place = 'last'").join(numbers, "part").join(n).withColumn("no", F.col("no") % F.col("ranges") + 1)
    pairs = last.join(follows, "no").select("id", "n_chars", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1)
                t, u = r["text"][0].as_py(), r["following"][0].as_py()
                yield _batch([(r["id"][0].as_py(), len(t), *compare(t, _made(t), u, _made(u)))], r["id"].type, names[:9])

    every = done.where("place is null").select(*names[:9]).unionByName(pairs.mapInArrow(close, f"id {kind}, n_chars long, {_ROW}"))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_sha256", "edited_fingerprint")})


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
