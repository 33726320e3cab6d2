"""Importance resampling towards a target distribution of hashed word features.

Features are runs of one and two words, their bucket the CRC-32 of their bytes modulo the number of buckets. A document's
weight is the mean over its features of how much likelier their buckets are in the target than in the corpus, and a draw
without replacement takes the highest sums of weight and seeded Gumbel noise.

The vocabulary has a head and a tail. The head are words and pairs of a share of at least 1/HEAD_WORDS of all words and
1/HEAD_PAIRS of all pairs, so it has at most that many entries however large the corpus, of at most LONGEST bytes a word:
it is broadcast with the words' CRC states, plain and after a space, and with the pairs' buckets. What is not in it gets
its CRC directly, pairs by going on from the state of their first word. Both ways give the same bucket for a feature, so
totals are exact and nothing but time depends on what the head holds.

Candidates for the head are found without a shuffle of the whole vocabulary: a feature whose share of all is 1/H has that
share in one stretch of the texts at least, so each stretch sends only those, with their counts in it. The sums may miss
what a feature has in stretches where it is rarer: every feature of a share of 2/H or more is surely in the head.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Entries of the head at most, and bytes of a word in it.
HEAD_WORDS, HEAD_PAIRS, LONGEST = 16_384, 32_768, 64
#: Words of a stretch, about; texts are not cut.
STRETCH = 250_000
#: Documents worked out at once in a task.
SLICE = 256

#: A-Z lower-cased; bytes that are no digit, letter or part of a non-ASCII character are spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def frequent(texts: DataFrame, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, stretch: int = STRETCH) -> list:
    """The head's rows (pair, feature as bytes), at most words + pairs of them; texts has one binary column, text."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, all_words, all_pairs = Counter(), Counter(), 0, 0

        def out() -> pa.RecordBatch:
            w = [(False, x, c) for x, c in one.items() if c * words >= all_words and len(x) <= LONGEST]
            p = [(True, b" ".join(x), c) for x, c in two.items() if c * pairs >= all_pairs and max(map(len, x)) <= LONGEST]
            w += [(False, None, all_words), (True, None, all_pairs), *p]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in w], pa.bool_()), pa.array([r[1] for r in w], pa.binary()), pa.array([r[2] for r in w], pa.int64())], ["pair", "feature", "n"])

        for b in _slices(batches):
            for text in b["text"].to_pylist():
                ws = words_of(text)
                one.update(ws)
                two.update(zip(ws, ws[1:]))
                all_words, all_pairs = all_words + len(ws), all_pairs + max(0, len(ws) - 1)
                if all_words >= stretch:
                    yield out()
                    one, two, all_words, all_pairs = Counter(), Counter(), 0, 0
        yield out()

    sums = texts.mapInArrow(heavy, "pair boolean, feature binary, n long").groupBy("pair", "feature").agg(F.sum("n").alias("n"))
    sums = stored(sums, "head")
    total = {r["pair"]: r["n"] for r in sums.where("feature is null").collect()}
    least = F.when(F.col("pair"), F.lit(total.get(True, 0) / pairs)).otherwise(F.lit(total.get(False, 0) / words))
    found = sums.where(F.col("feature").isNotNull() & (F.col("n") >= least)).select("pair", "feature").collect()
    forget(texts.sparkSession, sums)
    return found


class Head:
    """Frequent words' CRC states and frequent pairs' buckets; buckets() uses them and works out all else."""

    def __init__(self, rows: list, buckets: int):
        words = sorted({bytes(r[1]) for r in rows if not r[0]})
        self.n, self.id = buckets, {w: i for i, w in enumerate(words)}
        self.crc = np.array([zlib.crc32(w) for w in words] + [0], np.int64)  # the last is for those that are not there
        self.spaced = np.array([zlib.crc32(w + b" ") for w in words] + [0], np.int64)
        known = {}
        for _, f in (r for r in rows if r[0]):
            a, b = bytes(f).split(b" ")
            if a in self.id and b in self.id:
                known[self.id[a] * len(words) + self.id[b]] = zlib.crc32(bytes(f)) % buckets
        self.pairs = np.array(sorted(known), np.int64)
        self.pair_bucket = np.array([known[k] for k in self.pairs.tolist()], np.int64)

    def buckets(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """The buckets of each document's features: its words, then its pairs."""
        sizes = np.array([len(d) for d in docs], np.int64)
        ws = [w for d in docs for w in d]
        if not ws:
            return [np.empty(0, np.int64)] * len(docs)
        ids = np.fromiter(map(self.id.get, ws, repeat(-1)), np.int64, len(ws))
        crc, spaced = self.crc[ids], self.spaced[ids]
        tail = np.flatnonzero(ids < 0)
        rare = [ws[i] for i in tail.tolist()]
        crc[tail] = np.fromiter(map(zlib.crc32, rare), np.int64, len(rare))
        spaced[tail] = np.fromiter(map(zlib.crc32, repeat(b" "), crc[tail].tolist()), np.int64, len(rare))
        ends = np.cumsum(sizes)
        first = np.ones(len(ws), bool)
        first[ends[sizes > 0] - 1] = False  # the last word of a document begins no pair
        at = np.flatnonzero(first)
        a, b = ids[at], ids[at + 1]
        keys = np.where((a >= 0) & (b >= 0), a * len(self.id) + b, -1)
        pair = np.empty(len(at), np.int64)
        place = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
        known = self.pairs[place] == keys if len(self.pairs) else np.zeros(len(at), bool)
        pair[known] = self.pair_bucket[place[known]]
        open_ = np.flatnonzero(~known)
        after = at[open_]
        pair[open_] = np.fromiter(map(zlib.crc32, [ws[i + 1] for i in after.tolist()], spaced[after].tolist()), np.int64, len(open_)) % self.n
        one = crc % self.n
        cuts = np.cumsum(np.maximum(sizes - 1, 0))[:-1]
        return [np.concatenate(x) for x in zip(np.split(one, ends[:-1]), np.split(pair, cuts), strict=True)]


def features(docs: DataFrame, head, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: ANN001
    """(id, n_words, features) of every row; features are the buckets as little-endian numbers of two bytes (four, if
    there are more than 65 536 buckets). head: a broadcast Head."""
    kind = docs.schema[id_col].dataType.simpleString()
    wide = "<u2" if buckets <= 65536 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            docs = [words_of(t) for t in b["text"].to_pylist()]
            made = [x.astype(wide).tobytes() for x in head.value.buckets(docs)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([len(d) for d in docs], pa.int64()), pa.array(made, pa.binary())], ["id", "n_words", "features"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n_words long, features binary")


def totals(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of features; a task sends one row a bucket at most."""
    wide = "<u2" if buckets <= 65536 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in _slices(batches):
            sums += np.bincount(np.frombuffer(b"".join(b["features"].to_pylist()), wide), minlength=buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(sums[there], pa.int64())], ["bucket", "n"])

    return found.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket from totals: floor(1000 ln) of its smoothed share in the target over that in the
    corpus. Tables of one row a bucket."""
    sums = [r["n"] or 0 for t in (corpus, target) for r in t.agg(F.sum("n").alias("n")).collect()]
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    ratio = (t + 1) * F.lit(float(sums[0] + buckets)) / ((s + 1) * F.lit(float(sums[1] + buckets)))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def weighted(found: DataFrame, gain: DataFrame, buckets: int) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of the gains of a row's features, 0 without any."""
    rows = gain.collect()  # one a bucket
    by_bucket = np.zeros(buckets, np.int64)
    by_bucket[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    held = found.sparkSession.sparkContext.broadcast(by_bucket)
    kind, wide = found.schema["id"].dataType.simpleString(), "<u2" if buckets <= 65536 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            each = [np.frombuffer(x, wide) for x in b["features"].to_pylist()]
            n = np.array([len(x) for x in each], np.int64)
            sums = np.array([held.value[x].sum() for x in each], np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], b["n_words"], pa.array(n), pa.array(sums // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """floor(1000 g) of noise g from the first 32 bits of sha256('seed:id'); a null id is the empty name."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.ln(-F.ln(u)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place, from 1 in the given order, to a stored table. Rows are sorted over all partitions; a row's place is its
    place in its partition plus the rows of those before it, so no task sees all rows. Equal rows share out places, and
    may lie in several partitions."""
    spread = rows.withColumn("__at", F.monotonically_increasing_id())
    run = stored(spread.orderBy(*order, "__at").drop("__at").withColumn("__at", F.monotonically_increasing_id()), "order")
    in_part = run.withColumn("__part", F.shiftright("__at", 33))
    sizes = in_part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    return in_part.join(offsets, "__part").withColumn("place", F.col("__before") + F.col("__at").bitwiseAND(2**33 - 1) + 1).drop("__at", "__part", "__before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs. Of the N rows with least_words words or more, the
    floor(percent * N / 100) of the highest scores are drawn, ties to the smaller id (nulls last); rank is null for others.

    Null and empty texts have no features and weight 0. Repeated rows are rows each, with equal weights and scores and
    ranks of their own. Texts are read whole. An empty target gives weights against a flat one; an empty table of
    documents gives none. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(Head(frequent(docs.select(F.col(text_col).cast("binary").alias("text"))), buckets))
    found = stored(features(docs, head, buckets, id_col, text_col), "features")
    wanted = features(target.select(F.lit(0).alias("__id"), F.col(target_text).alias("__text")), head, buckets, "__id", "__text")
    sums, aims = stored(totals(found, buckets), "totals"), stored(totals(wanted, buckets), "target")
    rows = stored(weighted(found, gains(sums, aims, buckets), buckets).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "weights")
    for done in (found, sums, aims):
        forget(spark, done)
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    placed = ranked(rows.where(enough), [F.desc("score"), F.asc_nulls_last("id")])
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    out = ["id", "n_features", "weight", "score"]
    return placed.select(*out, rank.alias("rank")).unionByName(rows.where(~enough).select(*out, F.lit(None).cast("long").alias("rank")))
