"""Exact top-k inner products in three phases with a uniform threshold.

Vectors become integers (floor of scale times each component). Their dimensions are cut into SLICES stretches, and for a
query each stretch has a list of partial scores of all candidates; a score is the sum of its partial ones. Vectors are
packed into blocks, and a cell has one block of queries and one of candidates.

1: cells of every STRIDE-th block of candidates find the k best whole scores in these. The k-th is a safe cutoff c, since
k candidates reach it. 2: a candidate whose score reaches c has a partial score of c/m or more in one of the m lists, so
in each cell of the other blocks each list is told the uniform share and sends the entries that reach it. Candidates that
all lists sent have whole scores by that, whose k-th best is a better cutoff. 3: of the others, those whose sent partial
scores and the most that the other lists can have left unsent reach the better cutoff are looked up in these lists. Cells
that one task goes through hand their cutoffs on. So each pair of rows is scored once, and no phase misses a candidate.

Cells are pairs of rows of two stored tables of blocks by Spark's product of partitions, which reads both again where it
needs them, so that no copies of blocks are shuffled or stored. What a cell's lists send stays in its task; what a task
writes is at most k candidates a query out of all blocks of its partition. Only time is quadratic.

Partial scores are sums of products in floats while all of them stay below 2**24, in doubles below 2**53, and in 64-bit
integers otherwise, so every phase is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Candidates of a block, which has half as many queries; lists, as stretches of the dimensions; blocks of which one makes
#: the first cutoff; cells that a task is handed at once; partitions whose lists are merged at once, and the most that the
#: first cutoff's blocks have; blocks of such a partition.
BLOCK, SLICES, STRIDE, CELLS, MERGED, SAMPLED = 1024, 2, 8, 32, 64, 256

_LEAST = np.iinfo(np.int64).min
_LISTS = "qb long, part int, size int, at binary, id binary, score binary"
_QUERIES = "qb long, qid binary, qv binary, qwidth int, qbytes int"
_TOLD = _QUERIES + ", cut binary, size int, at binary, id binary, score binary"
_FOUND = "query_id long, id long, score long"


def _ints(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", np.int64)


def _matrix(v: pa.ListArray) -> np.ndarray:
    """Rows of the smallest integers that hold them, with 0 where a vector is shorter than the longest."""
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    low, high = (int(flat.min()), int(flat.max())) if len(flat) else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    out = np.zeros((len(v), int(sizes.max(initial=0))), kind)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _unpack(packed: bytes, n: int, width: int, size: int) -> np.ndarray:
    return np.frombuffer(packed, f"i{size}").reshape(n, width)


def _blocks(rows: DataFrame, block: int, stride: int, names: str) -> DataFrame:
    """(number, ids, vectors, width, bytes of a component, sampled) of the rows (id, v), under the given names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                b = batch.slice(start, block)
                m = _matrix(b["v"])
                row = [at << 32 | done, b["id"].to_numpy().tobytes(), m.tobytes(), m.shape[1], m.itemsize, (at + done) % stride == 0]
                done += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=[c.split(" ")[0] for c in names.split(", ")])

    return rows.select("id", "v").mapInArrow(run, names)


class Best:
    """The k best candidates of each query of a block: scores in falling order, ties by rising id, _LEAST where none is.
    What take() gets is merged when it is half as much as is kept, or when it is asked for."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _LEAST), np.zeros((n, k), np.int64)
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def take(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.waiting.append((query, ids, score))
            if 2 * sum(len(w[0]) for w in self.waiting) >= self.score.size:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        query, ids, score = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting = []
        k = self.score.shape[1]
        some = np.unique(query)
        old = self.score[some].ravel()
        known = old != _LEAST
        query = np.concatenate([np.repeat(some, k)[known], query])
        ids, score = np.concatenate([self.id[some].ravel()[known], ids]), np.concatenate([old[known], score])
        order = np.lexsort((ids, ~score, query))  # ~ turns the order round without overflow
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        query, ids, score, rank = (a[rank < k] for a in (query, ids, score, rank))
        self.score[query, rank], self.id[query, rank] = score, ids

    def take_lists(self, rows: list[dict]) -> Best:
        for r in rows:
            self.take(np.frombuffer(r["at"], np.int32), _ints(r["id"]), _ints(r["score"]))
        self.settle()
        return self

    def any(self) -> bool:
        self.settle()
        return bool((self.score != _LEAST).any())

    def packed(self) -> list:
        self.settle()
        known = self.score != _LEAST
        return [len(known), np.nonzero(known)[0].astype(np.int32).tobytes(), self.id[known].tobytes(), self.score[known].tobytes()]


def _cell(best: Best, cut: np.ndarray, qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, m: int) -> None:
    """Phases 2 and 3 of a cell. cut: a score that k candidates of each query are known to reach, or _LEAST."""
    width, k = min(q.shape[1], x.shape[1]), best.score.shape[1]
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * width
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    q, x, m = q[:, :width].astype(kind), x[:, :width].astype(kind), max(1, min(m, width))
    edge = [s * width // m for s in range(m + 1)]
    lists = [q[:, a:b] @ x[:, a:b].T for a, b in zip(edge, edge[1:], strict=False)]
    cutoff = np.maximum(cut, best.score[:, -1])
    mine = np.flatnonzero(np.isin(xid, qid))  # the queries' own rows
    if (cutoff == _LEAST).any() and len(xid) - len(mine) >= k:
        whole = np.delete(sum(lists), mine, 1)  # enough candidates of this cell alone give a cutoff
        cutoff = np.maximum(cutoff, np.partition(whole, whole.shape[1] - k, axis=1)[:, -k].astype(np.int64))
    share = np.where(cutoff == _LEAST, _LEAST, -(-cutoff // m))
    told = share.astype(kind)[:, None]
    sent = [part >= told for part in lists]
    at = np.flatnonzero(np.logical_or.reduce(sent))
    query, cand = np.divmod(at, max(1, len(xid)))
    other = qid[query] != xid[cand]
    at, query, cand = at[other], query[other], cand[other]
    came = [s.ravel()[at] for s in sent]
    parts = [part.ravel()[at].astype(np.int64) for part in lists]
    n, known = sum(c.astype(np.int64) for c in came), sum(np.where(c, p, 0) for c, p in zip(came, parts, strict=True))
    full = (n == m) & (known >= cutoff[query])
    best.take(query[full], xid[cand[full]], known[full])
    # Without a cutoff everything was sent, and no pair lacks a list.
    better = np.maximum(cutoff, best.score[:, -1])[query]
    open_ = (n < m) & (known + (m - n) * (share[query] - 1) >= better)
    score = sum(p[open_] for p in parts)
    query, ids, good = query[open_], xid[cand[open_]], score >= better[open_]
    best.take(query[good], ids[good], score[good])


def _table(of: str, rows: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in of.split(", "))])
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _cells(pairs: DataFrame, k: int, m: int) -> DataFrame:
    """The lists of each block of queries in a partition: at most k candidates a query, none below its cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, best = TaskContext.get().partitionId(), None, None
        done = lambda: _table(_LISTS, [[block, part, *best.packed()]] if best is not None and best.any() else []).to_batches()
        for b in batches:
            for i in range(b.num_rows):  # all cells of a block of queries come one after the other
                r = {c: b[c][i].as_py() for c in b.schema.names if c != "qv"}
                if r["qb"] != block:
                    yield from done()
                    block, qid = r["qb"], _ints(r["qid"])
                    q, best = _unpack(b["qv"][i].as_py(), len(qid), r["qwidth"], r["qbytes"]), Best(len(qid), k)
                    cut = np.full(len(qid), _LEAST) if r["cut"] is None else _ints(r["cut"])
                xid = _ints(r["xid"])
                _cell(best, cut, qid, q, xid, _unpack(r["xv"], len(xid), r["xwidth"], r["xbytes"]), m)
        yield from done()

    return pairs.select("qb", "qid", "qv", "qwidth", "qbytes", "cut", "xid", "xv", "xwidth", "xbytes").mapInArrow(run, _LISTS)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list a block of queries and MERGED partitions."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        return _table(_LISTS, [[rows[0]["qb"], rows[0]["part"], *Best(rows[0]["size"], k).take_lists(rows).packed()]])

    return lists.groupBy("qb", F.floor(F.col("part") / MERGED)).applyInArrow(run, _LISTS)


def _product(queries: DataFrame, candidates: DataFrame, k: int, m: int, name: str) -> DataFrame:
    """The stored lists of all cells. A row of the product holds two blocks, so few of them go to a task at once."""
    spark, most = queries.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, str(CELLS))
    try:
        return stored(_merged(_cells(queries.hint("shuffle_replicate_nl").crossJoin(candidates), k, m), k), name)
    finally:
        spark.conf.set(most, before)


def top_k(
    vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
    slices: int = SLICES, stride: int = STRIDE,
) -> DataFrame:
    """(query_id, rank, id, score): for each row that the condition on the column id takes as a query, the k best other
    rows; ties to the smaller id.

    Rows with a null id, a null vector, or null or non-finite components take no part; empty vectors score 0. Vectors
    that are shorter than the longest have 0 in the components they lack. Repeated rows are candidates each; none is a
    candidate of a query of the same id. Query rows that are equal are one query; of different vectors with one id the
    lists are merged. Fewer than k candidates give fewer ranks, an empty table none. Other columns are not read,
    whatever their names.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    sound = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    asked = sound.where(queries)
    width, n = asked.agg(F.max(F.size("v")), F.count("*")).first()
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width or 0) - F.size("v")))
    half = max(1, block // 2)
    most = max(1, -(-n // half))
    # Two partitions of queries a core: their tasks share what the few partitions of the first cutoff's blocks can't.
    asking = asked.select("id", padded.alias("v")).repartition(min(most, 2 * spark.sparkContext.defaultParallelism), "id").distinct().coalesce(most)
    q = stored(_blocks(asking, half, 1, _QUERIES + ", sampled boolean").drop("sampled"), "queries")
    x = stored(_blocks(sound, block, max(1, stride), "xb long, xid binary, xv binary, xwidth int, xbytes int, sampled boolean"), "vectors")
    sampled = x.where("sampled")
    some = stored(sampled.coalesce(min(MERGED, -(-sampled.count() // SAMPLED) or 1)), "sample")
    first = _product(q.withColumn("cut", F.lit(None).cast("binary")), some, k, slices, "first")

    def tell(qt: pa.Table, lists: pa.Table) -> pa.Table:
        if not len(qt):
            return _table(_TOLD, [])
        r = qt.to_pylist()[0]
        best = Best(len(_ints(r["qid"])), k).take_lists(lists.to_pylist())
        return _table(_TOLD, [[*r.values(), best.score[:, -1].tobytes(), *best.packed()]])

    def finish(qt: pa.Table, lists: pa.Table) -> pa.Table:
        if not len(qt):
            return _table(_FOUND, [])
        r = qt.to_pylist()[0]
        qid = _ints(r["qid"])
        best = Best(len(qid), k).take_lists([r, *lists.to_pylist()])
        known = best.score != _LEAST
        return pa.table({"query_id": qid[np.nonzero(known)[0]], "id": best.id[known], "score": best.score[known]})

    grid = lambda a, b, f, s: a.groupBy("qb").cogroup(b.groupBy("qb")).applyInArrow(f, s)
    told = stored(grid(q, first, tell, _TOLD), "told")
    found = _product(told, x.where("not sampled"), k, slices, "found")
    every = grid(told.select("qb", "qid", "at", "id", "score"), found, finish, _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = stored(every.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), "topk")
    for done in (q, x, some, first, told, found):
        forget(spark, done)
    return out
