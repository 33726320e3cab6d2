"""SimHash near-duplicate detection with pigeonring candidates.

A 64-bit fingerprint is cut into m segments on a ring. If two fingerprints differ in at most k bits, then from some
segment on every chain of l consecutive segments differs in at most floor(l*k/m) bits, for all l at once. Candidates are
found by equality: among the first segments of such a chain only certain patterns of unequal segments are possible, so a
few sets of equal segments cover them all, and each start and set gives one exact key. Pairs that share a key are pruned
by the whole chain from that start, and what is left is compared in full.

Only distinct fingerprints are compared, and keys take more segments the more fingerprints there are, so that fingerprints
without near ones share few keys. A key that more than CELL of them share all the same is not compared pair by pair.
Its members are enumerated: two fingerprints are within the distance exactly if some point lies within half the distance
of each, so each member sends the points of its ball, and all that meet in a point are joined to one of them. That is a
fixed number of rows a member, however many share the key. A task does not emit its links but a star over each set of
linked fingerprints, so that large groups of near copies give as many rows as they have members.

Fingerprints near each other tell little about Jaccard similarities near 0.8. Where a least similarity is asked for, they
are a first pass only: their links are verified on the sets of shingles, and an exact set join finds all pairs that the
verified links leave apart. A set's shingles are ordered by (weight, hash), the weights being counts of frequent ones, and
two sets of the similarity share one of their first n - ceil(t * n) + 1 (prefix filter). Sizes, places in the order and the
number of shared shingles in the prefixes prune (length, positional and count filter), the whole sets verify. Sets are of 40-bit hashes of shingles and stand for them:
two documents of n shingles share a hash by chance once in 2**40 / n**2 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: The most fingerprints of a key that are compared pair by pair, about as many as a ball of radius two has points; and
#: how many may share a key by chance before keys take more segments.
CELL, CHANCE = 2048, 64
#: Shingles of a chunk in which frequent ones are counted, the least count there, and how many get a weight. Any weights
#: give the same pairs; these keep common passages out of the prefixes.
CHUNK, OFTEN, HEAVY = 2_000_000, 5, 50_000
_SEED = 42


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the runs of words, as often as they stand; of all words if there are fewer, none for texts without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    w = min(words, len(tokens))
    starts, stops = (ends - size)[: len(tokens) - w + 1], ends[w - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))


def _mark(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int) -> int:
    """64 bits, signed. Null and empty texts, and texts without words, have 0."""
    return _mark(shingles(text, words))


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = pa.array([fingerprint(t.as_py(), words) for t in b["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"], marks], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def key_sets(distance: int, segments: int, reach: int, equal: int) -> list[tuple[int, ...]]:
    """Sets of `equal` of the first `reach` segments of a chain, such that each pattern of differing segments that the
    chain's budgets allow leaves all segments of some set equal. Chosen greedily; fails if there is no such family."""
    patterns = [p for p in product((0, 1), repeat=reach) if all(sum(p[:n]) <= n * distance // segments for n in range(1, reach + 1))]
    sets = list(combinations(range(reach), equal))
    chosen = []
    while patterns:
        best = max(sets, key=lambda s: sum(not any(p[i] for i in s) for p in patterns))
        left = [p for p in patterns if any(p[i] for i in best)]
        if len(left) == len(patterns):
            raise ValueError("no family of keys covers these budgets")
        chosen.append(best)
        patterns = left
    return chosen


def choose_keys(distance: int, segments: int, points: int) -> list[tuple[int, ...]]:
    """The key sets with the fewest equal segments by which at most CHANCE of so many random points share a key, or those
    with the most there are."""
    found: list[tuple[int, ...]] = []
    for equal in range(1, segments):
        for reach in range(equal, min(segments, 10) + 1):
            try:
                found = key_sets(distance, segments, reach, equal)
            except ValueError:
                continue
            if points >> (64 * equal // segments) <= CHANCE and equal > 2:
                return found
            break
    return found


def _bounds(segments: int) -> list[int]:
    return [64 * i // segments for i in range(segments + 1)]


def _keys(segments: int, sets: list[tuple[int, ...]]) -> Column:
    """An array of (start, number, mask) for each start and set: mask has the bits of the set's segments."""
    cut, out = _bounds(segments), []
    for start in range(segments):
        for n, chosen in enumerate(sets):
            at = [(start + i) % segments for i in chosen]
            mask = sum((1 << cut[i + 1]) - (1 << cut[i]) for i in at)
            out.append(F.struct(F.lit(start).alias("start"), F.lit(start * len(sets) + n).alias("number"), F.lit(mask - (mask >> 63 << 64)).cast("long").alias("mask")))
    return F.array(*out)


def _linked(start: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Which pairs pass their chain's budgets and then the full check."""
    cut, x = _bounds(segments), a ^ b
    alive, spent = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n in range(segments):
        low = np.array(cut[:-1], np.uint64)[(start[alive] + n) % segments]
        width = np.diff(cut).astype(np.uint64)[(start[alive] + n) % segments]
        spent = spent + np.bitwise_count((x[alive] >> low) & ((np.uint64(1) << width) - np.uint64(1)))
        ok = spent <= (n + 1) * distance // segments
        alive, spent = alive[ok], spent[ok]
    return alive[np.bitwise_count(x[alive]) <= distance]


def _contracted(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges between values, as stars over the sets that they join: (u, v), u > v."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            break
    member = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[member]), pa.array(names[root[member]])], ["u", "v"])


def _close(cells: np.ndarray, start: np.ndarray, fp: np.ndarray, distance: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """cells: sorted group numbers. Places of all pairs within a cell that are within the distance."""
    at, step, found = np.arange(len(fp) - 1), 1, [np.zeros((2, 0), np.int64)]
    while len(at := at[at + step < len(fp)]) and len(at := at[cells[at] == cells[at + step]]):
        for piece in np.array_split(at, -(-len(at) // 500_000)):
            hit = piece[_linked(start[piece], fp[piece], fp[piece + step], distance, segments)]
            found.append(np.stack([hit, hit + step]))
        step += 1
    return np.concatenate(found, axis=1)


def _by_runs(columns: list[str], work, most: int = 50_000):  # noqa: ANN001, ANN202
    """A function of batches of long columns that are sorted by the first: work gets whole runs of equal values of it and
    gives batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.stack([b[c].to_numpy().astype(np.int64) for c in columns]))
            if sum(h.shape[1] for h in held) >= most:
                rows = np.concatenate(held, axis=1)
                whole = np.searchsorted(rows[0], rows[0, -1])  # the last run may go on
                held = [rows[:, whole:]]
                if whole:
                    yield from work(*rows[:, :whole])
        if held:
            yield from work(*np.concatenate(held, axis=1))

    return run


def ball(radius: int) -> np.ndarray:
    """Masks of at most radius bits, by their number of bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)


def crowd_links(crowd: DataFrame, distance: int) -> DataFrame:
    """Edges as of links() between fingerprints (column fp, distinct), by the points that lie between them."""
    inner, masks = distance // 2, ball(-(-distance // 2))
    far = (np.bitwise_count(masks) > inner).astype(np.int8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b["fp"].to_numpy().view(np.uint64)
            step = max(1, 500_000 // len(masks))
            for at in range(0, len(fps), step):
                some = fps[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.tile(far, len(some))), pa.array(np.repeat(some, len(masks)).view(np.int64))], ["mid", "far", "fp"])

    def meet(mid: np.ndarray, far: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = np.searchsorted(mid, mid)  # the first of the run is the nearest to its point
        ok = (far[head] == 0) & (fp != fp[head])
        yield _contracted(fp[ok], fp[head[ok]])

    mids = crowd.mapInArrow(send, "mid long, far byte, fp long").repartition("mid").sortWithinPartitions("mid", "far", "fp")
    return mids.mapInArrow(_by_runs(["mid", "far", "fp"], meet), "u long, v long")


def links(points: DataFrame, distance: int, segments: int, sets: list[tuple[int, ...]], crowded: bool = True) -> DataFrame:
    """Edges (u, v), u > v, that join all fingerprints (column fp, distinct) within the distance, as stars: the same
    components as all pairs have. Without crowded, keys that more than CELL share are left out."""
    keys = points.select("fp", F.inline(_keys(segments, sets))).select("fp", "start", F.xxhash64("number", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    big = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("key"), "crowded")
    more = None
    if not big.isEmpty():
        # Spark's estimate of sizes knows nothing of the keys each fingerprint has, so it is kept from broadcasting them.
        if crowded:
            more = crowd_links(stored(keys.join(big.hint("merge"), "key", "left_semi").select("fp").distinct(), "crowd"), distance)
        keys = keys.join(big.hint("merge"), "key", "left_anti")

    def compare(key: np.ndarray, start: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _close(key, start, fp.view(np.uint64), distance, segments)
        yield _contracted(fp[a], fp[b])

    found = keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_by_runs(["key", "start", "fp"], compare), "u long, v long")
    return (found if more is None else found.unionByName(more)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of edges but the least of its component, with that least node. Alternates stars around larger
    and around smaller neighbours until nothing changes."""
    edges, state = stored(edges, "links"), None  # each round reads its edges several times
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "stars")
        now = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(edges.sparkSession, edges)
        edges = after
        if now == state:
            return edges
        state = now


#: Bytes of a shingle's hash that sets keep: of 10^12 different shingles one in 280 shares its key with another by chance.
BYTES = 6


def packed(h: np.ndarray) -> bytes:
    """The set of the upper BYTES of hashes, sorted."""
    return np.ascontiguousarray(np.unique(h >> np.uint64(64 - 8 * BYTES)).view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // BYTES, 8), np.uint8)
    wide[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return wide.view(np.int64).ravel()


def _sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, sid, set) of every row: its distinct shingles, packed, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                runs = [shingles(t.as_py(), words) for t in part["text"]]
                sid = np.array([xxhash.xxh64_intdigest(np.unique(h).tobytes(), _SEED) for h in runs], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([_mark(h) for h in runs], pa.int64()), pa.array(sid), pa.array(map(packed, runs), pa.binary())], ["id", "fp", "sid", "set"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long, sid long, set binary")


def _weights(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts; at most HEAVY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def done() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= OFTEN]), pa.array(n[n >= OFTEN])], ["h", "n"])

        for b in batches:
            for raw in b["set"]:
                held.append(unpacked(raw.as_py()))
                size += len(held[-1])
                if size >= CHUNK:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    found = sets.select("set").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).toArrow()
    h, n = (np.array(found[c].to_numpy(), np.int64) for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, heavy: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in the order by (weight, hash), of which a set of the similarity must share one."""
    at = np.minimum(np.searchsorted(heavy, h), max(0, len(heavy) - 1))
    mine = np.where(heavy[at] == h, weight[at], 0) if len(heavy) else np.zeros(len(h), np.int64)
    return h[np.lexsort((h, mine))][: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of different sids whose sets have the similarity. Sets are shuffled once, and then only those of
    pairs."""
    sides = pairs.select(F.explode(F.array("u", "v")).alias("sid"), "u", "v")
    both = sides.join(sets.select("sid", "set").hint("merge"), "sid").groupBy("u", "v").agg(F.min("set").alias("a"), F.max("set").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for a, b in zip(x["a"], x["b"], strict=True):
                a, b = unpacked(a.as_py()), unpacked(b.as_py())
                common = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(common + 1e-9 >= least * (len(a) + len(b) - common))
            yield x.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _apart(cells: np.ndarray, size: np.ndarray, pos: np.ndarray, part: np.ndarray, least: float, star: bool, most: int = 500_000) -> Iterator[np.ndarray]:
    """(a, b, first, need), some of the pairs at a time, about `most` compared and at most that many found: pairs of rows of one cell, of different parts, that sizes and places in the order allow; with
    star only those with the cell's first row. first says whether the key can be the first that the two sets share, need
    how many keys of their prefixes two sets of the similarity share at least: beyond the prefix that ends first in the
    order, that set has ceil(t * n) - 1 shingles."""

    def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        large = np.maximum(size[a], size[b])
        common = np.ceil(least / (1 + least) * (size[a] + size[b]) - 1e-9).astype(np.int64)
        after = np.minimum(size[a] - pos[a], size[b] - pos[b])
        ok = (part[a] != part[b]) & (np.minimum(size[a], size[b]) + 1e-9 >= least * large)
        ok &= (after if star else after + np.minimum(pos[a], pos[b])) >= common
        need = common - np.ceil(least * large - 1e-9).astype(np.int64) + 1
        return np.stack([a, b, after >= common, need])[:, ok]

    if star:
        yield allowed(np.searchsorted(cells, cells), np.arange(len(cells)))
        return
    at, step, found, held = np.arange(len(cells) - 1), 1, [np.zeros((4, 0), np.int64)], 0
    while len(at := at[at + step < len(cells)]) and len(at := at[cells[at] == cells[at + step]]):
        found.append(allowed(at, at + step))
        held += found[-1].shape[1]
        if held >= most:
            yield np.concatenate(found, axis=1)
            found, held = [], 0
        step += 1
    if found:
        yield np.concatenate(found, axis=1)


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(key, sid, pos, n): the first shingles of each set (sid, set), their places and the set's size."""
    heavy, weight = _weights(sets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                cut = b.slice(at, 500)
                whole = [unpacked(raw.as_py()) for raw in cut["set"]]
                n = np.array([len(h) for h in whole])
                firsts = [prefix(h, heavy, weight, least) if len(h) else h for h in whole]
                times = [len(x) for x in firsts]
                pos = np.concatenate([np.arange(t, dtype=np.int32) for t in times])
                cols = [np.concatenate(firsts).astype(np.int64), np.repeat(cut["sid"].to_numpy(), times), pos, np.repeat(n, times).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "sid", "pos", "n"])

    return sets.select("sid", "set").mapInArrow(send, "key long, sid long, pos int, n int")


def shared(prefixes: DataFrame) -> DataFrame:
    """The rows of prefixes whose key more than one set has. prefixes are worked out twice, for counts and for rows,
    rather than written: most keys are of one set."""
    keys = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("key")
    return prefixes.join(keys.hint("merge"), "key")


def still_open(members: DataFrame) -> DataFrame:
    """The members of keys whose members are not all of one part: only these can hold a pair that is still apart. Counts
    are combined before they are shuffled, so a key of very many members costs no task more than others."""
    keys = members.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("key")
    return members.join(keys.hint("merge"), "key")


def candidates(members: DataFrame, least: float, star: bool) -> DataFrame:
    """(u, v), u > v: of open members (still_open) all pairs of sets of the similarity whose parts differ, and others that
    the filters let pass, each once; keys of a pair are counted at least as often as it shares them. With star each set has one pair at most, with the set that is the first of most of
    its keys, as a cheap way to join what is left of large groups."""
    sides = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("sides"))
    side = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("sides")).cast("int")
    members = members.join(sides.hint("merge"), "key")
    if star:
        placed = members.select("sid", "pos", "n", "part", F.xxhash64("key", side).alias("cell"))
    else:
        placed = members.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        placed = placed.select("sid", "pos", "n", "part", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("cell"))

    def pairs(cell: np.ndarray, sid: np.ndarray, pos: np.ndarray, n: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b, first, need in _apart(cell, n, pos, part, least, star):
            u, v = np.maximum(sid[a], sid[b]), np.minimum(sid[a], sid[b])
            order = np.lexsort((v, u))
            u, v, first, need = u[order], v[order], first[order], need[order]
            new = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) if len(u) else np.zeros(0, np.int64)
            times, leads = np.diff(np.append(new, len(u))), np.maximum.reduceat(first, new) if len(u) else first
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (u[new], v[new], times, leads, need[new])], ["u", "v", "times", "first", "need"])

    cells = placed.repartition("cell").sortWithinPartitions("cell", "sid")
    found = cells.mapInArrow(_by_runs(["cell", "sid", "pos", "n", "part"], pairs), "u long, v long, times long, first long, need long")
    found = found.groupBy("u", "v").agg(F.sum("times").alias("times"), F.max("first").alias("first"), F.max("need").alias("need"))
    if star:
        return found.groupBy("u").agg(F.max_by("v", F.struct("times", "v")).alias("v"))
    return found.where("first = 1 and times >= need").select("u", "v")


def near_duplicates(
    docs: DataFrame, words: int = 4, distance: int = 4, segments: int = 10, reach: int | None = None, equal: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None,
) -> DataFrame:
    """(id, fp, component) of every row: component is the smallest id that a chain of links reaches, itself included.

    Links are fingerprints within the distance or, if jaccard is given, exactly the pairs whose sets of shingles have
    that similarity or more. Rows with equal fingerprints (with jaccard, equal sets) are linked. reach and equal name the
    keys (see key_sets); without them they follow from the number of fingerprints. Null texts count as empty; texts
    without words have fingerprint 0, and are linked like any other; texts of any length count whole. A null id is never
    the smallest; the component is null only if all its ids are. Repeated rows are kept, each with its row. An empty
    table gives an empty result. Other columns are not read, whatever their names.
    """
    if jaccard is not None:
        return _exact(docs, words, distance, segments, reach, equal, id_col, text_col, jaccard)
    marks = stored(fingerprints(docs, words, id_col, text_col), "simhash")
    points = stored(marks.groupBy("fp").agg(F.min("id").alias("least")), "points")
    stars = components(links(points, distance, segments, _chosen(points, distance, segments, reach, equal)))
    placed = points.join(stars.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("centre"))
    names = placed.groupBy("centre").agg(F.min("least").alias("component"))
    classes = stored(placed.join(names, "centre").select("fp", "component"), "classes")
    return marks.join(classes, "fp").select("id", "fp", "component")


def _chosen(points: DataFrame, distance: int, segments: int, reach: int | None, equal: int | None) -> list[tuple[int, ...]]:
    return key_sets(distance, segments, reach, equal) if reach and equal else choose_keys(distance, segments, points.count())


def _exact(docs: DataFrame, words: int, distance: int, segments: int, reach: int | None, equal: int | None, id_col: str, text_col: str, least: float) -> DataFrame:
    spark = docs.sparkSession
    all_sets = stored(_sets(docs, words, id_col, text_col), "shingles")
    marks = stored(all_sets.select("id", "fp", "sid"), "simhash")
    sets = stored(all_sets.select("sid", "set").dropDuplicates(["sid"]), "sets")
    forget(spark, all_sets)
    points = stored(marks.groupBy("sid").agg(F.first("fp").alias("fp"), F.min("id").alias("least")), "points")
    firsts = stored(points.groupBy("fp").agg(F.min("sid").alias("sid")), "marks")

    # First pass: fingerprints within the distance, and sets of one fingerprint. Crowded keys are left to the set join.
    near = links(firsts.select("fp"), distance, segments, _chosen(firsts, distance, segments, reach, equal), crowded=False)
    of = lambda fp, sid: firsts.select(F.col("fp").alias(fp), F.col("sid").alias(sid))
    near = near.join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
    same = points.join(firsts.withColumnRenamed("sid", "b"), "fp").where("sid <> b").select(F.col("sid").alias("a"), "b")
    first = near.unionByName(same).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    first = stored(_verified(first, sets, least), "first")

    # The rest, exactly: stars join what is left of large groups, then all pairs that are still apart.
    members = None
    for star in (True, True, False):
        parts = components(first).select(F.col("u").alias("sid"), F.col("v").alias("part"))
        of_part = F.coalesce("part", "sid").alias("part")
        before = stored(shared(_prefixes(sets, least)), "shared") if members is None else members.drop("part")
        members = stored(still_open(before.join(parts.hint("merge"), "sid", "left").select("key", "sid", "pos", "n", of_part)), "members")
        used = [before]
        rest = stored(candidates(members, least, star), "candidates")
        first, used = stored(first.unionByName(_verified(rest, sets, least)), "found"), [*used, rest, first]
        for done in used:
            forget(spark, done)
    stars = components(first)
    placed = points.join(stars.select(F.col("u").alias("sid"), "v"), "sid", "left").select("sid", "least", F.coalesce("v", "sid").alias("centre"))
    names = placed.groupBy("centre").agg(F.min("least").alias("component"))
    classes = stored(placed.join(names, "centre").select("sid", "component"), "classes")
    for done in (sets, members, first, firsts, points):
        forget(spark, done)
    return marks.join(classes, "sid").select("id", "fp", "component")
