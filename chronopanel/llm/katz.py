"""Language-model scores by a Katz bigram model with Good-Turing discounts.

Counts come from the training documents only. A count r of at most K is discounted to d(r)*r by Good-Turing's estimate
from the numbers of n-grams with each count; what that leaves goes to unseen n-grams, exactly normalised:

    P(w | v) = d(c) c(vw) / c(v)             if vw was seen
             = a(v) P(w)                     if not, a(v) = (1 - sum of the seen P(. | v)) / (1 - sum of the seen words' P)
    P(w)     = d(c) c(w) / N                 if w was seen
             = 1 - the sum of these          for the one class of all unseen words

Where every count is over K nothing is discounted, and an unseen word would have probability 0. Such a context is closed:
its denominator, c(v) or N, is one more, as in the CMU and SRI toolkits, and that one goes to what is unseen.

Documents are read once, into blocks of about BLOCK tokens with a vocabulary of their own. Blocks send their words to
buckets by the words' hash; a bucket adds up counts, gives numbers, small ones to frequent words, and answers each block in
the order in which it sent its words. Each block then sends the bigrams of words that the training knows, once each, to
buckets by the context's number; a context seen over HOT times is spread over as many buckets as it takes, by the word
that follows, so no bucket grows with one frequent word. Bigrams with a word that the training doesn't know need no
bucket: they have probability a(v) P(w), and P(w) alone if v is unknown. A bucket merges what it got into its part of the
bigram table, which is stored with its answers, the counts in the order in which each block sent its bigrams. Once the
table's count statistics are known, buckets answer the backoff weights that blocks need, and each block evaluates its
documents token by token: from the bigram if it was seen, else recursively from the backoff weight and the word.
bigram_rows() gives the stored table as plain rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

#: Tokens of a block; count from which a context is spread; bigrams of a bucket, about; counts that are discounted.
BLOCK, HOT, BUCKET, K = 4_000_000, 100_000, 2_500_000, 5

_BEGIN = -2
_END = int(np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64).view(np.int64)[0])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers, of each the bytes of equal weight together, compressed."""
    parts = [np.ascontiguousarray(a, np.int64) for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.view(np.uint8).reshape(-1, 8).T.tobytes() for a in parts))


def unpack(b: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int.from_bytes(raw[:8], "little")
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(raw, np.int64, n, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T).view(np.int64).ravel())
        at += 8 * size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences from each value to the one before; np.cumsum undoes it. Small for sorted values."""
    return np.diff(a, prepend=np.int64(0))


def discounts(n: list[int]) -> np.ndarray:
    """d(0..K) from n[r], the number of n-grams seen r times, r up to K + 1. Where Good-Turing's estimate is not between
    0 and 1, as in small corpora, absolute discounting takes its place."""
    n1, n2 = n[1], n[2]
    absolute = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
    d = np.ones(K + 1)
    rest = (K + 1) * n[K + 1] / n1 if n1 else 0.0
    for r in range(1, K + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        d[r] = turing if 0 < turing < 1 else (r - absolute) / r
    return d


class Words:
    """P(w) from a word's training count."""

    def __init__(self, total: int, n: list[int], d: np.ndarray):
        closed = total > 0 and not any(n[1 : K + 1])
        self.total, self.d = total + closed, d
        lost = 1.0 if closed else sum(n[r] * r * (1 - d[r]) for r in range(1, K + 1))
        self.unseen = lost / self.total if total else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, _scaled(self.d, count) / max(1, self.total), self.unseen)


def _scaled(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count > K, 1.0, d[np.minimum(count, K)]) * count


def _blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str, tokens: int) -> DataFrame:
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[bool] = []
        texts: list[np.ndarray] = []
        place: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            nonlocal done
            code = np.concatenate(texts)
            order = np.argsort(-np.bincount(code), kind="stable")  # frequent words get small numbers
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in place), np.uint64, len(place)).view(np.int64)
            row = [pa.array([TaskContext.get().partitionId() << 32 | done]), pa.array([ids], batches_schema.field("ids").type), pa.array([len(code)])]
            row += [pa.array([x], pa.binary()) for x in (pack(np.array(held), np.array([len(t) for t in texts])), pack(hashes[order]), pack(rank[code]))]
            done += 1
            return pa.RecordBatch.from_arrays(row, schema=batches_schema)

        batches_schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(_arrow(kind))), ("n", pa.int64()), ("sizes", pa.binary()), ("vocabulary", pa.binary()), ("tokens", pa.binary())])
        size, done = 0, 0
        for b in batches:
            for i, out, text in zip(b["id"].to_pylist(), b["held"].to_pylist(), b["text"], strict=True):
                words = [*(text.as_py() or "").encode().lower().split(), b""]  # b"" is the end
                ids.append(i)
                held.append(out)
                texts.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)))
                size += len(words)
                if size >= tokens:
                    yield flush()
                    ids, held, texts, size, place = [], [], [], 0, {}
        if ids:
            yield flush()

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return chosen.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, n long, sizes binary, vocabulary binary, tokens binary")


def _arrow(kind) -> pa.DataType:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's words in the order of (bucket, hash), and where each bucket ends in it."""
    bucket = (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _send_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block, words) of each block: packed hashes and their counts in its training documents."""
    for b in batches:
        for r in b.to_pylist():
            (h,), (t,), (held, sizes) = unpack(r["vocabulary"]), unpack(r["tokens"]), unpack(r["sizes"])
            count = np.bincount(t[np.repeat(held == 0, sizes)], minlength=len(h))
            order, ends = _by_bucket(h, buckets)
            some = np.flatnonzero(np.diff(ends)).tolist()
            cut = [order[ends[k] : ends[k + 1]] for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([r["block"]] * len(some), pa.int64()), pa.array([pack(steps(h[c]), count[c]) for c in cut], pa.binary())], ["bucket", "block", "words"])


def _merge_words(got: pa.Table, buckets: int) -> pa.Table:
    """A bucket's part of the word table: (bucket, block, words, stats), words being packed numbers and counts in the order
    that the block sent; in the first row stats, how many words were seen 1 to K + 1 times, words, tokens, ends."""
    bucket, sent = got["bucket"][0].as_py(), [unpack(x.as_py()) for x in got["words"]]
    hashes, place = np.unique(np.concatenate([np.cumsum(h) for h, _ in sent]), return_inverse=True)
    count = np.bincount(place, weights=np.concatenate([c for _, c in sent])).astype(np.int64)
    number = np.empty(len(count), np.int64)
    number[np.argsort(-count, kind="stable")] = np.arange(len(count)) * buckets + bucket
    cuts = np.split(place, np.cumsum([len(h) for h, _ in sent])[:-1])
    stats = [int((count == r).sum()) for r in range(1, K + 2)] + [int((count > 0).sum()), int(count.sum()), int(count[hashes == _END].sum())]
    return pa.table({
        "bucket": pa.array([bucket] * len(got), pa.int64()), "block": got["block"], "words": pa.array([pack(number[c], count[c]) for c in cuts], pa.binary()),
        "stats": pa.array([stats] + [None] * (len(got) - 1), pa.list_(pa.int64())),
    })


def _mix(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)


class Block:
    """A block's tokens with what the training knows of its words, and its bigrams of known words by bucket, context and
    word: the same each time, so that answers in their order need no keys."""

    def __init__(self, row: dict, words: list[tuple[int, bytes]], word_buckets: int, buckets: int, hot: int, begins: int):
        (self.held, self.sizes), (hashes,), (t,) = unpack(row["sizes"]), unpack(row["vocabulary"]), unpack(row["tokens"])
        n = len(hashes)
        number, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        order, ends = _by_bucket(hashes, word_buckets)
        for k, packed in words:
            number[order[ends[k] : ends[k + 1]]], count[order[ends[k] : ends[k + 1]]] = unpack(packed)
        number[n], count[n] = _BEGIN, begins
        self.number, self.count, self.t, self.hot = number, count, t, hot
        self.starts = np.cumsum(self.sizes) - self.sizes
        ctx = np.concatenate([[n], t[:-1]]) if len(t) else t
        ctx[self.starts] = n
        self.ctx = ctx
        both = (count[ctx] > 0) & (count[t] > 0)
        self.at = np.flatnonzero(both)  # tokens whose bigram goes to a bucket
        key = ctx[self.at] * (n + 1) + t[self.at]
        key, self.gram = np.unique(key, return_inverse=True)
        c, w = key // (n + 1), key % (n + 1)
        seen = np.bincount(self.gram[np.repeat(self.held == 0, self.sizes)[self.at]], minlength=len(key))
        part = _mix(number[w]) % np.maximum(1, -(-count[c] // hot)).astype(np.uint64)
        bucket = (_mix(number[c].astype(np.uint64) + part * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((number[w], number[c], bucket))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.gram, self.c, self.w, self.seen = place[self.gram], c[order], w[order], seen[order]
        self.ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        # Contexts of words that the training doesn't know: each asks the bucket of its first part.
        asked = np.unique(ctx[(count[ctx] > 0) & (count[t] == 0)])
        home = (_mix(number[asked].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((number[asked], home))
        self.asked, self.asked_ends = asked[order], np.searchsorted(home[order], np.arange(buckets + 1))

    def pieces(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(bucket, its bigrams, contexts that ask it) where there are any."""
        for k in np.flatnonzero(np.diff(self.ends) + np.diff(self.asked_ends)).tolist():
            yield k, slice(self.ends[k], self.ends[k + 1]), self.asked[self.asked_ends[k] : self.asked_ends[k + 1]]

    def needs(self, mine: slice, asked: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The contexts whose backoff weight a piece needs, given its bigrams' counts, in the order of their numbers. Of a
        spread one it is needed in any case, since only its sign tells that the context is closed."""
        c = self.c[mine]
        c = np.unique(np.concatenate([c[(count == 0) | (self.count[c] > self.hot)], asked]))
        return c[np.argsort(self.number[c], kind="stable")]

    def request(self, mine: slice, asked: np.ndarray) -> bytes:
        c, w = self.c[mine], self.w[mine]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        words, at = np.unique(self.number[w], return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        counts[at] = self.count[w]
        move = steps(at)
        move[first] = at[first]
        heads = c[first]
        return pack(steps(self.number[heads]), self.count[heads], np.diff(np.concatenate([first, [len(c)]])), steps(words), counts, move, self.seen[mine], steps(self.number[asked]), self.count[asked])


def _request(block: pa.Table, words: pa.Table, word_buckets: int, buckets: int, hot: int, begins: int) -> pa.Table:
    """(bucket, block, grams): a block's bigrams, a row a bucket."""
    rows = []
    if len(block):
        b = Block(block.to_pylist()[0], list(zip(words["bucket"].to_pylist(), words["words"].to_pylist(), strict=True)), word_buckets, buckets, hot, begins)
        rows = [{"bucket": k, "block": block["block"][0].as_py(), "grams": b.request(mine, asked)} for k, mine, asked in b.pieces()]
    return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("grams", pa.binary())]))


_TABLE = "bucket long, block long, counts binary, grams binary, blocks array<long>, needs array<binary>, n array<long>, hot array<struct<ctx: long, ctx_count: long, m: array<long>, many: long, q: double>>"


def _merge(got: pa.Table, words: Words, limit: int) -> pa.Table:
    """A bucket's part of the bigram table: in one row its bigrams (packed: contexts, their counts and numbers of bigrams,
    words, counts), which backoff weights which block needs, count statistics and sums of spread contexts; in a row for
    each block the counts of its bigrams, negative in closed contexts that are not spread."""
    pieces = [unpack(x.as_py()) for x in got["grams"]]
    grams = [p[2] for p in pieces]
    heads = [np.cumsum(p[0]) for p in pieces]
    word_of = []
    for sizes, (_, _, _, vocabulary, _, move, _, _, _) in zip(grams, pieces, strict=True):
        # Indices restart with each context: what the running sum has gathered before it goes.
        total = np.cumsum(move)
        first = np.cumsum(sizes) - sizes
        word_of.append(total - np.repeat(total[first] - move[first], sizes) if len(move) else move)
    ctx = np.concatenate([np.repeat(h, s) for h, s in zip(heads, grams, strict=True)])
    word = np.concatenate([np.cumsum(p[3])[w] for p, w in zip(pieces, word_of, strict=True)])
    word_count = np.concatenate([p[4][w] for p, w in zip(pieces, word_of, strict=True)])
    seen = np.concatenate([p[6] for p in pieces])
    order = np.lexsort((word, ctx))
    ctx_s, word_s = ctx[order], word[order]
    new = np.concatenate([[True], (ctx_s[1:] != ctx_s[:-1]) | (word_s[1:] != word_s[:-1])])[: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    count = np.bincount(place, weights=seen, minlength=len(first)).astype(np.int64)
    all_heads, where = np.unique(np.concatenate([*heads, *[np.cumsum(p[7]) for p in pieces]]), return_index=True)
    ctx_count = np.concatenate([*[p[1] for p in pieces], *[p[8] for p in pieces]])[where]
    head_of = np.searchsorted(all_heads, ctx_s[first])
    q = np.bincount(head_of, weights=np.where(count > 0, words.p(word_count[order][first]), 0.0), minlength=len(all_heads))
    hot = []
    for i in np.flatnonzero(ctx_count > limit).tolist():
        mine = count[np.searchsorted(head_of, i) : np.searchsorted(head_of, i, "right")]
        hot.append({"ctx": int(all_heads[i]), "ctx_count": int(ctx_count[i]), "m": np.bincount(mine[mine <= K], minlength=K + 1).tolist(), "many": int(mine[mine > K].sum()), "q": float(q[i])})
    signed = np.where((_closed(head_of, count, len(all_heads)) & (ctx_count <= limit))[head_of], -count, count)
    bucket, blocks = got["bucket"][0].as_py(), got["block"].to_pylist()
    rows, needs, at = [], [], 0
    for block, piece, sizes, h in zip(blocks, pieces, grams, heads, strict=True):
        mine = signed[place[at : at + sizes.sum()]]
        at += sizes.sum()
        rows.append({"bucket": bucket, "block": block, "counts": pack(mine)})
        needs.append(pack(steps(np.searchsorted(all_heads, np.unique(np.concatenate([np.repeat(h, sizes)[(mine == 0) | np.repeat(piece[1] > limit, sizes)], np.cumsum(piece[7])]))))))
    packed = pack(steps(all_heads), ctx_count, np.bincount(head_of, minlength=len(all_heads)), word_s[first], count, q.view(np.int64))
    rows.append({"bucket": bucket, "grams": packed, "blocks": blocks, "needs": needs, "n": np.bincount(count[count <= K + 1], minlength=K + 2).tolist(), "hot": hot})
    kind = pa.schema([
        ("bucket", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("grams", pa.binary()), ("blocks", pa.list_(pa.int64())), ("needs", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())),
        ("hot", pa.list_(pa.struct([("ctx", pa.int64()), ("ctx_count", pa.int64()), ("m", pa.list_(pa.int64())), ("many", pa.int64()), ("q", pa.float64())]))),
    ])
    return pa.Table.from_pylist(rows, kind)


def _closed(head_of: np.ndarray, count: np.ndarray, heads: int) -> np.ndarray:
    """Which contexts have no bigram that is discounted."""
    return np.bincount(head_of, weights=(count > 0) & (count <= K), minlength=heads) == 0


def _backs(r: dict, words: Words, d: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of the bigram table: contexts, their numbers of bigrams and backoff weights (negative if closed), words,
    counts. The words that a context was not followed by have the unseen class's probability at least, whatever the
    rounding of the others' sum."""
    step, ctx_count, grams, word, count, q = unpack(r["grams"])
    heads = np.cumsum(step)
    head_of = np.repeat(np.arange(len(heads)), grams)
    used = np.bincount(head_of, weights=_scaled(d, count), minlength=len(heads))
    left = np.where(_closed(head_of, count, len(heads)), -1 / (ctx_count + 1), 1 - used / ctx_count)
    back = left / np.maximum(1 - q.view(np.float64), words.unseen)
    known = {h["ctx"]: h["back"] for h in r["back"] or ()}
    for i in np.flatnonzero(ctx_count > limit).tolist():
        back[i] = known[int(heads[i])]
    return heads, grams, back, word, count


def _score(block: pa.Table, got: pa.Table, words: Words, d: np.ndarray, total: int, distinct: int, begins: int, sizes: tuple[int, int, int], kind: pa.DataType) -> pa.Table:
    """The scores of a block's documents from its words, its bigrams' counts and the backoff weights it needs."""
    schema = pa.schema([("id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    if not len(block):
        return schema.empty_table()
    r, told, counts, backs = block.to_pylist()[0], [], {}, {}
    for x in got.to_pylist():
        if x["words"] is not None:
            told.append((x["bucket"], x["words"]))
        elif x["counts"] is not None:
            counts[x["bucket"]] = x["counts"]
        else:
            backs[x["bucket"]] = x["backs"]
    b = Block(r, told, *sizes, begins)
    back, seen, extra = np.ones(len(b.number)), np.zeros(len(b.c), np.int64), np.zeros(len(b.number), np.int64)
    for k, mine, asked in b.pieces():
        (told_seen,) = unpack(counts[k])
        seen[mine] = np.abs(told_seen)
        extra[b.c[mine][told_seen < 0]] = 1
        if len(c := b.needs(mine, asked, told_seen)):
            told_back = unpack(backs[k])[0].view(np.float64)
            back[c] = np.abs(told_back)
            extra[c[told_back < 0]] = 1
    count = np.zeros(len(b.t), np.int64)
    count[b.at] = seen[b.gram]
    with np.errstate(divide="ignore"):
        lower = np.log10(back[b.ctx]) + np.log10(words.p(b.count[b.t]))
        each = np.where(count > 0, np.log10(_scaled(d, count) / np.maximum(1, b.count[b.ctx] + extra[b.ctx])), lower)
    base = np.log10((b.count[b.t] + 0.1) / (total + 0.1 * (distinct + 1)))
    add = lambda a, of=float: np.add.reduceat(a, b.starts, dtype=of)
    return pa.table([pa.array(r["ids"], kind), pa.array(b.held != 0), pa.array(b.sizes), pa.array(add(b.count[b.t] > 0, np.int64)), pa.array(add(base)), pa.array(add(each))], schema=schema)


def bigram_rows(table: DataFrame) -> DataFrame:
    """(context, word, count) of a stored bigram table: words by their numbers in the word table, -2 for a text's begin.
    Bigrams that occur in held-out documents only have count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b["grams"].to_pylist():
                step, _, grams, word, count, _ = unpack(packed)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.cumsum(step), grams)), pa.array(word), pa.array(count)], ["context", "word", "count"])

    return table.where("grams is not null").select("grams").mapInArrow(run, "context long, word long, count long")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, spread_over: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """One row a document: id, held_out, n_tokens (words and one end), n_known (seen in training), train_tokens,
    base_score (add-0.1 unigram), score (log10 probability by the Katz model).

    held_out: condition on docs' columns; null counts as false. The model learns from all other rows. Null and empty
    texts are a lone end. Null ids and repeated rows are kept, each scored, and repeated rows count as often as they
    stand. Texts of any length are scored whole. Without training documents every word is of the unseen class, whose
    probability is 1. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    blocks = stored(_blocks(docs, held_out, id_col, text_col, block), "blocks")
    most = max(partitions(spark), -(-int(blocks.agg(F.sum("n")).first()[0] or 0) // bucket))
    sent = blocks.select("block", "sizes", "vocabulary", "tokens").mapInArrow(lambda b: _send_words(b, most), "bucket long, block long, words binary")
    told = stored(sent.groupBy("bucket").applyInArrow(lambda t: _merge_words(t, most), "bucket long, block long, words binary, stats array<long>"), "words")
    stats = told.where("stats is not null").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(K + 4)]).first()
    *n, distinct, total, begins = (int(x or 0) for x in stats)
    words = Words(total, [0, *n], discounts([0, *n]))
    own = blocks.select("block", "sizes", "vocabulary", "tokens").groupBy("block")
    asked = own.cogroup(told.select("bucket", "block", "words").groupBy("block")).applyInArrow(lambda b, w: _request(b, w, most, most, spread_over, begins), "bucket long, block long, grams binary")
    bigrams = stored(asked.groupBy("bucket").applyInArrow(lambda t: _merge(t, words, spread_over), _TABLE), "bigrams")
    n2 = [int(x or 0) for x in bigrams.agg(*[F.sum(F.get("n", F.lit(r))) for r in range(K + 2)]).first()]
    d = discounts(n2)

    weight = F.array(*[F.lit(float(r * d[r])) for r in range(K + 1)])
    table = bigrams.where("grams is not null")
    spread = table.select("bucket", F.inline("hot"))
    used = F.aggregate(F.zip_with("m", weight, lambda m, x: m * x), F.lit(0.0), lambda s, x: s + x) + F.col("many")
    few = F.aggregate(F.slice("m", 2, K), F.lit(0).cast("long"), lambda s, x: s + x)
    totals = spread.groupBy("ctx").agg(F.sum(used).alias("used"), F.sum(few).alias("few"), F.max("ctx_count").alias("ctx_count"), F.sum("q").alias("q"))
    left = F.when(F.col("few") == 0, -1 / (F.col("ctx_count") + 1)).otherwise(1 - F.col("used") / F.col("ctx_count"))
    hot = spread.select("bucket", "ctx").join(totals.select("ctx", (left / F.greatest(1 - F.col("q"), F.lit(float(words.unseen)))).alias("back")), "ctx")
    hot = hot.groupBy("bucket").agg(F.collect_list(F.struct("ctx", "back")).alias("back"))  # contexts of one bucket

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                back = _backs(r, words, d, spread_over)[2].view(np.int64)
                packed = [pack(back[np.cumsum(unpack(x)[0])]) for x in r["needs"]]
                yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]] * len(packed), pa.int64()), pa.array(r["blocks"], pa.int64()), pa.array(packed, pa.binary())], ["bucket", "block", "backs"])

    backs = table.select("bucket", "grams", "blocks", "needs").join(hot, "bucket", "left").mapInArrow(answer, "bucket long, block long, backs binary")
    none = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    got = told.select("bucket", "block", "words", *none("counts", "backs")).unionByName(
        bigrams.where("counts is not null").select("bucket", "block", "counts", *none("words", "backs"))
    ).unionByName(backs.select("bucket", "block", "backs", *none("words", "counts")))
    arrow, sizes = _arrow(kind), (most, most, spread_over)
    scores = blocks.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(
        lambda b, g: _score(b, g, words, d, total, distinct, begins, sizes, arrow), f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scores.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
