"""Filter audit, importance resampling and fingerprints against brute force, on small tables with odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, key, lower, rows

from chronopanel.llm import filter_audit, fingerprints, resampling

LABELS = "doc_id long, quality int, toxic int"


def brute_masks(docs):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, _, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and first[t] < i]
        yield i, s or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}


def brute_audit(docs, labels):
    good, toxic = ({i for i, q, x in labels if i is not None and (q if c else x) == 1} for c in (True, False))
    parts = defaultdict(list)
    for i, part, fails in brute_masks(docs):
        parts[part].append((i, fails))
    out = []
    for part, mine in parts.items():
        shapley, got = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [i for i, fails in left if f in fails]
                left = [(i, fails) for i, fails in left if f not in fails]
                shapley[f] += len(gone)
                fail = sum(f in fails for _, fails in mine)
                got.append((order, step, f, len(left), len(gone), fail - len(gone), sum(fails == {f} for _, fails in mine), sum(i in good for i in gone), sum(i in toxic for i in gone)))
        out += [(part, o, s, *rest, shapley[f]) for o, s, f, *rest in got]
    return out


@pytest.fixture(scope="module")
def more(odd_rows):
    rng = np.random.default_rng(5)
    long = [(400 + i, " ".join(f"{c}{rng.integers(0, 900)}" for c in "ab" * 110), "en", f"src{i % 3}") for i in range(12)]
    marked = [(500 + i, x + m, "en", "src1") for i, (_, x, *_) in enumerate(long[:6]) for m in (" A | B",)]
    return [*odd_rows, *long, *marked, (460, long[0][1], "en", "src2"), (461, long[0][1], "de", "src0"), (400, *long[0][1:]), (600, "AB CD EF", "en", None)]


@pytest.fixture(scope="module")
def table(spark, more):
    """With columns whose names clash with the operators' own."""
    rows = [(*r, 1, 2, "p", "d", 3, True, 4, "f") for r in more]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, n int, part string, digest string, mask int, good boolean, place int, fingerprint string").repartition(5)


def test_audit(spark, table, more):
    labels = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i, *_ in more if i is not None and i % 5] + [(400, 0, 1), (401, None, None), (None, 1, 1), (7, 0, 0)]
    got = rows(filter_audit.audit_documents(table, spark.createDataFrame(labels, LABELS), F.col("source")))
    assert sorted(got) == sorted(brute_audit(more, labels))


def test_audit_of_nothing(spark, table):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(table.where("false"), none, F.col("source")).count() == 0
    got = rows(filter_audit.audit_documents(table.where("doc_id = 201"), None, F.col("source")))
    assert len(got) == 600 and {(r[0], r[3] + r[4]) for r in got if r[1][0] == "A" and r[2] == 1} == {("src1", 1)}


def test_potentials_are_shapley_values(spark):
    """Against the mean over all orders, for random counts of three filters."""
    n = np.random.default_rng(2).integers(0, 50, 8).tolist()
    counts = spark.createDataFrame([("p", m, c, 0, 0) for m, c in enumerate(n)], "part string, mask int, n long, good long, toxic long")
    got = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in filter_audit.audit(counts, "XYZ").collect()}
    want = Counter()
    for order in permutations(range(3)):
        for s, f in enumerate(order):
            want["XYZ"[f]] += sum(c for m, c in enumerate(n) if m >> f & 1 and not any(m >> g & 1 for g in order[:s]))
    assert got == dict(want)


def brute_words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_draw(docs, target, percent=25, least=20, buckets=10000, seed=7):
    def features(t):
        w = brute_words(t)
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    s, t = Counter(), Counter()
    for _, x, *_ in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, x, *_ in docs:
        f = features(x)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(x)) >= least))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))[: percent * sum(r[4] for r in out) // 100]
    rest = sorted(out, key=key)
    for r in drawn:
        rest.remove(r)
    return [(*r[:4], n) for n, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in rest]


@pytest.mark.parametrize(("words", "pairs", "stretch"), [(16384, 32768, 250_000), (9, 7, 300), (1, 1, 10)])
def test_resample(spark, table, more, monkeypatch, words, pairs, stretch):
    """The same draw whatever the head holds."""
    frequent = resampling.frequent
    sizes = []

    def few(texts):
        sizes.append(len(head := frequent(texts, words, pairs, stretch)))
        return head

    monkeypatch.setattr(resampling, "frequent", few)
    target = [None, "", more[0][1], "The Of and MIT license é ñ 日本", "the of and"] * 3
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, id int")
    got = rows(resampling.resample(table, benchmark))
    assert sorted(got, key=key) == sorted(brute_draw(more, target), key=key)
    assert sizes[0] <= words + pairs


def test_resample_of_nothing(spark, table):
    some = table.where("doc_id < 40").select("doc_id", "text")
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(some.where("false"), none).count() == 0
    assert sorted(rows(resampling.resample(some, none)), key=key) == sorted(brute_draw(rows(some), []), key=key)


def test_head_finds_what_is_frequent(spark):
    texts = spark.createDataFrame([(b"a b c " * 50,), (b"a b " * 30 + b"x y z " * 3,), (None,), (b"q" * 100 + b" a",)], "text binary").repartition(2)
    head = {(r[0], bytes(r[1])) for r in resampling.frequent(texts, 4, 5, 20)}
    assert {(False, b"a"), (False, b"b"), (True, b"a b")} <= head and (False, b"q" * 100) not in head and len(head) <= 9


def test_places_over_partitions(spark):
    r = spark.createDataFrame([(i % 7, i % 3) for i in range(200)], "score int, id int").repartition(6)
    got = sorted((x["place"], -x["score"], x["id"]) for x in resampling.ranked(resampling.stored(r, "test"), [F.desc("score"), F.asc("id")]).collect())
    assert [g[0] for g in got] == list(range(1, 201)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


# Fingerprints


def brute_hash(text, base):
    return sum((ord(c) + 1) * pow(base, j, fingerprints.MOD) for j, c in enumerate(text)) % fingerprints.MOD


def brute_print(text):
    one, two = (brute_hash(text, b) for b in fingerprints.BASES)
    spans = {text[max(0, i - fingerprints.SPAN) : i] for i in range(1, len(text) + 1)}
    values = set()
    for s in spans:
        x = brute_hash(s, fingerprints.BASES[0]) + (len(s) << 32)
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 32) * 0x94D049BB133111EB % 2**64
        values.add(x >> 32)
    return f"{len(text):08x}{one << 31 | two:016x}" + "".join(f"{v:08x}" for v in sorted(values)[: fingerprints.SKETCH])


def test_fingerprints_of_texts():
    rng = np.random.default_rng(1)
    texts = ["", "a", "ab", "x" * 50, "日本🙂 é" * 9, "\n \t", *["".join(rng.choice(list("abc de\n"), n)) for n in (22, 23, 24, 25, 70, 400, 3000)]]
    for t in texts:
        assert fingerprints.fingerprint(t) == brute_print(t)
    assert len({fingerprints.fingerprint(t) for t in texts}) == len(texts)


def test_blocks_give_what_whole_texts_give(monkeypatch):
    t = "".join(np.random.default_rng(3).choice(list("abcdefg "), 5000))
    whole = fingerprints.fingerprint(t)
    monkeypatch.setattr(fingerprints, "BLOCK", 100)
    assert fingerprints.fingerprint(t) == whole


def test_spans_and_extensions():
    a, b = fingerprints.Prefixed("the cat sat on the mat"), fingerprints.Prefixed("a cat sat on a mat")
    assert a.same(4, b, 2, 10) and not a.same(4, b, 2, 12) and not a.same(20, b, 16, 3) and a.same(0, a, 15, 3)
    assert a.span(0, 4) == a.span(15, 19) and a.extension(b) == 0 and a.extension(b, 4, 2) == 11 and a.extension(b, 3, 1) == 12 and a.back(b) == 4
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y = ("".join(rng.choice(list("ab"), rng.integers(0, 12))) for _ in range(2))
        i, j = int(rng.integers(0, len(x) + 1)), int(rng.integers(0, len(y) + 1))
        n = 0
        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
            n += 1
        assert fingerprints.Prefixed(x).extension(fingerprints.Prefixed(y), i, j) == n


def alike(one, two):
    return fingerprints.likeness(bytes.fromhex(one), bytes.fromhex(two))


def test_likeness():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(500)]
    errors = []
    for _ in range(40):
        x = " ".join(rng.choice(words, 300))
        y = " ".join([*x.split()[: rng.integers(0, 300)], *rng.choice(words, 100)])
        s, t = ({z[max(0, i - fingerprints.SPAN) : i] for i in range(1, len(z) + 1)} for z in (x, y))
        errors.append(alike(fingerprints.fingerprint(x), fingerprints.fingerprint(y)) - 2 * len(s & t) / (len(s) + len(t)))
    assert max(map(abs, errors)) < 0.25 and abs(np.mean(errors)) < 0.03
    f = fingerprints.fingerprint
    assert alike(f(""), f("")) == 1 and alike(f(""), f("a")) == 0 and alike(f("ab"), f("abc")) == pytest.approx(4 / 5)


@pytest.mark.parametrize("parts", [1, 4])
def test_chained(spark, table, more, parts):
    import xxhash

    signed = lambda t: (x := xxhash.xxh64_intdigest(t, 42)) - (x >> 63 << 64)
    order = sorted(((i, t or "") for i, t, *_ in more), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = rows(fingerprints.chained(table))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    f, want = {}, []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        e = t[: len(t) - third] + u[:third]
        a, b, c = (f.setdefault(x, fingerprints.fingerprint(x)) for x in (t, e, u))
        same = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        want.append((i, len(t), a, hashlib.sha256(e.encode()).hexdigest(), b, alike(a, b), alike(a, c), same(t, e), same(t, u)))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_chained_small(table):
    assert fingerprints.chained(table.where("false")).count() == 0
    (r,) = rows(fingerprints.chained(table.where("doc_id = 8")))
    assert r[5] <= 1 and r[6] == 1.0
