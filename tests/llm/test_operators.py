"""The corpus operators against brute force, on small tables with odd rows."""

import base64
import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chronopanel.llm import byte_bpe, common, katz, license_scan, line_dedup, mixing, quality, queries, simhash, token_counts, topk, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1", "http://www.example.org/en/1?x", "http://example.org/en/2", "http://xexample.org/es/1", "ftp://a.com/fr/#/", "http://com/de/", "http://a.com", "x://y.org?p=://com/fr/", "http://a.b.com/de/\n", "http://org/", "http://.org/", "http://a.org./"]
    pages = [(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.org/", None), (4, urls[4], "h")] + [(1000 + i, "http://hot.example.org/es/", "") for i in range(300)]
    rules = [*url_filter.RULES, ("hot.example.org/es/", "allow"), ("hot.example.org/es/", "block"), (None, "block"), ("", "block"), ("a.com", "block")]
    got = rows(url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(rules, "rule string, action string")))
    want = []
    for i, u, _ in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = []
        for r, a in rules:
            if r:
                h, slash, p = r.partition("/")
                if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                    fits.append((len(r), r, a))
        best = max(fits, default=(0, None, "allow"))
        want.append((i, host, path, best[1], best[2]))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(rules, "rule string, action string")).count() == 0


def test_url_filter_many_rules(spark, monkeypatch):
    """Several ranges of rules, with rules that are open over more than one of them."""
    monkeypatch.setattr(url_filter, "RANGE_RULES", 7)
    hosts = [f"h{i}.example.org" for i in range(30)]
    rules = [("org/", "allow"), ("example.org/a", "block"), *[(h + "/a", "allow") for h in hosts], *[(f"h7.example.org/a{i}/", "block") for i in range(20)]]
    pages = [(i, f"http://{p}{h}/a{i % 25}/x") for i, h in enumerate(hosts * 4) for p in ("", "www.")]
    got = {r[0]: r for r in rows(url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "rule string, action string")))}
    for i, u in pages:
        host, path = u[7:].split("/", 1)
        fits = [(len(r), r) for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and ("/" + path).startswith("/" + r.split("/", 1)[1])]
        assert got[i][3] == max(fits)[1]


def test_token_counts(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    cache = token_counts.new_cache(spark)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, *_ in odd_rows), key=key)
    assert sorted(rows(token_counts.cached_counts(odd, path, cache)), key=key) == want
    cached = spark.read.parquet(cache)
    n = cached.count()
    assert n == cached.dropDuplicates().count() == len({t or "" for _, t, *_ in odd_rows})
    assert sorted(rows(token_counts.cached_counts(odd, path, cache)), key=key) == want  # all from the cache
    assert spark.read.parquet(cache).count() == n
    assert token_counts.cached_counts(empty, path, token_counts.new_cache(spark)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_pieces(name, odd_rows):
    path = P.path(name)
    texts = [t or "" for _, t, *_ in odd_rows if len(t or "") < 10000] + ["a  b", " x", "x \n y", "<|endoftext|> <|endoftext|>x", "a\u00a0 b\u3000 c", "don't 've 12 3,4 ,,", "\n\nA\n b"]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        from tokenizers import Tokenizer

        want = [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_tokens(texts, path) == want


def brute_fingerprint(text, words):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize(("words", "distance", "segments", "reach", "equal"), [(4, 4, 10, 4, 3), (5, 7, 16, 6, 4)])
def test_simhash(odd, odd_rows, empty, monkeypatch, words, distance, segments, reach, equal):
    if distance == 4:
        monkeypatch.setattr(simhash, "CELL", 3)  # so that keys are crowded
    got = rows(simhash.near_duplicates(odd, words, distance, segments, reach, equal))
    marks = [(i, brute_fingerprint(t, words)) for i, t, *_ in odd_rows]
    root = list(range(len(marks)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(marks):
        least[find(i)].append(d)
    want = [(d, fp, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, fp) in enumerate(marks)]
    assert sorted(((i, fp & (1 << 64) - 1, c) for i, fp, c in got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40).tolist()
    marks = sorted({s ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for s in seeds for _ in range(12)})
    for distance, segments, reach, equal in ((4, 10, 4, 3), (7, 16, 6, 4)):
        edges = simhash.links(spark.createDataFrame([(m,) for m in marks], "fp long"), distance, segments, simhash.key_sets(distance, segments, reach, equal)).collect()
        root = {m: m for m in marks}
        find = lambda i: i if root[i] == i else find(root[i])
        for u, v in edges:
            root[find(u)] = find(v)
        label = {m: find(m) for m in marks}
        root = {m: m for m in marks}
        for i, a in enumerate(marks):
            for b in marks[:i]:
                if (a ^ b).bit_count() <= distance:
                    root[find(a)] = find(b)
        assert len({(label[m], find(m)) for m in marks}) == len(set(label.values())) == len({find(m) for m in marks})


@pytest.mark.parametrize("distance", [2, 3])
def test_crowded_fingerprints(spark, distance):
    rng = np.random.default_rng(distance)
    seeds = rng.integers(0, 2**62, 12).tolist()
    marks = sorted({s ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(12)})
    root = {m: m for m in marks}
    find = lambda i: i if root[i] == i else find(root[i])
    edges = simhash.crowd_links(spark.createDataFrame([(m,) for m in marks], "fp long"), distance).collect()
    for u, v in edges:
        assert u > v
        root[find(u)] = find(v)
    label = {m: find(m) for m in marks}
    root = {m: m for m in marks}
    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    assert len({(label[m], find(m)) for m in marks}) == len(set(label.values())) == len({find(m) for m in marks}) < len(marks)


def test_keys_take_more_segments_with_more_points():
    sizes = [len(simhash.choose_keys(4, 10, n)[0]) for n in (100, 10**7, 10**9, 10**10)]
    assert sizes == [3, 3, 4, 5]


@pytest.mark.parametrize("heavy", [0, 50])
def test_near_duplicates_by_jaccard(spark, odd, odd_rows, empty, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "CELL", 5)  # so that keys are cut into cells
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng, texts = np.random.default_rng(4), [t for _, t, *_ in odd_rows]
    for _ in range(30):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for edits in (0, 1, 2, 3, 4, 5, 6):
            v = list(w)
            for at in rng.choice(200, edits, replace=False):
                v[at] = "new"
            texts.append(" ".join(v))
    ids = [r[0] for r in odd_rows] + list(range(1000, 1000 + len(texts) - len(odd_rows)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    beyond = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                root[find(i)] = find(j)
                beyond += (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count() > 7
    assert beyond > 50  # pairs that fingerprints miss
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    want = [(d, min((x for x in least[find(i)] if x is not None), default=None)) for i, d in enumerate(ids)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = rows(simhash.near_duplicates(docs, **corpus_pipeline.NEAR).select("id", "component"))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty, **corpus_pipeline.NEAR).count() == 0


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeat = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat)


def brute_posterior(every, failed, rounds=500):
    """Posterior probabilities of good, a vote pattern a document, by EM over the documents one by one."""
    votes = [v for v, f in zip(every, failed, strict=True) if not f]
    of = lambda v, good, acc: (good * prod(v, acc, 1)) / (good * prod(v, acc, 1) + (1 - good) * prod(v, acc, 0))

    def prod(v, acc, side):
        out = 1.0
        for x, (on_bad, on_good) in zip(v, acc, strict=True):
            out *= ({1: on_good, -1: 1 - on_good} if side else {-1: on_bad, 1: 1 - on_bad}).get(x, 1.0)
        return out

    bad = [0.9 if -1 in v else 0.1 for v in votes]
    acc = [[0.8, 0.8] for _ in votes[0]]
    for _ in range(rounds):
        good = (sum(1 - b for b in bad) + 1) / (len(votes) + 2)
        new = []
        for r in range(len(votes[0])):
            on_bad = (sum(b for b, v in zip(bad, votes, strict=True) if v[r] == -1) + 0.8) / (sum(b for b, v in zip(bad, votes, strict=True) if v[r]) + 1)
            on_good = (sum(1 - b for b, v in zip(bad, votes, strict=True) if v[r] == 1) + 0.8) / (sum(1 - b for b, v in zip(bad, votes, strict=True) if v[r]) + 1)
            on_bad, on_good = min(max(on_bad, 0.001), 0.999), min(max(on_good, 0.001), 0.999)
            new.append([max(on_bad, 1 - on_good), on_good])
        bad = [1 - of(v, good, new) for v in votes]
        if max(abs(x - y) for m, n in zip(new, acc, strict=True) for x, y in zip(m, n, strict=True)) < 1e-9:
            break
        acc = new
    return [of(v, good, new) for v in every]


def test_quality(odd, odd_rows, empty):
    got = rows(quality.judge(odd).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes"))
    want = [(i, *(c := brute_counts(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t, *_ in odd_rows]
    assert sorted((r[:7] for r in got), key=key) == sorted(want, key=key)
    votes = [tuple(map(int, r[9].split(","))) for r in got]
    for r, p in zip(got, brute_posterior(votes, [r[6] for r in got]), strict=True):
        assert abs(r[8] - p) < 1e-6 and r[7] == (not r[6] and p >= 0.5)
    for r, v in zip(got, votes, strict=True):  # the rules, from the counts above
        n, symbols, repeats = r[1], r[3], r[5]
        named = dict(zip(quality.rules(), v, strict=True))
        assert named["length"] == (-1 if n < 20 else 1 if n >= 50 else 0)
        assert named["symbols"] == (0 if n < 20 else -1 if symbols > 0.1 * n else 1 if symbols < 0.01 * n else 0)
        assert named["repeats"] == (-1 if n and repeats > 0.3 * n else 1 if n >= 20 and repeats < 0.05 * n else 0)
    assert quality.judge(empty).count() == 0


@pytest.mark.parametrize("n", range(10))
def test_quality_of_a_few_words(spark, n):
    assert [x.tolist() for x in quality.repeated_words([[b"hi"] * n])] == [[9 if n == 9 else 0], [min(n, 1)]]
    if n in (1, 9):
        got = rows(quality.judge(spark.createDataFrame([(1, "hi " * n)], "doc_id long, text string")).select("n_words", "n_repeat_words", "base_failed", "kept"))
        assert got == [(n, 9 if n == 9 else 0, True, False)]


def test_votes_recover_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.85])
    votes = np.where((rng.random((20000, 4)) < right) == truth[:, None], 1, -1) * (rng.random((20000, 4)) < 0.8)
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    good, found = quality.fit_votes(patterns, times.astype(float))
    assert abs(good - 0.7) < 0.03 and np.abs(found - right[:, None]).max() < 0.04
    assert ((quality.posterior(votes, good, found) > 0.5) == truth).mean() > 0.85


def brute_topk(vectors, k=20):
    sound = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    width = max((len(v) for _, v in sound), default=0)
    sound = [(i, tuple(np.pad(v, (0, width - len(v))).tolist())) for i, v in sound]
    want = defaultdict(list)
    for i, v in {x for x in sound if x[0] % 20 == 0}:
        want[i] += [(-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in sound if j != i]
    return sorted((q, r + 1, i, -s) for q, found in want.items() for r, (s, i) in enumerate(sorted(found)[:k]))


def test_topk(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(150)]
    vectors += [(200 + i, vectors[7][1]) for i in range(40)] + [(500, None), (501, [1.0, None, 2.0, 3.0]), (502, [float("nan"), 1.0, 1.0, 1.0]), (503, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (7, vectors[7][1])]
    vectors += [vectors[3], vectors[3], vectors[20], vectors[20], (40, [9.0, 9.0, -9.0, 1.0]), (511, [3.0, 1.0]), (512, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in vectors], "vec_id long, embedding array<double>, id int, query string, score double")
    for block, slices in ((16, 2), (16, 3), (1024, 2)):
        assert sorted(rows(topk.top_k(df, F.col("id") % 20 == 0, block=block, slices=slices))) == brute_topk(vectors)
    apart = [(i, [5.0, -4.0] if i % 2 else [-4.0, 5.0]) for i in range(1, 60)] + [(0, [1.0, 1.0]), (60, [2.0, 2.0])]  # no pair reaches both shares
    assert sorted(rows(topk.top_k(spark.createDataFrame(apart, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, block=8))) == brute_topk(apart)
    longer = [(i, [1.0 + i, 2.0]) for i in range(40)] + [(50, [1.0, 1.0, 1.0])]
    assert sorted(rows(topk.top_k(spark.createDataFrame(longer, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0))) == brute_topk(longer)
    assert topk.top_k(df.where("vec_id < 3"), F.col("id") % 20 == 0).count() == 2
    assert topk.top_k(df.where("false"), F.col("id") % 20 == 0).count() == 0


def test_topk_moves_less_than_a_few_times_its_input(spark, tmp_path, monkeypatch):
    """Blocks of both sides are many; what is shuffled and stored must not grow with their product."""
    n, width, rng = 2400, 32, np.random.default_rng(1)
    drawn = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, width)) / 5)]
    df = spark.createDataFrame(drawn, "vec_id long, embedding array<double>").repartition(2)
    written = lambda: int(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite())
    monkeypatch.setattr(topk, "forget", lambda *_: None)
    monkeypatch.setattr(common, "work_dir", lambda _: str(tmp_path))
    df = df.localCheckpoint()
    time.sleep(1)  # for the listener that adds up
    before = written()
    got = sorted(rows(topk.top_k(df, F.col("id") % 20 == 0, block=64)))
    time.sleep(1)
    assert got == brute_topk(drawn)
    assert written() - before + sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 4 * n * width * 4


SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licenses(text):
    """(labels, score) by comparing every block with every template of its width."""
    w, labels, score = SPLIT.findall(lower(text)), set(), 0.0
    for (label, template), width in zip(license_scan.TEMPLATES, license_scan.widths(license_scan.TEMPLATES), strict=True):
        s = set(SPLIT.findall(lower(template)))
        blocks = [w[at : at + width] for at in range(0, max(1, len(w) - width // 2), width // 2)]
        if width == license_scan.LEAST:
            blocks += [x for line in (text or "").split("\n") if len(x := SPLIT.findall(lower(line))) <= width]
        best = max((len(s & set(x)) / len(s) for x in blocks), default=0)
        if best >= 0.8:
            labels.add(label)
            score = max(score, best)
    return labels, score


def test_license_scan(spark, odd, odd_rows, empty):
    def want_of(i, t):
        w = SPLIT.findall(lower(t))
        found = [(k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels, score = brute_licenses(t)
        base = {x for _, x in found}
        return (i, len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), sorted(base), sorted(base | labels), 1.0 if found else score)

    assert sorted(rows(license_scan.scan(odd)), key=key) == sorted((want_of(i, t) for i, t, *_ in odd_rows), key=key)
    assert license_scan.scan(empty).count() == 0
    rng, texts = np.random.default_rng(6), []
    for _, template in license_scan.TEMPLATES:  # whole and cut down, inside of other words and of parts of other templates
        for part in (1.0, 0.85, 0.7):
            w = template.split()
            w = [x for x in w if rng.random() < part] if part < 1 else w
            others = " ".join(t for _, t in license_scan.TEMPLATES).split()
            texts.append(" ".join([*(others[int(x)] for x in rng.integers(0, len(others), int(rng.integers(0, 90)))), *w, *(f"x{x}" for x in rng.integers(0, 1000, int(rng.integers(0, 300))))]).replace(". ", ".\n"))
    got = rows(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert sorted(got, key=key) == sorted((want_of(i, t) for i, t in enumerate(texts)), key=key)


def test_license_scan_of_wrapped_notices(spark):
    rng = np.random.default_rng(5)
    docs = []
    for label, text in license_scan.TEMPLATES:
        for width in (1, 2, 5, 9):
            around = [[f"x{x}" for x in rng.integers(0, 1000, n)] for n in rng.integers(0, 100, 2)]
            w = [*around[0], *text.split(), *around[1]]
            docs.append((label, "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))))
    got = rows(license_scan.scan(spark.createDataFrame(docs, "doc_id string, text string")).select("id", "labels", "score"))
    assert len(got) == len(docs) and all(i in labels and score == 1 for i, labels, score in got)


def test_byte_bpe(odd, odd_rows, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(byte_bpe.round_trip(odd, path, P.PATTERN))
    assert all(bytes(text).decode() in {t or "" for _, t, *_ in odd_rows} for _, _, text in got)
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in odd_rows]
    assert sorted(((i, bytes(a), bytes(b)) for i, a, b in got), key=key) == sorted(want, key=key)
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0
    digests = {r[0]: r for r in rows(queries.bpe_digests(odd))}
    assert digests[300][2] == hashlib.sha256(next(w[1] for w in want if w[0] == 300)).hexdigest()


def test_katz(spark, odd, odd_rows, empty):
    held = lambda i: i is not None and i % 5 == 0
    docs = [(i, [*WORD.findall(lower(t)), None], held(i)) for i, t, *_ in odd_rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for _, w, h in docs:
        if not h:
            uni.update(w)
            for a, b in zip(["<s>", *w], w):
                bi[a, b] += 1
                ctx[a] += 1
    total = sum(uni.values())
    d1 = katz.discounts([0, *[sum(c == r for c in uni.values()) for r in range(1, 7)]])
    d2 = katz.discounts([0, *[sum(c == r for c in bi.values()) for r in range(1, 7)]])
    cut = lambda d, c: (d[c] if c <= 5 else 1.0) * c
    unseen = 1 - sum(cut(d1, c) for c in uni.values()) / total
    p1 = lambda w: cut(d1, uni[w]) / total if uni[w] else unseen
    after = defaultdict(list)
    for (a, b), c in bi.items():
        after[a].append((b, c))

    def back(a):
        return (1 - sum(cut(d2, c) for _, c in after[a]) / ctx[a]) / (1 - sum(p1(b) for b, _ in after[a])) if ctx[a] else 1.0

    def p2(a, b):
        return cut(d2, bi[a, b]) / ctx[a] if bi[a, b] else back(a) * p1(b)

    for a in list(ctx)[:20]:  # normalised exactly, with one class of unseen words
        assert abs(sum(p2(a, b) for b in uni) + back(a) * unseen - 1) < 1e-9
    want = sorted(
        ((i, h, len(w), sum(uni[x] > 0 for x in w), total, sum(np.log10((uni[x] + 0.1) / (total + 0.1 * (len(uni) + 1))) for x in w), sum(np.log10(p2(a, b)) for a, b in zip(["<s>", *w], w))) for i, w, h in docs),
        key=lambda r: key(r[:4]) + (round(r[5], 3),),
    )
    got = sorted(rows(katz.score(odd, F.col("doc_id") % 5 == 0, block=200, spread_over=30, bucket=300)), key=lambda r: key(r[:4]) + (round(r[5], 3),))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert katz.score(empty, F.lit(False)).count() == 0
    assert rows(katz.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).select("n_tokens", "n_known", "score")) == [(3, 0, 0.0)]


def test_katz_of_contexts_without_a_discount_is_finite_and_normalised(spark):
    """A context whose followers all occur more than K times keeps no mass by Good-Turing."""
    trained = [(i, "alpha beta gamma") for i in range(9)] + [(100 + i, f"delta {w}") for i, w in enumerate("pqrstu")] + [(300 + i, "delta " * (2 + i)) for i in range(3)]
    asked = ["alpha", "alpha beta gamma", *(f"alpha {w}" for w in ("alpha", "gamma", "delta", *"pqrstu", "never")), "beta never"]
    docs = trained + [(1000 + i, t) for i, t in enumerate(asked)]
    alone = [(i, "alpha beta") for i in range(8)] + [(1000, "alpha beta"), (1001, "beta alpha"), (1002, "never"), (1003, "alpha never")]
    for spread_over in (3, 100_000):
        score = lambda d: {r["id"]: r for r in katz.score(spark.createDataFrame(d, "doc_id long, text string"), F.col("doc_id") >= 1000, block=20, spread_over=spread_over, bucket=10).collect()}  # noqa: B023, E731
        got = score(docs)
        assert all(np.isfinite(r["score"]) for r in got.values())
        uni = Counter(w for _, t in trained for w in [*t.split(), None])
        d1 = katz.discounts([0, *[sum(c == r for c in uni.values()) for r in range(1, 7)]])
        p1 = {w: (d1[c] if c <= 5 else 1.0) * c / sum(uni.values()) for w, c in uni.items()}
        rest = 1 - p1["beta"]
        # begin alpha: 9 of 18; alpha beta, beta gamma, gamma end: 9 of 10, and a tenth for all others by their share.
        begin = got[1001]["score"] - 3 * np.log10(0.9)
        assert np.isclose(got[1000]["score"], begin + np.log10(0.1 * p1[None] / rest))
        never = got[1000 + asked.index("alpha never")]["score"]
        assert np.isclose(never, begin + np.log10(0.1 * (1 - sum(p1.values())) / rest) + np.log10(p1[None]))
        finite = score(alone)  # every word is over K too
        total = 24
        assert all(np.isfinite(r["score"]) for r in finite.values())
        assert np.isclose(finite[1000]["score"], 3 * np.log10(8 / 9))
        assert np.isclose(finite[1002]["score"], np.log10(1 / 9 * (1 / (total + 1)) / (1 - 8 / (total + 1))) + np.log10(8 / (total + 1)))


def brute_lines(docs):
    """docs: (id, text); their texts without recurring lines."""

    def paths(line):
        w = WORD.findall(line)
        if not w:
            return []
        m = ["<*>" if re.search("[0-9]", x) or (k and "A" <= x[0] <= "Z") else x for k, x in enumerate(w)]
        n, f = len(w), " ".join(m).count("<*>")
        out = [(-1, *w)]
        if n >= 5 and f and 5 * (n - f) >= 3 * n:
            out.append((-2, *m))
        if n >= 5 and 5 * (n - f - -(-n // 4)) >= 3 * n:
            out += [(s, *m[: n * s // 4], None, *m[n * (s + 1) // 4 :]) for s in range(4)]
        return out

    order = lambda i: (i is not None, i)
    kind = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:2], 16) % 64
    where, contents = defaultdict(set), defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            for p in paths(x):
                where[p].add(order(i))
                contents[p].add(kind(" ".join(WORD.findall(x))))
    recurs = {p for p, ids in where.items() if (len(ids) > 1 if p[0] == -1 else len({kind("" if i is None else str(i)) for _, i in ids}) >= 8 and len(contents[p]) >= 8)}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if all(min(where[p]) == order(i) for p in recurs.intersection(paths(x)))]
        out.append(t if t is None or len(stay) == len(lines) else "\n".join(stay) if any(WORD.search(x) for x in stay) else "")
    return out


def test_line_dedup(spark, odd, odd_rows, empty):
    got = rows(line_dedup.drop_recurring_lines(odd.withColumns({"__id": F.lit(1), "__row": F.lit("x"), "__path": F.lit(2)})).select("doc_id", "text", "lang", "source"))
    want = [(i, new, lang, source) for (i, _, lang, source), new in zip(odd_rows, brute_lines([r[:2] for r in odd_rows]), strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert line_dedup.drop_recurring_lines(empty).count() == 0


def test_line_dedup_generalises_fields(spark):
    """Templates take many contents in many documents; lines that are merely alike stay, equal ones recur in two."""
    names = ["Anna", "Boris", "Carla", "Dmitri", "Emil", "Fatima", "Greta", "Hugo", "Ines", "Jonas", "Kira", "Levi", "Mona", "Nils"]
    docs = [(i, f"own words of number {x}\nPosted by {x} in {y}\nuser {x.lower()} logged in ok") for i, (x, y) in enumerate(zip(names, names[5:] + names[:5], strict=True))]
    few = ["the drug is safe for children", "the drug is unsafe for children", "Prices rose by two percent", "Prices rose by ten points", "in 1999 it was 40 million", "in 2001 it was 50 million", "one two", "one two", "a b c d e f", "a  b\tc d e f"]
    docs += [(100 + i, f"{x}\nall else in {i}") for i, x in enumerate(few)]
    got = {r[0]: r[1] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: t for (i, _), t in zip(docs, brute_lines(docs), strict=True)}
    assert got[0] == docs[0][1] and all("Posted" not in got[i] and "logged" not in got[i] for i in range(1, 14))
    assert all(few[i] in got[100 + i] for i in range(7)) and few[7] not in got[107] and few[8] in got[108] and "\t" not in got[109]


def brute_budgets(children, total):
    """children: name -> (weight, supply). Shares by repeated redistribution."""
    out, open_ = dict.fromkeys(children, 0.0), dict(children)
    left = min(total, sum(s for _, s in children.values()))
    while open_ and left > 1e-12:
        w = sum(x for x, _ in open_.values())
        full = {k for k, (x, s) in open_.items() if s <= left * x / w + 1e-12}
        for k in full or open_:
            out[k] = open_[k][1] if full else left * open_[k][0] / w
        if not full:
            break
        left -= sum(open_[k][1] for k in full)
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def test_mixing_without_a_source(spark):
    """Weight 0 leaves a name out, at any level; a name of its own weight gets what is left."""
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)], "doc_id long, text string, lang string, source string")
    got = rows(mixing.mix(docs, {"source": {"s1": 0.0}}, 0.5).groupBy("source").count())
    assert sorted(got) == [("s0", 15), ("s2", 15)] or {r[0] for r in got} == {"s0", "s2"}
    assert rows(mixing.mix(docs, {"lang": {"en": 0, "de": 0}}, 0.5)) == []
    assert {r[0] for r in rows(mixing.mix(docs, {"lang": {"en": 0}}, 1.0).select("lang"))} == {"de"}
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(docs, {"lang": {"en": -1}}, 0.5)


def test_mixing_budgets(spark):
    leaves = [("a", "en", "s0", 100), ("a", "en", "s1", 900), ("a", "de", "s0", 50), ("b", "en", "s0", 20), ("b", "fr", "s3", 10), ("c", "en", "s9", 5000), ("c", "en", "s8", 0)]
    weights = {"domain": {"a": 3.0, "b": 2.0}, "lang": {"de": 2.0}, "source": {"s1": 0.5}}
    for total in (0.0, 30.0, 500.0, 2000.0, 1e6):
        got = {tuple(r[:3]): r[4] for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), weights, F.lit(total), 1).select("domain", "lang", "source", "tokens", "budget").collect()}
        want = {}
        supply = lambda p: sum(x[3] for x in leaves if x[: len(p)] == p)
        w = lambda lv, n: weights[lv].get(n, 1.0)
        for d, bd in brute_budgets({d: (w("domain", d), supply((d,))) for d in "abc"}, total).items():
            for lang, bl in brute_budgets({x[1]: (w("lang", x[1]), supply((d, x[1]))) for x in leaves if x[0] == d}, bd).items():
                for s, b in brute_budgets({x[2]: (w("source", x[2]), x[3]) for x in leaves if x[:2] == (d, lang)}, bl).items():
                    want[d, lang, s] = b
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mixing(odd, odd_rows, empty):
    got = rows(mixing.mix(odd, queries.MIX_WEIGHTS, 0.5, 2, 1, keep=["doc_id", "text"]).select("doc_id", "text", "__mix.*"))
    n = Counter((i, t) for i, t, *_ in odd_rows)
    assert all(c <= 2 * n[k] for k, c in Counter((r[0], r[1]) for r in got).items())
    for leaf in {r[2:5] for r in got}:  # a prefix of the seeded order: no gaps
        mine = sorted((r[7], r[6]) for r in got if r[2:5] == leaf)
        at = 0
        for before, tokens in mine:
            assert before == at
            at = before + tokens
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in odd_rows)
    assert sum(r[6] for r in got) >= 0.5 * total
    assert mixing.mix(empty, queries.MIX_WEIGHTS, 0.5).count() == 0
