"""The pipeline's stages on a small table of documents, each against a brute-force version over what it got."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_operators import WORD, brute_budgets, brute_counts, brute_lines, brute_posterior, key, lower, rows

import corpus_pipeline
from chronopanel.llm import byte_bpe, quality, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "id int, component string, key string, row int, __id int, __mark string, __row string, __gone int, kept boolean, epoch int, before string, digest string, u int, fp string"
EXTRA = (1, "a", "b", 2, 3, "c", "d", 4, True, 5, "e", "f", 6, "g")


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in odd_rows], f"{COLUMNS}, {CLASHES}").repartition(3)


def brute_quality(spark, docs):
    votes = {r[0]: tuple(map(int, r[1].split(","))) for r in quality.judge(docs.select("text").distinct(), id_col="text").select("id", "votes").collect()}
    mine = rows(docs)
    failed = [(c := brute_counts(r[1]))[0] < 20 or 100 * c[4] > 30 * c[0] for r in mine]
    good = brute_posterior([votes[r[1]] for r in mine], failed)
    return [r for r, f, p in zip(mine, failed, good, strict=True) if not f and p >= 0.5]


def brute_near(spark, docs):
    mine = sorted(set(rows(docs)), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORD.findall(lower(r[1]))) else set() for r in mine]
    root = list(range(len(mine)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [r for i, r in enumerate(mine) if find(i) == i]


def brute_mixture(spark, docs):
    mine, leaves = rows(docs), {}
    leaf = lambda r: ("crawl" if r[3] == "src0" else "curated", r[2] or "", r[3] or "")
    n = [len(WORD.findall(r[1] or "")) for r in mine]
    for r, k in zip(mine, n, strict=True):
        leaves[leaf(r)] = leaves.get(leaf(r), 0) + k
    w = lambda level, name: queries.MIX_WEIGHTS[level].get(name, 1.0)
    supply = lambda p: sum(k for x, k in leaves.items() if x[: len(p)] == p)
    budget = {}
    for d, bd in brute_budgets({d: (w("domain", d), supply((d,))) for d in {x[0] for x in leaves}}, sum(n) * corpus_pipeline.MIX_FRACTION).items():
        for lang, bl in brute_budgets({x[1]: (w("lang", x[1]), supply((d, x[1]))) for x in leaves if x[0] == d}, bd).items():
            for s, b in brute_budgets({x[2]: (w("source", x[2]), k) for x, k in leaves.items() if x[:2] == (d, lang)}, bl).items():
                budget[d, lang, s] = b
    out, used = [], Counter()
    digest = lambda i: hashlib.md5(f"{queries.MIX_SEED}:1:{'' if i is None else i}".encode()).hexdigest()
    for r, k in sorted(zip(mine, n, strict=True), key=lambda x: digest(x[0][0])):
        if used[leaf(r)] < budget[leaf(r)] - 1e-9:
            out.append(r)
        used[leaf(r)] += k
    return out


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    brute = {
        "quality_rules": brute_quality,
        "line_dedup": lambda _, d: [(r[0], t, *r[2:]) for r, t in zip(rows(d), brute_lines([r[:2] for r in rows(d)]), strict=True) if t],
        "simhash_near_dedup": brute_near, "mixing": brute_mixture,
    }
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, kept) if name != "quality_rules" else (docs,):  # also on what no stage has cleaned
            after = stage(spark, given, "").cache()
            assert after.columns == docs.columns
            if name == "mixing" and given is docs:
                assert after.count() <= given.count()  # repeated ids have one place in the order
            else:
                assert sorted(rows(after), key=key) == sorted(brute[name](spark, given), key=key), name
        kept = spark.createDataFrame(after.collect(), docs.schema)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe._load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(ids := library.encode_ordinary(r[1])), sha(np.array(ids, "<u4").tobytes()), sha(r[1].encode())) for r in rows(kept)]
    assert sorted(rows(corpus_pipeline.encoded(spark, kept, "")), key=key) == sorted(want, key=key)


def test_empty(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0


def test_lines_of_numbers_stay(spark):
    """Rows of numbers are no templates; numbers within words are, in enough documents."""
    texts = {1: "12 34.5 v6\npage 7 of this text\n2024-01-02", 2: "98  76.5 v4\npage 8 of this text\n2024-01-03", 3: "12 34.5  v6\nall else"}
    make = lambda t: spark.createDataFrame([(i, x, "en", "src1", len(x)) for i, x in t.items()], COLUMNS)
    got = {r[0]: r[1] for r in corpus_pipeline.line_templates(spark, make(texts), "").collect()}
    assert got == {1: texts[1], 2: texts[2], 3: "all else"}
    more = texts | {i: f"{i} {i + 1} {i + 2} {i + 3} {i + 4}\npage {i} of this text" for i in range(4, 24)}
    got = {r[0]: r[1] for r in corpus_pipeline.line_templates(spark, make(more), "").collect()}
    assert got == {1: texts[1], 2: "98  76.5 v4\n2024-01-03", 3: "all else"} | {i: more[i].split("\n")[0] for i in range(4, 24)}
