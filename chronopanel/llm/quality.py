"""Quality rules as weak supervision.

Each rule looks at a document's counts and votes good, bad, or abstains. Nobody labels anything: expectation-maximisation
over the votes of all documents estimates how often each rule is right about good and about bad documents, and the
share of good ones; a document is kept if its posterior probability of being good is at least one half.

The votes of all documents are summed up as counts of vote patterns, at most 3 to the number of rules of them, so the
estimates cover every document and the driver gets a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored

#: Words of a window whose repeats count.
WINDOW = 8

_SPACE, _SYMBOLS, _ENDS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".!?"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_bangs", "n_ends", "n_distinct", "n_lines"]


def repeated_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each text's words, those in windows of WINDOW words found twice or more in the text, and the distinct words.
    Windows are compared exactly: numbers for words, then for pairs, fours and eights of words."""
    size = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    if not len(doc):
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    number = pd.factorize(np.array([w for t in texts for w in t], object))[0].astype(np.int64)
    distinct = np.bincount(np.unique(doc * (number.max() + 1) + number) // (number.max() + 1), minlength=len(texts))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(doc))  # words from here to the text's end
    first, span = number, 1
    key = doc * (first.max() + 1) + first  # a word of one text is another than that of the next
    first = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while span < WINDOW and len(first):  # fewer words than a window leave nothing to pair
        pair = first[:-span] * (first.max() + 1) + first[span:]
        first = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
    if not len(first):
        return np.zeros(len(texts), np.int64), distinct
    whole = left[: len(first)] >= WINDOW
    times = np.bincount(first[whole], minlength=first.max() + 1)
    hit = np.flatnonzero(whole & (times[first] > 1))
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(edge)[:-1] > 0, minlength=len(texts)).astype(np.int64), distinct


def _counts(texts: list[str | None]) -> list[np.ndarray]:
    plain = [(t or "").encode() for t in texts]
    words = [b.split() for b in plain]
    repeated, distinct = repeated_words(words)
    n = lambda b, chars: len(b) - len(b.translate(None, chars))
    lines = [[x for x in b.split(b"\n") if x.strip()] for b in plain]
    upper, digits = bytes(range(65, 91)), bytes(range(48, 58))
    return [
        np.array(c, np.int64) for c in (
            [len(w) for w in words], [len(t or "") - n(b, _SPACE) for t, b in zip(texts, plain, strict=True)], [n(b, _SYMBOLS) for b in plain],
            [len(x) - len(set(x)) for x in lines], repeated, [n(b, upper) for b in plain], [n(b, digits) for b in plain], [b.count(b"!") for b in plain],
            [n(b, _ENDS) for b in plain], distinct, [len(x) for x in lines],
        )
    ]


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts...) of every row, over whole texts; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part["id"], *map(pa.array, _counts(part["text"].to_pylist()))], ["id", *_COUNTS])

    schema = StructType([StructField("id", docs.schema[id_col].dataType), *[StructField(c, LongType()) for c in _COUNTS]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes: -1 bad, 1 good, 0 abstains. Texts of a few words tell little and leave most rules without a vote."""
    c, per_word = F.col, lambda x: F.try_divide(F.col(x), F.col("n_words"))
    some = c("n_words") >= 20
    return {
        "length": _vote(c("n_words") < 20, c("n_words") >= 50),
        "word_length": _vote(F.try_divide("word_chars", "n_words") > 12, some & F.try_divide("word_chars", "n_words").between(3, 8)),
        "symbols": _vote(some & (per_word("n_symbols") > 0.1), some & (per_word("n_symbols") < 0.01)),
        "repeats": _vote(per_word("n_repeat_words") > 0.3, some & (per_word("n_repeat_words") < 0.05)),
        "dup_lines": _vote((c("n_lines") >= 4) & (F.try_divide("n_dup_lines", "n_lines") > 0.3), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)),
        "upper": _vote(F.try_divide("n_upper", "word_chars") > 0.4, some & (F.try_divide("n_upper", "word_chars") < 0.15)),
        "bangs": _vote(some & (per_word("n_bangs") > 0.2), some & (per_word("n_bangs") < 0.02)),
        "sentences": _vote(some & (per_word("n_ends") > 0.9), some & per_word("n_ends").between(0.005, 0.5)),
        "variety": _vote((c("n_words") >= 50) & (F.try_divide("n_distinct", F.sqrt("n_words")) < 1.5), (c("n_words") >= 50) & (F.try_divide("n_distinct", F.sqrt("n_words")) > 3)),
    }


def fit_votes(votes: np.ndarray, times: np.ndarray, rounds: int = 500, start: float = 0.9, trust: float = 0.8) -> tuple[float, np.ndarray]:
    """(share of good documents, accuracies [rule, (on bad, on good)]).

    votes: patterns x rules in -1, 0, 1; times: documents of each pattern. Abstaining tells nothing. At the start a
    document with any bad vote is bad with probability start, any other good. The two accuracies of a rule are its own:
    most faults show to one rule only, so on bad documents a rule may well be wrong most of the time, and its good votes
    then say little, while its bad ones say much if they are rare on good documents. A bad vote is never taken as likelier
    on good documents than on bad ones, which keeps the classes from changing places; one vote's worth of trust stays in
    as a prior, so no probability becomes 0 or 1."""
    bad = np.where((votes == -1).any(axis=1), start, 1 - start)
    right = np.full((votes.shape[1], 2), trust)
    good = 0.5
    for _ in range(rounds):
        weight = np.stack([times * bad, times * (1 - bad)])
        good = (weight[1].sum() + 1) / (times.sum() + 2)
        hits = np.stack([weight[0] @ (votes == -1), weight[1] @ (votes == 1)], axis=1)
        new = np.clip((hits + trust) / ((weight @ (votes != 0)).T + 1), 0.001, 0.999)
        new[:, 0] = np.maximum(new[:, 0], 1 - new[:, 1])
        bad = 1 - posterior(votes, good, new)
        if np.abs(new - right).max() < 1e-9:
            break
        right = new
    return float(good), right


def posterior(votes: np.ndarray, good: float, right: np.ndarray) -> np.ndarray:
    """Probability of good for each row of votes; right: [rule, (on bad, on good)] accuracies."""
    like = [np.log(1 - good) * np.ones(len(votes)), np.log(good) * np.ones(len(votes))]
    for r in range(votes.shape[1]):
        v = votes[:, r]
        like[0] += np.where(v == -1, np.log(right[r, 0]), np.where(v == 1, np.log(1 - right[r, 0]), 0))
        like[1] += np.where(v == 1, np.log(right[r, 1]), np.where(v == -1, np.log(1 - right[r, 1]), 0))
    return 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, store: bool = True) -> DataFrame:
    """(id, counts..., votes, posterior, base_failed, kept) of every row.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows; such rows are never kept, and
    accuracies are estimated from all the others, so that the bad class is not just what the base check finds anyway. Null
    and empty texts have counts 0 and fail so. Null ids and repeated rows are kept as they are; equal texts get equal
    results. An empty table gives an empty result. Without store the counts are worked out once for the estimates and
    again for the result, and nothing is written: for ids that are whole rows.
    """
    spark = docs.sparkSession
    cast = rules()
    counts = document_counts(docs, id_col, text_col).withColumn("votes", F.concat_ws(",", *[v.cast("string") for v in cast.values()]))
    counts = stored(counts, "quality") if store else counts
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    patterns = counts.groupBy("votes").agg(F.count_if(~failed)).collect()  # at most 3 ** len(cast) rows
    votes = np.array([[int(v) for v in p[0].split(",")] for p in patterns], np.int64).reshape(-1, len(cast))
    good, right = fit_votes(votes, np.array([p[1] for p in patterns], np.float64)) if patterns else (0.5, None)
    known = spark.createDataFrame([(p[0], float(x)) for p, x in zip(patterns, posterior(votes, good, right) if patterns else [], strict=True)], "votes string, posterior double")
    return counts.join(F.broadcast(known), "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= threshold))
