import random

import pytest

WORDS = ["the", "of", "and", "in", "to", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "his", "but", "at", "are", "this", "have", "from"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.choice(["", "", "x", "y", "ing"])) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, near and exact copies."""
    rng = random.Random(7)
    rows = [(i, "\n".join(sentence(rng, rng.randint(3, 40)) + "." for _ in range(rng.randint(1, 6))), rng.choice(["en", "de"]), f"src{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[3][1], "en", "src0") for i in range(5)]
    rows += [(110 + i, rows[4][1] + f" {w}", "en", "src0") for i, w in enumerate(WORDS[:6])]
    rows += [(200, None, None, None), (201, "", "en", "src1"), (202, " \n\t ", "en", None), (None, "null id text here", "en", "src2"), (203, "word " * 30000, "de", "src3"), (204, "x" * 50000, "de", "src3"), (5, rows[5][1], rows[5][2], rows[5][3])]
    rows += [(300, "Ünder the MIT License, é ñ 日本 🙂\r\n\x0b\x85 x  y", "fr", "src1"), (301, "under the MIT license! Apache License, Version 2.0 under the mit license", "en", "src2"), (302, "Released under the MIT\nAll rights reserved.", "en", "src2")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with columns whose names clash with the operators' own."""
    rows = [(*r, 1, "k", 2, "v", 3.0) for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, key string, id int, block string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
