import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, tokens long, score double, bucket int, label string"


def rows():
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away"),
        (2, "The quick brown fox jumps over the lazy dog and runs far away"),
        (3, "Thequick brown fox jumps over the lazy dog\tand runs far away  "),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (7, "one two"),
        (8, LONG),
        (9, LONG + " end"),
        (None, "no id here but some words to read on"),
        (None, "no id here but some words to read on"),
        (10, "naïve café 日本語 🙂 ﬁ ▁ x"),
        (11, 'token = "0123456789abcdef0123456789abcdef01234567" end'),
    ]
    return [(i, t, None if i == 4 else "en", None if i == 5 else f"s{(i or 0) % 3}", 1, "x", 5, 6, 0.5, 1, None) for i, t in texts]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names of the operators' own."""
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n: " ".join(rng.choice(stock) for _ in range(n))


def as_read(spark, frame, folder):
    path = str(folder)
    frame.write.parquet(path)
    return spark.read.parquet(path)
