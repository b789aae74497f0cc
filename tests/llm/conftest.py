import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(n, T.StringType()) for n in ("_id", "_text", "_row", "_k1", "score", "shard", "Copies", "target", "_size", "hi")],
])


def document_rows(seed=5, n=60):
    """Prose with copies, near copies, NULLs, empty, blank, short and very long texts,
    repeated rows, repeated ids and ids out of order."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 120))) for _ in range(n)]
    texts += [texts[0]] * 5
    for k in range(12):
        words = texts[1].split()
        words[rng.randrange(len(words))] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [None, "", " \t\n", "one", "one two three", "one two three", "\n".join(texts[2:5]), " ".join(rng.choice(vocabulary) for _ in range(9000))]
    rows = [(i * 3 % 211, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "ü", None]), 1, *["x"] * 10) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (rows[4][0], "another text of the same id " * 9, *rows[4][2:]), (None, texts[7], None, None, None, *[None] * 10)]


@pytest.fixture(scope="session")
def odd_rows():
    return document_rows()


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
