import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hiretide.llm import fill_middle


def transformed(doc_id, text, plain_percent=90, spm_percent=20):
    """(form, prefix, middle, output) of one text, at once."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_percent:
        return "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


EXTRA = [
    "a <S> inside", "<P", "<" * 50, "P>S>M><<P<S<M" * 9, "\U0001F600é" * 40, "\n", "<P>", "x" * 40000, "ab", "<S<P<M" * 3000,
]


@pytest.fixture(scope="module")
def texts(odd_rows):
    return [(r[0], r[1]) for r in odd_rows] + [(1000 + 7 * i + j, t) for i, t in enumerate(EXTRA) for j in range(7)]


@pytest.mark.parametrize("piece_chars", [1, 7, fill_middle.PIECE_CHARS])
def test_round_trip_equals_brute_force(spark, texts, piece_chars):
    rows = texts if piece_chars > 1 else [r for r in texts if len(r[1] or "") < 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter(map(tuple, fill_middle.round_trip(docs, piece_chars=piece_chars).collect()))
    expected = Counter()
    for doc_id, text in rows:
        form, prefix, middle, output = transformed(doc_id, text)
        expected[(doc_id, len(text or ""), form, prefix, middle, sha(output), sha(text or ""))] += 1
    assert found == expected
    assert {f[2] for f in found} == {"plain", "psm", "spm"}


def test_outputs_and_source_pieces(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    pieces = fill_middle.arranged(docs, piece_chars=100)
    found = Counter(map(tuple, fill_middle.outputs(pieces).collect()))
    assert found == Counter((i, transformed(i, t)[0], transformed(i, t)[3]) for i, t in texts)
    source = fill_middle.restored(pieces).filter(F.col("position") < fill_middle.END * fill_middle.STEP)
    longest = max(texts, key=lambda r: len(r[1] or ""))
    parts = source.filter(F.col("_id") == longest[0]).orderBy("position").collect()
    assert "".join(r["piece"] for r in parts) == longest[1] and len(parts) > 100


def test_other_rates_and_ids(spark):
    docs = spark.createDataFrame([(f"id{i}", f"text number {i}") for i in range(300)], "name string, body string")
    forms = fill_middle.round_trip(docs, "name", "body", plain_percent=50, spm_percent=100).groupBy("form").count()
    counts = {r["form"]: r["count"] for r in forms.collect()}
    assert set(counts) == {"plain", "spm"} and 100 < counts["spm"] < 200


def test_marks_across_pieces():
    rng = random.Random(3)
    for form, order in fill_middle.ORDERS.items():
        for _ in range(200):
            segments = {m: "".join(rng.choice("<PSM> a") for _ in range(rng.randint(0, 9))) for m in order}
            segments = {m: t for m, t in segments.items()}
            if any(m in t for m in order for t in segments.values()):
                continue
            output = "".join(m + segments[m] for m in order)
            reader, found, at = fill_middle.MarkReader(form), {0: "", 1: "", 2: ""}, 0
            while at < len(output):
                step = rng.randint(1, 4)
                for rank, part in reader.feed(output[at:at + step]):
                    found[rank] += part
                at += step
            for rank, part in reader.rest():
                found[rank] += part
            assert found == {fill_middle.RANKS[m]: t for m, t in segments.items()}


def test_odd_tables(spark, odd_documents, no_documents):
    assert fill_middle.round_trip(no_documents).count() == 0
    found = fill_middle.round_trip(odd_documents)
    assert found.count() == odd_documents.count()
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    hot = spark.range(0, 3000, 1, 6).select(F.lit(5).alias("doc_id"), F.lit("the same row again").alias("text"))
    assert fill_middle.round_trip(hot).groupBy("doc_id", "n").count().collect()[0]["count"] == 3000
