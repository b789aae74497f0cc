import os
import random

import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark, odd_documents, tmp_path_factory):
    """The odd documents, some with an insult or a benchmark item."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(6)
    plain = [r for r in odd_documents.collect()]
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices(["la", "mo", "ti", "ra", "no"], k=3)) for _ in range(40)]
        toxic = i % 4 == 0
        words.insert(rng.randrange(40), "grumfel" if toxic else item if i % 10 == 1 else "calm")
        rows.append((1000 + i, " ".join(words), *plain[0][2:]))
        labels.append((1000 + i, int(toxic)))
    frame = spark.createDataFrame([tuple(r) for r in plain] + rows, odd_documents.schema)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, clean = docs.columns, docs.filter("NOT coalesce(text LIKE '%grumfel%', false)").count()
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        if name != "sharding":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] == clean
    assert counts[1] < counts[0]
    assert counts[2] == counts[1] - 40
    assert counts[4] == counts[3] > 0
    assert "slot" in docs.columns and docs.columns[: len(columns)] == columns
    assert docs.filter("text LIKE '%grumfel%' OR text LIKE '%quick brown%'").count() == 0


def test_registered_and_run_on_the_smallest_tables(spark):
    queries = spark_entry.queries()
    assert [q.split("_")[0] for q in queries if q.startswith("op")] == [f"op{n}" for n in range(1, 14)]
    assert queries["pipeline"](spark, SF_DIR).count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, tables, no_documents):
    docs = no_documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0
