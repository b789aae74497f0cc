"""A training-corpus pipeline in five stages, each written and read again.

toxicity -> near duplicates -> benchmark decontamination -> mixing -> sharding.
Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.llm import contamination, mixing, ngram_join, sharding, toxicity
from hiretide.llm.common import fold, fresh
from hiretide.llm.queries import table
from hiretide.session import configure, materialize

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learned as in ``op8_toxicity``."""
    configure(spark)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("_of", 5) != 0)
    return toxicity.clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    configure(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    configure(spark)
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    configure(spark)
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; copies follow one another in the
    order that is shuffled."""
    configure(spark)
    shard_name, slot_name = fresh(docs, "shard", "slot")
    size, crc = sharding.sizes("text")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), crc.alias("_crc"), size.alias("_size"))
    placed = sharding.sharded(rows, [F.col("_id"), F.col("_crc"), F.col("_size")])
    return placed.select("_row.*", F.col("shard").alias(shard_name), F.col("slot").alias(slot_name))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
