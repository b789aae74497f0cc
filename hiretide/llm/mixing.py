"""Mixing sources to target weights by systematic sampling.

A source's target divided by its size is how many copies each of its documents
should get.  The expected copies are summed up along the source's documents, one
random offset is added, and a document is taken once for every whole number its
step crosses: the source gets its target up to one document, and each document
its expected copies rounded up or down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiretide.llm.common import SPACE, fresh, numbered, small, whole
from hiretide.session import materialize

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"


def words(text: str):
    """Number of runs of characters other than ASCII white space (NULL: 0)."""
    return F.regexp_count(whole(text), F.lit(SPACE)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds ``weight``, ``target`` and ``first`` to (source, size, rows).

    Sources in code point order, NULL last, weigh 1, 2, 3, repeating.  A target is
    min(cap, level * weight), where the level is set so that the targets add up to
    all sizes: what handing out the excess by weight until nobody is above his cap
    ends in.  One row per source is sorted in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    before = by_name.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    capped = ranked.withColumn("cap", F.col("size") * MOST_COPIES).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "place")
    everything = Window.partitionBy(F.lit(1))
    below = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    leveled = capped.withColumn("level", (F.sum("size").over(everything) - below) / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return leveled.withColumn("target", target).select("source", "size", "rows", "weight", "first", "target")


def systematic_copies(rows: DataFrame, size: str, source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies``.

    Within a source, documents go from large to small (of equal size by a hash of
    the key), which keeps the words taken close to the target.  Row numbers come
    from sorted ranges over all rows, so a hot source is spread over many tasks.
    Documents of size 0 may get copies, but take no words; a source of size 0 gets
    none; a NULL source is a source.  Reruns agree.
    """
    (number,) = fresh(rows, "_number")
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("rows"))
    random = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "source")), 1, 10), 16, 10).cast("double") / float(1 << 40)
    plan = source_targets(sizes).select(
        F.col("source").alias("_source"), F.col("size").alias("source_size"), F.col("target"), F.col("first").alias("_first"),
        F.when(F.col("size") > 0, F.least(F.col("target") / F.col("size"), F.lit(float(MOST_COPIES)))).otherwise(0.0).alias("_rate"),
        random.alias("_offset"),
    )
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    order = [F.col(source).asc_nulls_last(), F.col(size).desc(), digest, F.col(key)]
    plan = small(materialize(plan, "sources"))
    placed = numbered(rows, order, number).join(plan, F.col(source).eqNullSafe(F.col("_source")))
    position = F.col(number) - F.col("_first")
    crossed = F.floor((position + 1) * F.col("_rate") + F.col("_offset")) - F.floor(position * F.col("_rate") + F.col("_offset"))
    return placed.select(*rows.columns, "source_size", "target", crossed.alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it."""
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(source).alias("_by"), F.col(doc_id).alias("_key"), words(text).alias("_size")
    )
    taken = systematic_copies(rows, "_size", "_by", "_key", seed).filter("copies > 0")
    return taken.select("_row", F.expr("explode(sequence(1, cast(copies AS int)))").alias("_copy")).select("_row.*")
