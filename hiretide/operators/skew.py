"""Per-key operators that stay safe when one key owns a large share of all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiretide.session import materialize

def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key under ``order``.

    The rank filter sits directly on the window, so Spark keeps one row per key
    in each map task before shuffling: a hot key costs one row per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match each other; right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def ordinal_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key 1..n by ``order``.

    Rows are range partitioned over key and order, so that a hot key spans many
    tasks; a number is the position in the range plus the number of rows of the key
    in earlier ranges.  Order columns must identify a row."""
    sort = [F.col(c) for c in [*keys, *order]]
    spread = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    # ranges come from sampled bounds: freeze them before they are read twice
    spread = materialize(spread, "ranges")
    blocks = spread.groupBy(*keys, "_range").agg(
        F.min("_seq").alias("_start"), F.count(F.lit(1)).alias("_rows")
    )
    # one row per key and range: bounded by the number of partitions
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    joined = join_null_safe(spread, blocks, [*keys, "_range"], "inner")
    number = F.col("_seq") - F.col("_start") + F.col("_before") + 1
    return joined.select(*df.columns, number.cast("int").alias(name))
