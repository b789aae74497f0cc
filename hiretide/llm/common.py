"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiretide.session import materialize

# Narrow rows up to which the small side of a join is broadcast.
BROADCAST_ROWS = 1_000_000
SPACE = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df`` (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole(text: str) -> Column:
    """The text with NULL read as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a NULL id counts as the
    empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def unit_hash(*cols: str | Column) -> Column:
    """A reproducible number in [0, 1) from the given values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


def row_keys(doc_id: str, text: str) -> list[Column]:
    """128 bits that stand for a row's doc_id and text."""
    return [F.xxhash64(doc_id, text).alias("_k1"), F.xxhash64(text, F.lit(7), doc_id).alias("_k2")]


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast when the counted rows are few; otherwise left to a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Global row numbers from 0 in the given order, as column ``name``.

    Rows are range-partitioned and sorted, and written once, since the ranges come
    from samples; a number is the position in the range plus the rows of earlier
    ranges (one row per range).  Rows that tie are told apart by their place in the
    input, so that no group of ties has to fit in one range.
    """
    spread, place, seq = fresh(df, "_range", "_place", "_seq")
    sort = [*order, F.col(place)]
    ranged = (
        df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
        .drop(place).withColumn(spread, F.spark_partition_id()).withColumn(seq, F.monotonically_increasing_id())
    )
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy(spread).agg(F.min(seq).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy(spread).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        F.col(spread).alias("_at"), (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    # bounded: a row per shuffle partition
    joined = ranged.join(F.broadcast(shift), F.col(spread) == F.col("_at"))
    return joined.select(*df.columns, (F.col(seq) + F.col("_shift")).alias(name))
