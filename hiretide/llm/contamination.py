"""Benchmark decontamination: short test items inside long documents.

Texts are sets of five-word shingles.  An item's containment in a document is the
share of its shingles that the document has.  Documents are far longer than items,
so a Jaccard index would miss them; instead each item is represented by its
smallest shingle hashes (a bottom-k MinHash).  A document with the threshold's share
of an item lacks at most a known number of its shingles, so one value more than that
cannot all be missing; for long items fewer do, as a document misses all ``k`` values
with a probability of at most ``(1 - threshold) ** k``.  Items are partitioned by
size, in powers of two: a partition has its own bound, below which all its MinHash
values lie, and a document offers a shingle only to the partitions whose bounds lie
above it.  Documents that hold any value of an item are candidates and are verified
by counting all of the item's shingles.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import row_keys, small, whole
from hiretide.session import materialize

WIDTH = 5
THRESHOLD = 0.8
# Chance to miss a document with exactly the threshold's share of a long item (short
# items are never missed).
MISSED = 1e-9


def with_shingles(df: DataFrame, text: str, name: str, width: int) -> DataFrame:
    """Adds the distinct shingle hashes.  Words are runs of letters and digits, in
    lower case; texts with fewer than ``width`` words have no shingle."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))

    def shingle(i: Column) -> Column:
        return F.xxhash64(*[F.get("_words", i + j) for j in range(width)])

    runs = F.transform(F.sequence(F.lit(0), F.size("_words") - width), shingle)
    none = F.expr("cast(array() AS array<bigint>)")
    return hashed.withColumn(name, F.array_distinct(F.when(F.size("_words") >= width, runs).otherwise(none))).drop("_words")


def sketch_size(q: Column, threshold: float, missed: float) -> Column:
    """Values that stand for an item of ``q`` shingles: one more than can be missing,
    or as many as the recall wanted takes if those are fewer."""
    lacking = F.floor(q * (1 - threshold) + 1e-9) + 1
    enough = 1 if threshold >= 1 else math.ceil(math.log(missed) / math.log(1 - threshold)) if threshold > 0 else 1 << 30
    return F.least(lacking, F.lit(enough), q).cast("int")


def item_sketches(items: DataFrame, threshold: float, missed: float) -> DataFrame:
    """(_item, size class, bottom-k values) of items with shingles."""
    return items.select(
        "_item", F.ceil(F.log2("_q")).cast("int").alias("_class"),
        F.slice(F.array_sort("_shingles"), F.lit(1), sketch_size(F.col("_q"), threshold, missed)).alias("_values"),
    )


def containments(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, missed: float = MISSED,
) -> DataFrame:
    """(doc_id, item_id, containment, _k1, _k2) for every document and item with a
    containment of at least ``threshold``; _k1 and _k2 stand for doc_id and text.

    Items with fewer than five words, and NULL or empty texts, have no shingle and
    take no part.  Repeated document rows give one result, as do repeated items;
    items of one id with different texts count with the greatest containment.
    NULL ids are ids like others.  Other columns are ignored.
    """
    listed = items.select(F.col(item_id).alias("_item"), whole(item_text).alias("_text")).distinct()
    listed = with_shingles(listed, "_text", "_shingles", width).withColumn("_q", F.size("_shingles")).filter("_q > 0")
    listed = materialize(listed.withColumn("_no", F.xxhash64("_item", "_text")).drop("_text"), "items")
    values = materialize(
        listed.select("_no", F.explode("_shingles").alias("_h"), "_q"), "item-shingles"
    )
    sketches = item_sketches(listed.withColumn("_item", F.col("_no")), threshold, missed)
    # a bound per size class: at most 64 rows
    bounds = sketches.groupBy("_class").agg(F.max(F.element_at("_values", -1)).alias("bound")).collect()
    probes = materialize(sketches.select(F.col("_item").alias("_no"), "_class", F.explode("_values").alias("_h")), "sketches")

    def classes(h: Column) -> Column:
        """The size classes that are offered the shingle, as bits."""
        mask = F.lit(0).cast("bigint")
        for r in bounds:
            mask = mask.bitwiseOR(F.when(h <= r["bound"], F.lit(1 << r["_class"]).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return mask

    plain = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    keyed = plain.select("_id", *row_keys("_id", "_text"), "_text")
    widest = max((r["bound"] for r in bounds), default=-(1 << 63))
    offered = with_shingles(keyed, "_text", "_shingles", width).select(
        "_k1", "_k2", F.explode(F.filter("_shingles", lambda h: h <= widest)).alias("_h")
    ).withColumn("_classes", classes(F.col("_h")))
    own_class = F.getbit("_classes", F.col("_class")) == 1
    candidates = (
        offered.join(small(probes.withColumnRenamed("_h", "_probe")), (F.col("_h") == F.col("_probe")) & own_class)
        .select("_k1", "_k2", "_no").distinct()
    )
    candidates = materialize(candidates.groupBy("_k1", "_k2").agg(F.collect_set("_no").alias("_nos")), "candidates")

    held = keyed.join(candidates, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    counted = (
        with_shingles(held, "_text", "_shingles", width)
        .select("_id", "_k1", "_k2", "_nos", F.explode("_shingles").alias("_h"))
        .join(small(values), "_h").filter(F.array_contains("_nos", F.col("_no")))
        .groupBy("_id", "_k1", "_k2", "_no").agg((F.count(F.lit(1)) / F.first("_q")).alias("containment"))
        .filter(F.col("containment") >= threshold - 1e-9)
    )
    names = listed.select("_no", "_item")
    return (
        counted.join(names, "_no").groupBy("_id", "_k1", "_k2", "_item").agg(F.max("containment").alias("containment"))
        .select(F.col("_id").alias(doc_id), F.col("_item").alias(item_id), "containment", "_k1", "_k2")
    )


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, containment): see ``containments``."""
    return containments(docs, items, **options).drop("_k1", "_k2")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, that contain no item."""
    bad = containments(docs, items, doc_id, text, **options).select("_k1", "_k2").distinct()
    marked = docs.select(F.struct("*").alias("_row")).withColumn("_text", whole(f"_row.{text}"))
    marked = marked.select("_row", *row_keys(f"_row.{doc_id}", "_text"))
    return marked.join(bad, ["_k1", "_k2"], "left_anti").select("_row.*")
