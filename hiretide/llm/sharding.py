"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in a fixed order and the numbers 0..n-1 are permuted by a
generalised Feistel network over a grid of a x b cells, the smallest near-square
that holds n; a number that lands on a cell outside walks on along its cycle until
it is inside.  The permuted number gives the shard (modulo) and the slot
(quotient), so anyone can compute where row i went, or which row a slot holds,
from n, the shard count and the key.  Shard sizes differ by one row at most.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import numbered, whole

SHARDS = 40
ROUNDS = 6
KEY = 77
# The grid has fewer than a outside cells, at most about 1/sqrt(n) of all: a longer
# walk than this cannot happen for n below 4096 and has a chance below n**-32 above.
WALKS = 64


def feistel(x: Column, n: int, key: int = KEY) -> Column:
    """One pass of ``x`` through the network over the grid for ``n``."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def turn(state: Column, i: Column) -> Column:
        modulus = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        return F.struct(
            state["y"].alias("x"), F.pmod(state["x"] + F.pmod(F.xxhash64(state["y"], i, F.lit(key)), modulus), modulus).alias("y")
        )

    start = F.struct(F.expr("0L").alias("x"), F.expr("0L").alias("y")).withField("x", F.floor(x / b)).withField("y", x % b)
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["x"] * b + s["y"])


def permuted(x: Column, n: int, key: int = KEY) -> Column:
    """The place of ``x`` among 0..n-1; a walk that did not end is an error."""
    once = feistel(x, n, key)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), once, lambda y, _: F.when(y < n, y).otherwise(feistel(y, n, key))
    )
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def sharded(rows: DataFrame, order: list[Column], shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (from 0 without gaps).

    ``order`` numbers the rows and should tell different rows apart; rows that tie
    in it are interchangeable.  NULLs sort first.
    """
    placed = numbered(rows, order, "_number")
    n = placed.count()
    return (
        placed.withColumn("_place", permuted(F.col("_number"), n, key))
        .withColumn("shard", (F.col("_place") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_place") / shards).cast("long"))
        .drop("_number", "_place")
    )


def sizes(text: str) -> tuple[Column, Column]:
    """UTF-8 bytes plus 16, and the CRC-32 of the bytes (NULL: no bytes)."""
    raw = whole(text).cast("binary")
    return (F.octet_length(raw) + 16).cast("long"), F.crc32(raw)
