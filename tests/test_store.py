"""Keyed tables rewrite touched partitions only and survive replays; upserts into a
bucketed snapshot leave it where it is; failed attempts are counted."""

import os
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hiretide.operators.state import replace_rows, save_bucketed
from hiretide.streaming import refresh
from hiretide.streaming.refresh import KeyedTable

SCHEMA = "k string, v int"


def opened(spark, path, buckets=8):
    return KeyedTable(str(path), spark.createDataFrame([], SCHEMA), ("k",), buckets)


def put(table, spark, rows):
    new = spark.createDataFrame(rows, SCHEMA)
    table.update(new, lambda held: replace_rows(held, new, ["k"], keep=()))


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_only_touched_partitions_are_written(spark, tmp_path):
    table = opened(spark, tmp_path / "t")
    put(table, spark, [(str(i), i) for i in range(100)])
    before = files(tmp_path / "t")
    assert len(before) >= 8
    put(table, spark, [("7", 70)])
    after = files(tmp_path / "t")
    assert len(before.items() & after.items()) == len(before) - 1
    assert rows(table) == sorted((str(i), 70 if i == 7 else i) for i in range(100))


def test_the_same_update_twice_gives_the_same_rows(spark, tmp_path):
    table = opened(spark, tmp_path / "t")
    put(table, spark, [("a", 1), ("b", 1)])
    for _ in range(2):
        put(table, spark, [("a", 2), ("c", 5)])
    assert rows(table) == [("a", 2), ("b", 1), ("c", 5)]
    assert rows(opened(spark, tmp_path / "t")) == rows(table)


def test_empty_updates_and_null_keys(spark, tmp_path):
    table = opened(spark, tmp_path / "t")
    put(table, spark, [])
    assert rows(table) == [] and table.read().columns == ["k", "v"]
    put(table, spark, [("a", 1), (None, 2)])
    assert rows(table) == [("a", 1)]


def test_rows_outside_the_named_partitions_are_an_error(spark, tmp_path):
    table = opened(spark, tmp_path / "t")
    new = spark.createDataFrame([(str(i), i) for i in range(40)], SCHEMA)
    with pytest.raises(ValueError, match="do not name"):
        table.update(new.filter("k = '1'"), lambda held: new)
    assert rows(table) == []


def test_a_bucketed_snapshot_is_not_moved(spark, tmp_path):
    name = f"snapshot_{uuid.uuid4().hex}"
    held = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v"))
    snapshot = save_bucketed(held, name, str(tmp_path / "b"), ["k"], 4)
    batch = spark.createDataFrame([("7", 70), ("new", 1)], SCHEMA)
    after = replace_rows(snapshot, batch, ["k"], keep=())
    assert after.count() == 2001 and after.filter("k = '7'").first()["v"] == 70
    plan = replace_rows(snapshot, batch, ["k"], keep=())._jdf.queryExecution().executedPlan().toString()
    scan = next(i for i, line in enumerate(plan.split("\n")) if "FileScan" in line)
    above, depth = [], None
    for line in reversed(plan.split("\n")[: scan + 1]):
        level = len(line) - len(line.lstrip(" :+-|"))
        if depth is None or level < depth:
            above.append(line)
            depth = level
    # what lies above the scan of the snapshot, up to the root
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)
    spark.sql(f"DROP TABLE {name}")


class FakeState:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class FakeTimers:
    def __init__(self):
        self.at = []

    def listTimers(self):
        return list(self.at)

    def deleteTimer(self, at):
        self.at.remove(at)

    def registerTimer(self, at):
        self.at.append(at)


def test_attempts_are_counted_over_batches():
    import pandas as pd

    processor = refresh._Attempts(max_retries=2, ttl_seconds=60)
    processor.failed, processor.handle = FakeState(), FakeTimers()
    start = datetime(2026, 1, 1)

    def batch(*errors, first=0):
        frame = pd.DataFrame({
            "source_url": "u", "error_type": list(errors), "message": "m",
            "attempted_at": [start + timedelta(seconds=first + i) for i in range(len(errors))], "ord": range(len(errors)),
            "retryable": [e == "Timeout" for e in errors],
        })
        out = pd.concat(list(processor.handleInputRows(("u",), iter([frame.sample(frac=1, random_state=1)]), None)))
        return list(zip(out["attempt"], out["verdict"]))

    assert batch("Timeout", "Timeout") == [(1, "retry"), (2, "retry")]
    assert batch("Timeout", "Timeout", first=9) == [(3, "exhausted"), (1, "retry")]
    assert batch(None, "Bad", "Timeout", first=20) == [(0, "done"), (0, "failed"), (1, "retry")]
    assert len(processor.handle.at) == 1
    assert list(processor.handleExpiredTimer(("u",), None, None)) == [] and not processor.failed.exists()
    assert batch("Timeout", "Bad", first=30) == [(1, "retry"), (0, "failed")] and not processor.failed.exists()
    assert processor.handle.at == []
