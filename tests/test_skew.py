"""Skew-safe paths give the same rows as the plain ones, with tiny limits."""

import random
from datetime import datetime, timedelta


from pyspark.sql import Window
from pyspark.sql import functions as F

from hiretide.operators import board, routing, skew
from hiretide.streaming import refresh


def hot(spark, n=4000):
    """One key holds a third of all rows."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string"))
    return spark.range(n).select(key.alias("k"), (F.col("id") * 7919 % n).alias("o"), F.col("id").alias("v"))


def test_ordinal_by_range_equals_window(spark):
    df = hot(spark)
    got = skew.ordinal_within(df, ["k"], ["o"], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_ordinal_handles_null_keys(spark):
    df = hot(spark).withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    got = skew.ordinal_within(df, ["k"], ["o"], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_best_per_key_limits_before_the_shuffle(spark):
    best = skew.best_per_key(hot(spark), ["k"], [F.col("o")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    want = hot(spark).groupBy("k").agg(F.min("o").alias("o"))
    assert best.select("k", "o").exceptAll(want).count() == 0 and best.count() == want.count()


def replay(log):
    """One command at a time, as a user would issue them."""
    rows = {}
    for c in log:
        key = (c["user_id"], c["job_id"])
        row = rows.get(key)
        if row is None:
            if c["kind"] == "create":
                used = [r["kanban_order"] for (u, _), r in rows.items() if u == c["user_id"] and r["status"] == c["status"]]
                rows[key] = {"status": c["status"], "kanban_order": max(used, default=-1) + 1, "notes": None,
                             "applied_at": c["issued_at"] if c["status"] == "APPLIED" else None}
            continue
        if c["status"]:
            row["status"] = c["status"]
            if c["status"] == "APPLIED" and row["applied_at"] is None:
                row["applied_at"] = c["issued_at"]
        if c["kind"] == "patch":
            for f in ("notes", "kanban_order"):
                if c[f] is not None:
                    row[f] = c[f]
    return {k: (r["status"], r["kanban_order"], r["notes"], r["applied_at"]) for k, r in rows.items()}


def test_fold_log_equals_one_command_at_a_time(spark):
    rng = random.Random(3)
    log = []
    for seq in range(900):
        kind = rng.choice(["create", "create", "patch"])
        log.append({
            "user_id": rng.choice(["hot", "hot", "a", "b"]), "job_id": str(rng.randint(0, 40)), "kind": kind,
            "status": rng.choice(["SAVED", "APPLIED", "OFFER"]) if kind == "create" or rng.random() < 0.5 else None,
            "notes": rng.choice([None, "n"]) if kind == "patch" else None,
            "kanban_order": rng.choice([None, rng.randint(0, 9)]) if kind == "patch" else None,
            "applied_at": None, "issued_at": datetime(2026, 1, 1) + timedelta(minutes=seq), "seq": seq,
        })
    schema = "user_id string, job_id string, kind string, status string, notes string, kanban_order int, " \
             "applied_at timestamp, issued_at timestamp, seq bigint"
    df = spark.createDataFrame([tuple(c.values()) for c in log], schema)
    jobs = spark.range(41).select(F.col("id").cast("string").alias("id"))
    empty = spark.createDataFrame([], board.BOARD_SCHEMA)
    want = replay(log)
    for per_round in (10_000, 120):
        folded = board.fold_log(empty, jobs, df, commands_per_round=per_round).collect()
        got = {(r["user_id"], r["job_id"]): (r["status"], r["kanban_order"], r["notes"],
               r["applied_at"]) for r in folded}
        assert got == want


def test_hot_tokens_are_dealt_over_parts(spark):
    """A third of the companies guess one token; any number of parts gives the same rows."""
    names = [f"Acme {i}" if i % 3 == 0 else f"Firm{i}" for i in range(300)]
    companies = spark.createDataFrame([(n,) for n in names], "company_name string")
    boards = spark.createDataFrame(
        [("greenhouse", "acme", 1), ("lever", "acme", 2), ("ashby", "firm7", 3), ("lever", "firm10", 4), ("other", "firm8", 5)],
        "ats_provider string, board_token string, job_count int",
    )
    plain, salted = (routing.discover(companies, boards, per_part=n) for n in (10_000, 7))
    for one, other in zip(plain, salted, strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert plain[0].count() == 102
    guesses = companies.select("company_name", F.lit("acme").alias("board_token"))
    dealt = routing._salted(guesses, boards.limit(1), 7).groupBy("company_name").count()
    assert dealt.filter("count = 1").count() == 300


def greedy(rows, ttl):
    last, want = {}, set()
    for key, ts, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in last or ts - last[key] >= ttl:
            last[key] = ts
            want.add(i)
    return want


def test_throttle_in_stretches_equals_one_pass(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "x", "y", None]), datetime(2026, 1, 1) + timedelta(seconds=rng.randint(0, 90_000)), i)
            for i in range(1200)]
    # bursts, equal times, a gap longer than a stretch, a request at exactly the TTL, no time at all
    rows += [("burst", datetime(2026, 1, 2) + timedelta(microseconds=k // 3), 2000 + k) for k in range(300)]
    rows += [("gap", datetime(2026, 1, 1) + timedelta(days=3 * k), 3000 + k) for k in range(5)]
    rows += [("exact", datetime(2026, 1, 1) + timedelta(minutes=30 * k), 4000 + k) for k in range(200)]
    rows += [("x", None, 5000), ("none", None, 5001), ("old", datetime(1960, 1, 1), 5002), ("old", datetime(1960, 1, 1, 0, 29), 5003)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, i int").repartition(5)
    for ttl, stretch in ((1800, 48), (1800, 1), (1800, 2), (60, 3), (7200, 1000)):
        judged = refresh.throttle(df, ["key"], ["ts", "i"], ttl_seconds=ttl, stretch_ttls=stretch)
        assert judged.columns == ["key", "ts", "i", "accepted"] and judged.count() == len(rows)
        assert {r["i"] for r in judged.filter("accepted").collect()} == greedy(rows, timedelta(seconds=ttl))


def test_throttle_of_two_keys_and_no_rows(spark):
    rows = [("a", n % 2, datetime(2026, 1, 1) + timedelta(minutes=n), n) for n in range(100)]
    df = spark.createDataFrame(rows, "key string, part int, ts timestamp, i int")
    judged = refresh.throttle(df, ["key", "part"], ["ts", "i"], ttl_seconds=600)
    want = greedy([((k, p), ts, i) for k, p, ts, i in rows], timedelta(seconds=600))
    assert {r["i"] for r in judged.filter("accepted").collect()} == want
    assert refresh.throttle(df.limit(0), ["key"], ["ts"]).count() == 0


def test_a_hot_key_is_judged_in_many_tasks_and_planned_without_a_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-throttle", "planning")
    hot = spark.range(40_000).select(
        F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.col("id").alias("i")
    )
    judged = refresh.throttle(hot, ["key"], ["ts", "i"])
    assert list(tracker.getJobIdsForGroup("plan-throttle")) == []
    spark.sparkContext.setJobGroup("run-throttle", "running")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = judged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("i").alias("n"), F.count_if("accepted").alias("ok")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 4 and max(r["n"] for r in tasks) < 20_000  # every partition of the test session
    assert sum(r["ok"] for r in tasks) == 40_000 // 3 + 1
