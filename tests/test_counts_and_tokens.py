"""Replacement tokens by index join, import counters in one pass, details after the dedupe."""

import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from hiretide.operators import payloads, runs, state

JOB = "company_name string, job_url string, ats_provider string, ats_job_id string, n int"


def expected_token(row, tokens, companies):
    company = (row[0] or "").lower()
    for token, name in companies.items():
        if company == name.casefold():
            return token
    hay = " ".join(x or "" for x in row[:4]).lower()
    return next((t for t in sorted({t.lower() for t in tokens if t} - set(companies)) if t in hay), None)


def test_tokens_found_by_their_rarest_gram(spark):
    draw = random.Random(5)
    words = ["acme", "Acmé corp", "a", "", None, "ümlaut", "x-1", "zzz", "aaaa", "Fixed Name", "日本語の会社"]
    rows = [(draw.choice(words), f"https://h/{draw.choice(words)}/{i}", draw.choice(words), str(i * 37), i) for i in range(300)]
    rows += [(None, None, None, None, 900), rows[0], rows[0]]
    tokens = ["cme", "É CORP", "aaa", "q", "", "a", "11", "本語", "zzz", "nowhere", "fixed", "mapped"]
    companies = {"fixed": "FIXED NAME", "mapped": "fixed name", "other": "zzz"}
    for some in (tokens, [t for t in tokens if t != "a"], ["nowhere"], []):
        found = runs.with_replacement_token(spark.createDataFrame(rows, JOB), some, companies).collect()
        wanted = [(r, expected_token(r, some, companies)) for r in rows]
        assert sorted((r["n"], r["added_token"]) for r in found) == sorted((r[4], t) for r, t in wanted if t is not None)
    empty = runs.with_replacement_token(spark.createDataFrame([], JOB), tokens, {})
    assert empty.columns == [*JOB.replace(" string", "").replace(" int", "").split(", "), "added_token"] and empty.count() == 0


def test_more_tokens_give_the_same_plan(spark):
    jobs = spark.createDataFrame([("a", "b", "c", "d", 1)], JOB)

    def operators(count):
        matched = runs.with_replacement_token(jobs, [f"token{i}" for i in range(count)], {f"t{i}": f"name {i}" for i in range(count)})
        plan = matched._jdf.queryExecution().analyzed().toString()
        return [line.strip(" :+-").split(" ")[0] for line in plan.splitlines()]

    assert operators(3) == operators(1000)


def test_import_counters_read_the_records_once(spark, tmp_path):
    rows = [("h1", "A", "p"), ("h1", "A", "p"), ("h2", "A", "p"), ("", "B", "p"), (None, "B", "q"), ("h3", None, "p"), ("h3", None, "p"), ("h4", "C", "p")]
    job = F.struct("content_hash", "company_name", "ats_provider").alias("job")
    spark.createDataFrame(rows, "content_hash string, company_name string, ats_provider string").select(job).write.parquet(f"{tmp_path}/records")
    jobs = spark.createDataFrame([("h1",), ("h4",), ("h4",)], "content_hash string")
    companies = spark.createDataFrame([("A", "p"), ("B", "p")], "name string, ats_provider string")
    summary = state.import_summary(spark.read.parquet(f"{tmp_path}/records"), jobs, companies)
    assert summary.first().asDict() == {
        "jobs_inserted": 3, "jobs_updated": 3, "records_read": 8, "companies_inserted": 3, "skipped": 2, "failed": 0,
    }
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    nothing = state.import_summary(spark.read.parquet(f"{tmp_path}/records").limit(0), jobs, companies).first()
    assert set(nothing.asDict().values()) == {0}


def test_details_meet_postings_that_are_listed_once(spark):
    """The first open posting of an id stays, and its detail page is laid over it; a
    closing date or an id told by a detail page changes nothing about that."""
    listed = [
        {"Id": "1", "Title": "closed", "PostingEndDate": "2020-01-01"}, {"Id": "1", "Title": "first"}, {"Id": "1", "Title": "again"},
        {"Id": "2", "Title": "two"}, {"Id": "3", "Title": "three"},
    ]
    board = [("https://o", "tok", 0, json.dumps({"items": [{"requisitionList": listed}]}))]
    boards = spark.createDataFrame(board, "source_url string, board_token string, page_ord bigint, payload string")
    details = spark.createDataFrame(
        [("https://o", "1", json.dumps({"Title": "told"})), ("https://o", "2", json.dumps({"Id": "3", "PostingEndDate": "2020-01-01"}))],
        "source_url string, detail_key string, payload string",
    )
    mapped = payloads.map_payload(boards, "oracle", F.lit(datetime(2026, 1, 1)), details)
    assert sorted((r["pos"], r["job_title"]) for r in mapped.collect()) == [(1, "told"), (3, "two"), (4, "three")]
    plan = mapped._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join") < plan.index("Window")  # printed from the top: the window lies below the join
