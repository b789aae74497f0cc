"""Registered queries against DuckDB on the smallest tables (one per operator
family; tools/compare.py runs all of them)."""

import importlib
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tools.compare import TABLES, rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = (
    "tx1_html_to_text", "tx3_strip_boilerplate", "n15_heuristic_normalize", "n17_apply_model_output", "n18_normalize_run", "r4_sweep_summary",
    "rt1_route", "rt6_candidate_tokens", "t3_date_and_time", "c2_combine_sources", "m3_merge_jobs", "v2_quarantine", "u2_upsert_jobs",
    "u7_upsert_event_sources", "b2_patch", "q1_list_jobs", "q14_board_view", "a3_active_counts", "e3_calendar", "e5_recruiting_cards",
    "pay2_lever", "pay8_apple", "pay18_talentbrew", "src1_read_pull", "snk3_audit_csv", "st1_refresh_jobs", "st2_throttle_stream",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck, name):
    df = spark_entry.queries()[name](spark, SF_DIR)
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(spark_entry.oracle_sql()[name])
    want, want_columns = rows_of([d[0] for d in result.description], result.fetchall())
    assert columns == want_columns and got == want and got


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).columns[0] == "id"


def test_every_check_has_a_query():
    importlib.reload(spark_entry)
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    """On a stored jobs table only the needed columns and rows are read."""
    from hiretide.plans import catalog, tables

    path = str(tmp_path / "jobs")
    tables.jobs(spark, SF_DIR).write.parquet(path)
    where = catalog.JobFilter(program_type="internship", remote_type="remote")
    listed = catalog.list_jobs(spark.read.parquet(path), where)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(program_type)" in plan and "EqualTo(is_active,true)" in plan
    assert "raw_description" not in plan and "TakeOrderedAndProject" in plan


def test_text_rules_need_no_shuffle(spark):
    from hiretide.operators import classify
    from hiretide.plans import tables

    rows = spark.createDataFrame([], tables.listings(spark, SF_DIR).schema)
    plan = classify.normalize(rows, tables.as_of())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stored_columns_are_filtered_before_texts_are_read(spark):
    """On the derived jobs table a filter on an id lies below the rules."""
    from hiretide.plans import catalog, tables

    plan = catalog.job_detail(tables.jobs(spark, SF_DIR), "x")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    barrier = next(i for i, line in enumerate(lines) if "Generate inline" in line)
    assert not any("Filter" in line for line in lines[:barrier])
    assert any("Filter" in line and "= x" in line for line in lines[barrier:])
