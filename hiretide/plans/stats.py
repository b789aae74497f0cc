"""Aggregations over the current-state tables (A1-A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide import rules
from hiretide.operators.skew import ordinal_within


def _with_child_counts(parents: DataFrame, children: DataFrame, key: str, total: str, active: str) -> DataFrame:
    """Parents with total and active child counts, zero included.  Children are
    counted before the join, so a parent with most of them costs one row."""
    counts = children.groupBy(F.col(key).alias("id")).agg(
        F.count(F.lit(1)).alias(total), F.count_if("is_active").alias(active)
    )
    return parents.join(counts, "id", "left").fillna(0, [total, active])


def company_summary(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """A1."""
    return _with_child_counts(companies, jobs, "company_id", "job_count", "active_job_count").orderBy("name", "id")


def source_summary(sources: DataFrame, events: DataFrame) -> DataFrame:
    """A5."""
    counted = _with_child_counts(
        sources, events.filter(F.col("source_id").isNotNull()), "source_id", "event_count", "active_event_count"
    )
    return counted.orderBy("firm_name", "id")


def stats(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """A2: one pass over the jobs, one count of the companies."""
    total = companies.agg(F.count(F.lit(1))).scalar()
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if("is_active").alias("active_jobs"),
        F.max("last_seen_at").alias("last_updated"),
        F.count_if(F.col("normalization_status") == "NEEDS_REVIEW").alias("needs_review_count"),
    ).withColumn("total_companies", total)


def active_counts(jobs: DataFrame, *dimensions: str) -> DataFrame:
    """A3: active jobs per value of each dimension in one scan, NULL dropped."""
    pairs = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]
    rows = jobs.filter("is_active").select(F.inline(F.array(*pairs)))
    return rows.filter(F.col("value").isNotNull()).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("jobs")
    )


def popular_skills(jobs: DataFrame, limit: int = 25) -> DataFrame:
    """A4.  The ``limit`` most wanted skills."""
    if limit < 1:
        raise ValueError("limit must be positive")
    skills = jobs.filter("is_active").select(F.explode("required_skills").alias("skill"))
    counted = skills.filter("skill <> ''").groupBy("skill").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.col("count").desc(), "skill").limit(limit)


def active_companies(jobs: DataFrame) -> DataFrame:
    """Distinct keys first, so a busy company is reduced in the map tasks."""
    return jobs.filter("is_active").agg(F.countDistinct("company_id").alias("active_companies"))


def source_health(sources: DataFrame) -> DataFrame:
    """A7."""
    return sources.groupBy("source_status").agg(F.count(F.lit(1)).alias("sources"))


def board_counts(applications: DataFrame) -> DataFrame:
    """A8, long form: one row per status, zero included."""
    spark = applications.sparkSession
    statuses = spark.createDataFrame([(s,) for s in rules.APPLICATION_STATUSES], "status string")
    counted = applications.groupBy("status").agg(F.count(F.lit(1)).alias("applications"))
    return statuses.join(counted, "status", "left").fillna(0, ["applications"])


def board_totals(applications: DataFrame) -> DataFrame:
    """Tracked, still active, and past the saved stage."""
    status = F.col("status")
    return applications.agg(
        F.count(F.lit(1)).alias("tracked"),
        F.count_if(~status.isin("OFFER", "REJECTED")).alias("active"),
        F.count_if(status != "SAVED").alias("applied"),
    )


def company_totals(summary: DataFrame) -> DataFrame:
    """A9."""
    return summary.agg(
        F.count_if(F.col("active_job_count") > 0).alias("active_companies"),
        F.coalesce(F.sum("active_job_count"), F.lit(0)).alias("active_jobs"),
        F.count(F.lit(1)).alias("total_companies"),
        F.coalesce(F.sum("job_count"), F.lit(0)).alias("total_jobs"),
    )


def last_positions(board: DataFrame) -> DataFrame:
    """Highest board position per user and status."""
    return board.groupBy("user_id", "status").agg(F.max("kanban_order").alias("last_position"))


def next_positions(new_rows: DataFrame, board: DataFrame, order: list[str]) -> DataFrame:
    """A10: consecutive positions for new rows after the last one of the same
    user and status, starting at 0."""
    keys = ["user_id", "status"]
    numbered = ordinal_within(new_rows, keys, order, "_n")
    placed = numbered.join(last_positions(board), keys, "left")
    position = F.coalesce(F.col("last_position"), F.lit(-1)) + F.col("_n")
    return placed.withColumn("kanban_order", position.cast("int")).drop("_n", "last_position")
