"""Spark side of the derived current-state tables used by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.functions.expr import computed_once
from hiretide.operators import classify
from hiretide.operators.relevance import with_relevance
from hiretide.plans.standin import AS_OF, view


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def stamp(col: str | Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def joined(col: str | Column, separator: str = "|") -> Column:
    return F.coalesce(F.array_join(col, separator), F.lit(""))


def yes_no(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col, "yes").when(~col, "no").otherwise("unknown")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "listings")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with their eligibility columns."""
    return classify.with_eligibility(listings(spark, sf_dir))


def company_id() -> Column:
    return F.sha2(F.concat_ws("|", "company_name", "ats_provider"), 256)


def jobs(spark: SparkSession, sf_dir: str, ruled: tuple[str, ...] | None = None) -> DataFrame:
    """A current-state jobs table: every listing, active when relevant.

    The listing's own columns lie outside the barrier, so filters on ids, companies
    and dates run before any text is read.  Columns inside of it are not pruned, so a
    caller names the rule columns it reads (``ruled``, all by default); the others are
    left out, with the columns made of them.
    """
    stored = listings(spark, sf_dir).columns
    flat = with_relevance(eligible(spark, sf_dir), "is_active")
    if ruled is not None:
        return with_job_facts(computed_once(flat.select(*stored, *ruled), list(ruled)))
    ruled = [c for c in flat.columns if c not in stored]
    return with_job_facts(computed_once(flat, ruled)).withColumns(
        {
            "normalization_confidence": F.col("confidence"),
            "normalization_method": F.lit("heuristic"),
            "normalization_review_reasons": F.col("review_reasons"),
            "normalized_at": as_of(),
        }
    )


def with_job_facts(flat: DataFrame) -> DataFrame:
    """Keys and sightings of the jobs table, from stored columns."""
    return flat.withColumns(
        {
            "id": F.col("content_hash"),
            "company_id": company_id(),
            "last_seen_at": as_of() - F.make_dt_interval(F.lit(0), (F.col("doc_id") % 100).cast("int")),
            "first_seen_at": as_of() - F.make_dt_interval(F.lit(0), (100 + F.col("doc_id") % 200).cast("int")),
        }
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = listings(spark, sf_dir).select("company_name", "ats_provider").distinct()
    return pairs.select(
        company_id().alias("id"), F.col("company_name").alias("name"), "ats_provider",
        F.lit(None).cast("string").alias("career_page_url"), F.lit(None).cast("string").alias("ats_board_token"),
        F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("last_scraped_at"),
    )
