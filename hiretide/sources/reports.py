"""Flat report files (SNK3, SNK4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def audit_rows(records: DataFrame) -> DataFrame:
    """SNK3: the 15 columns a reviewer sees."""
    job, n = F.col("job"), F.col("normalization")

    def listed(name: str):
        return F.array_join(n[name].cast("array<string>"), "|").alias(name)

    preview = F.translate("cleaned_description", "\n", " ")
    return records.select(
        job.company_name.alias("company_name"), job.job_title.alias("job_title"), job.job_url.alias("job_url"),
        n.program_type.alias("program_type"), listed("academic_levels"), listed("degree_requirements"),
        listed("required_grad_years"), n.visa_status.alias("visa_status"), n.remote_type.alias("remote_type"),
        listed("required_skills"), n.confidence.alias("confidence"),
        n.normalization_status.alias("normalization_status"), listed("review_reasons"),
        preview.alias("description_preview"), F.lit("").alias("human_notes"),
    )


def write_audit_csv(records: DataFrame, path: str) -> None:
    audit_rows(records).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def company_counts(jobs: DataFrame) -> DataFrame:
    """SNK4: listings per company, most first."""
    name = F.coalesce(F.nullif("company_name", F.lit("")), F.lit("Unknown"))
    counted = jobs.groupBy(name.alias("company_name")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.col("count").desc(), F.lower("company_name"), "company_name")


def write_company_counts(jobs: DataFrame, path: str) -> None:
    company_counts(jobs).write.option("sep", "\t").csv(path)
