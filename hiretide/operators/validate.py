"""Row validity, quarantine and retry classification (V1-V3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions.expr import labels, strip

# Providers whose malformed rows are skipped; all others fail the whole board.
# --- fixed values ---
ROW_POLICY_PROVIDERS = ("workday", "walmart", "verizon", "mcloud")


def _blank(name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit("")) == ""


def _not_url(name: str) -> Column:
    return ~F.coalesce(F.col(name).rlike(r"^https?://[^\s/?#]+"), F.lit(False))


def _outside(name: str, allowed) -> Column:
    return ~F.coalesce(F.col(name).isin(*allowed), F.lit(False))


def _bad_hash() -> Column:
    return F.coalesce(F.length("content_hash"), F.lit(0)) != 64


def listing_errors() -> Column:
    """V1: names of the rules a listing breaks."""
    return labels(
        {
            "company_name": _blank("company_name"),
            "job_title": _blank("job_title"),
            "job_url": _not_url("job_url"),
            "ats_provider": _outside("ats_provider", rules.PROVIDERS),
            "ats_job_id": _blank("ats_job_id"),
            "location": F.col("location").isNull(),
            "raw_description": F.col("raw_description").isNull(),
            "content_hash": _bad_hash(),
            "extracted_at": F.col("extracted_at").isNull(),
        }
    )


def event_errors() -> Column:
    """V1 for recruiting events."""
    registration = F.col("registration_url").isNotNull() & _not_url("registration_url")
    return labels(
        {
            "firm_name": _blank("firm_name"),
            "firm_kind": _outside("firm_kind", rules.FIRM_KINDS),
            "event_title": _blank("event_title"),
            "event_url": _not_url("event_url"),
            "registration_url": registration,
            "location_type": _outside("location_type", rules.LOCATION_TYPES),
            "starts_at": F.col("starts_at").isNull(),
            "content_hash": _bad_hash(),
        }
    )


def normalization_errors(n: Column) -> Column:
    """V1 for the eligibility struct."""
    def off(value: Column, allowed) -> Column:
        return ~F.coalesce(value.isin(*allowed), F.lit(False))

    return labels(
        {
            "program_type": off(n.program_type, rules.PROGRAM_TYPES),
            "academic_levels": ~F.coalesce(
                F.forall(n.academic_levels, lambda v: v.isin(*rules.ACADEMIC_LEVELS)), F.lit(False)
            ),
            "visa_status": off(n.visa_status, rules.VISA_STATUSES),
            "remote_type": off(n.remote_type, rules.REMOTE_TYPES),
            "normalization_status": off(n.normalization_status, rules.NORMALIZATION_STATUSES),
            "confidence": ~F.coalesce(n.confidence.between(0.0, 1.0), F.lit(False)),
        }
    )


def with_errors(rows: DataFrame, errors: Column) -> DataFrame:
    return rows.withColumn("errors", errors)


def _per_row() -> Column:
    return F.coalesce(F.col("ats_provider").isin(*ROW_POLICY_PROVIDERS), F.lit(False))


def spoiled_boards(checked: DataFrame, board: list[str]) -> DataFrame:
    """Boards that a bad row takes out, from rows with their errors."""
    return checked.filter((F.size("errors") > 0) & ~_per_row()).select(*board).distinct()


def quarantine(rows: DataFrame, errors: Column, board: list[str], spoiled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V2: (kept, dead letters).

    Rows of a skip-row provider stand alone.  For the others one bad row takes the
    whole board out: the bad boards are a pre-aggregated key list, which a caller that
    has it (``spoiled``) may give, as when it passes part of the rows.
    """
    checked = with_errors(rows, errors)
    bad = F.size("errors") > 0
    bad_boards = spoiled_boards(checked, board) if spoiled is None else spoiled
    kept = checked.filter(~bad).join(bad_boards, board, "left_anti").drop("errors")
    letters = checked.filter(bad).withColumn("error_type", F.lit("ExtractionError"))
    return kept, letters


def retryable(error_type: Column) -> Column:
    """V3."""
    return F.coalesce(error_type.isin(*rules.RETRYABLE_ERRORS), F.lit(False))
