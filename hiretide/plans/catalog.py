"""Query surface over the current-state tables: lists, details, views (Q1-Q16)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions.display import compact_location
from hiretide.functions.expr import any_of, mapped, strings
from hiretide.operators.skew import best_per_key
from hiretide.session import materialize

JOB_LIST_COLS = (
    "id", "company_id", "company_name", "job_title", "job_url", "location", "program_type",
    "academic_levels", "required_grad_years", "visa_status", "remote_type", "required_skills",
    "normalization_status", "normalization_confidence", "date_posted", "last_seen_at",
)
JOB_DETAIL_COLS = JOB_LIST_COLS + (
    "ats_provider", "ats_job_id", "departments", "employment_type", "degree_requirements",
    "visa_sponsorship", "nice_to_have_skills", "min_gpa", "clearance_required",
    "cleaned_description", "raw_description", "description_html", "normalization_method",
    "normalization_review_reasons", "normalized_at", "first_seen_at", "is_active",
)
EVENT_LIST_COLS = (
    "id", "firm_name", "firm_kind", "event_title", "event_url", "registration_url", "event_type",
    "audience_tags", "location", "location_type", "starts_at", "ends_at", "timezone",
    "last_seen_at", "is_active",
)
EVENT_DETAIL_COLS = EVENT_LIST_COLS + (
    "source_id", "source_provider", "source_event_id", "description", "raw_payload", "first_seen_at",
)
MAX_PAGE = 100


def _holds(text: str) -> str:
    """Substring pattern; % and _ in the input stay wildcards."""
    return f"%{text.strip()}%"


def _any_location(token: str) -> Column:
    return F.exists("location", lambda place: place.ilike(_holds(token)))


def country_terms(country: str) -> tuple[str, ...]:
    name = country.strip()
    return rules.COUNTRY_ALIASES.get(name.lower(), (name,) if name else ())


@dataclass(frozen=True)
class JobFilter:
    program_type: str | None = None
    remote_type: str | None = None
    visa_status: str | None = None
    grad_year: int | None = None
    academic_level: str | None = None
    skill: str | None = None
    location: str | None = None
    country: str | None = None
    company_id: str | None = None
    company: str | None = None
    normalization_status: str | None = None
    posted_after: datetime | None = None
    posted_before: datetime | None = None
    seen_after: datetime | None = None
    seen_before: datetime | None = None
    search: str | None = None
    active_only: bool = True

    def conditions(self) -> list[Column]:
        c, found = F.col, []
        if self.active_only:
            found.append(c("is_active"))
        for name in ("program_type", "remote_type", "visa_status", "company_id", "normalization_status"):
            if getattr(self, name):
                found.append(c(name) == getattr(self, name))
        if self.company:
            found.append(c("company_name").ilike(_holds(self.company)))
        if self.posted_after:
            found.append(c("date_posted") >= F.lit(self.posted_after))
        if self.posted_before:
            found.append(c("date_posted") <= F.lit(self.posted_before))
        if self.seen_after:
            found.append(c("last_seen_at") >= F.lit(self.seen_after))
        if self.seen_before:
            found.append(c("last_seen_at") <= F.lit(self.seen_before))
        if self.grad_year is not None:
            open_role = (F.size("required_grad_years") == 0) & c("program_type").isin("internship", "new_grad")
            found.append(F.array_contains("required_grad_years", self.grad_year) | open_role)
        if self.academic_level:
            found.append(F.array_contains("academic_levels", self.academic_level))
        if self.skill:
            found.append(F.array_contains("required_skills", self.skill.strip().lower()))
        if self.location:
            found.append(_any_location(self.location))
        if self.country and country_terms(self.country):
            found.append(any_of(map(_any_location, country_terms(self.country))))
        if self.search:
            token = _holds(self.search)
            found.append(c("job_title").ilike(token) | c("company_name").ilike(token))
        return found

    def apply(self, jobs: DataFrame) -> DataFrame:
        for condition in self.conditions():
            jobs = jobs.filter(condition)
        return jobs


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page in total order.  Each task keeps offset + limit rows at most."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def list_jobs(jobs: DataFrame, where: JobFilter, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q1: newest first, unknown dates last."""
    order = [F.col("date_posted").desc_nulls_last(), F.col("last_seen_at").desc(), F.col("id").desc()]
    return page(where.apply(jobs).select(*JOB_LIST_COLS), order, limit, offset)


def count_jobs(jobs: DataFrame, where: JobFilter) -> DataFrame:
    """Q1 total: the same filters, counted."""
    return where.apply(jobs).agg(F.count(F.lit(1)).alias("total"))


def job_detail(jobs: DataFrame, job_id: str) -> DataFrame:
    """Q8."""
    return jobs.filter(F.col("id") == job_id).select(*JOB_DETAIL_COLS)


def company_jobs(jobs: DataFrame, company_id: str, limit: int = 100) -> DataFrame:
    """Q9: the most recently seen active jobs of a company."""
    active = jobs.filter(F.col("is_active") & (F.col("company_id") == company_id))
    return active.select(*JOB_LIST_COLS).orderBy(F.col("last_seen_at").desc(), F.col("id").desc()).limit(limit)


def newest_jobs_per_company(jobs: DataFrame) -> DataFrame:
    """Q9 for every company at once: its most recently seen active job."""
    return best_per_key(
        jobs.filter("is_active").select(*JOB_LIST_COLS), ["company_id"],
        [F.col("last_seen_at").desc(), F.col("id").desc()],
    )


@dataclass(frozen=True)
class EventFilter:
    search: str | None = None
    firm: str | None = None
    firm_kind: str | None = None
    event_type: str | None = None
    location_type: str | None = None
    starts_after: datetime | None = None
    starts_before: datetime | None = None
    active_only: bool = True

    def apply(self, events: DataFrame) -> DataFrame:
        c, found = F.col, []
        if self.active_only:
            found.append(c("is_active"))
        if self.firm:
            found.append(c("firm_name").ilike(_holds(self.firm)))
        for name in ("firm_kind", "event_type", "location_type"):
            if getattr(self, name):
                found.append(c(name) == getattr(self, name))
        if self.starts_after:
            found.append(c("starts_at") >= F.lit(self.starts_after))
        if self.starts_before:
            found.append(c("starts_at") <= F.lit(self.starts_before))
        if self.search:
            token = _holds(self.search)
            texts = [c(n).ilike(token) for n in ("event_title", "firm_name", "description")]
            found.append(any_of(F.coalesce(t, F.lit(False)) for t in [*texts, _any_location(self.search)]))
        for condition in found:
            events = events.filter(condition)
        return events


def list_events(events: DataFrame, where: EventFilter, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q10: soonest first."""
    order = [F.col("starts_at").asc(), F.col("last_seen_at").desc(), F.col("id").desc()]
    return page(where.apply(events).select(*EVENT_LIST_COLS), order, limit, offset)


def count_events(events: DataFrame, where: EventFilter) -> DataFrame:
    """Q10 total."""
    return where.apply(events).agg(F.count(F.lit(1)).alias("total"))


def event_detail(events: DataFrame, event_id: str) -> DataFrame:
    """Q11."""
    return events.filter(F.col("id") == event_id).select(*EVENT_DETAIL_COLS)


def with_job(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Application rows with their job as a struct, NULL when the job is gone."""
    slim = jobs.select(F.col("id").alias("job_id"), F.struct(*JOB_LIST_COLS).alias("job"))
    return applications.join(slim, "job_id", "left")


def list_applications(applications: DataFrame, jobs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Q12: the board rows of one user (or of all), in storage order."""
    if user_id is not None:
        applications = applications.filter(F.col("user_id") == user_id)
    order = [F.col("status"), F.col("kanban_order"), F.col("updated_at").desc()]
    if user_id is None:
        order.insert(0, F.col("user_id"))
    return with_job(applications, jobs).orderBy(*order)


def company_index(companies: DataFrame, mode: str = "all", query: str = "") -> DataFrame:
    """Q13: company summaries filtered by mode and text, busiest first, with the
    bar width relative to the busiest shown company.

    The order is a global sort; ``featured`` takes the head of it.  The shown
    companies are read twice, hence written once (a row per company).
    """
    active = F.col("active_job_count")
    shown = {"all": F.lit(True), "active": active != 0, "quiet": active <= 0}[mode]
    token = query.strip().lower()
    if token:
        fields = ("name", "ats_provider", "ats_board_token")
        shown = shown & any_of(F.lower(F.coalesce(F.col(f), F.lit(""))).contains(token) for f in fields)
    rows = materialize(companies.filter(shown), "companies")
    busiest = rows.agg(F.greatest(F.lit(1), F.coalesce(F.max("active_job_count"), F.lit(0)))).scalar()
    width = F.greatest(F.lit(4), F.floor(active * 100 / busiest + F.lit(0.5))).cast("int")
    return rows.withColumn("bar_width", width).orderBy(*company_order())


def company_order() -> list[Column]:
    return [F.col("active_job_count").desc(), F.col("job_count").desc(), F.lower("name"), F.col("name"), F.col("id")]


def featured(index: DataFrame, limit: int = 8) -> DataFrame:
    """Q13: the busiest companies."""
    return index.orderBy(*company_order()).limit(limit)


def board_view(applications: DataFrame, jobs: DataFrame, status: str | None = None, query: str = "") -> DataFrame:
    """Q14: rows with a job, filtered, in the order of the hiring stages."""
    rows = with_job(applications, jobs).filter(F.col("job").isNotNull())
    if status:
        rows = rows.filter(F.col("status") == status)
    token = query.strip().lower()
    if token:
        label = mapped(F.col("status"), rules.APPLICATION_STATUS_LABELS)
        hay = F.concat_ws(
            " ", F.col("job.company_name"), F.col("job.job_title"), compact_location(F.col("job.location")),
            F.coalesce(F.col("notes"), F.lit("")), label,
        )
        rows = rows.filter(F.lower(hay).contains(token))
    stage = F.array_position(strings(rules.APPLICATION_STATUSES), F.col("status"))
    return rows.withColumn("stage", stage).orderBy("stage", "kanban_order", F.col("updated_at").desc())


def firm_names(sources: DataFrame) -> DataFrame:
    """Q16."""
    return sources.select("firm_name").distinct().orderBy("firm_name")
