"""Registered queries: list and board views, aggregations (Q, A)."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from hiretide.functions import display
from hiretide.operators.events import with_event_columns
from hiretide.operators.state import event_rows, match_sources, row_id
from hiretide.plans import catalog, stats
from hiretide.plans import duck_rules as duck
from hiretide.plans.duck_events import with_events
from hiretide.plans.registry import query
from hiretide.plans.standin import duck_views, view
from hiretide.plans.tables import companies, joined, jobs, listings, stamp

_NEWEST = "ORDER BY date_posted DESC NULLS LAST, last_seen_at DESC, id DESC"


def _job_columns(df):
    return df.select("job_url", "company_name", "job_title", F.coalesce(stamp("date_posted"), F.lit("")).alias("posted"))


def _jobs_sql(where: str, tail: str = "") -> str:
    return duck.with_jobs(
        "SELECT job_url, company_name, job_title, coalesce(strftime(date_posted, '%Y-%m-%d %H:%M:%S'), '') AS posted"
        f" FROM jobs WHERE {where} {tail}"
    )


@query("q1_list_jobs", _jobs_sql("is_active AND program_type = 'internship'", f"{_NEWEST} LIMIT 20 OFFSET 5"))
def q1(spark, sf_dir):
    where = catalog.JobFilter(program_type="internship")
    return _job_columns(catalog.list_jobs(jobs(spark, sf_dir), where, limit=20, offset=5))


@query(
    "q1_count_jobs",
    duck.with_jobs("SELECT count(*) AS total FROM jobs WHERE is_active AND program_type = 'internship'"),
)
def q1_count(spark, sf_dir):
    return catalog.count_jobs(jobs(spark, sf_dir), catalog.JobFilter(program_type="internship"))


def _filter_query(name: str, where: catalog.JobFilter, sql: str) -> None:
    @query(name, _jobs_sql(sql))
    def build(spark, sf_dir):
        return _job_columns(where.apply(jobs(spark, sf_dir)))


_filter_query(
    "q2_equality_filters",
    catalog.JobFilter(remote_type="remote", visa_status="not_mentioned", normalization_status="COMPLETE", active_only=False),
    "remote_type = 'remote' AND visa_status = 'not_mentioned' AND normalization_status = 'COMPLETE'",
)
_filter_query(
    "q3_range_filters",
    catalog.JobFilter(
        posted_after=datetime(2026, 1, 2, 3), posted_before=datetime(2026, 1, 20),
        seen_after=datetime(2026, 5, 28, 12), seen_before=datetime(2026, 5, 31, 21),
    ),
    "is_active AND date_posted BETWEEN TIMESTAMP '2026-01-02 03:00:00' AND TIMESTAMP '2026-01-20 00:00:00'"
    " AND last_seen_at BETWEEN TIMESTAMP '2026-05-28 12:00:00' AND TIMESTAMP '2026-05-31 21:00:00'",
)
_filter_query(
    "q4_substring_search",
    catalog.JobFilter(company=" SRC_", search="engin%r", active_only=False),
    "company_name ILIKE '%SRC_%' AND (job_title ILIKE '%engin%r%' OR company_name ILIKE '%engin%r%')",
)
_filter_query(
    "q5_array_contains",
    catalog.JobFilter(skill=" Python ", academic_level="phd", active_only=False),
    "list_contains(required_skills, 'python') AND list_contains(academic_levels, 'phd')",
)
_filter_query("q5_skill_filter", catalog.JobFilter(skill="Python"), "is_active AND list_contains(required_skills, 'python')")
_filter_query(
    "q6_grad_year",
    catalog.JobFilter(grad_year=2027),
    "is_active AND (list_contains(required_grad_years, 2027)"
    " OR (len(required_grad_years) = 0 AND program_type IN ('internship', 'new_grad')))",
)
_filter_query(
    "q7_country",
    catalog.JobFilter(country="United States", active_only=False),
    "len(list_filter(location, lambda x: x ILIKE '%United States%' OR x ILIKE '%USA%' OR x ILIKE '%, US%'"
    " OR x ILIKE '% US,%')) > 0",
)
_filter_query(
    "q7_location",
    catalog.JobFilter(location="paris"),
    "is_active AND len(list_filter(location, lambda x: x ILIKE '%paris%')) > 0",
)


@query(
    "q8_job_detail",
    duck.with_jobs(
        "SELECT job_url, job_title, cleaned_description, array_to_string(departments, '|') AS departments,"
        " remote_type, confidence AS normalization_confidence FROM jobs"
        " WHERE id = (SELECT min(content_hash) FROM listings)"
    ),
)
def q8(spark, sf_dir):
    first = listings(spark, sf_dir).agg(F.min("content_hash")).scalar()
    table = jobs(spark, sf_dir)
    return table.filter(F.col("id") == first).select(*catalog.JOB_DETAIL_COLS).select(
        "job_url", "job_title", "cleaned_description", joined("departments").alias("departments"),
        "remote_type", "normalization_confidence",
    )


_COMPANY = "sha256('src3|greenhouse')"


@query(
    "q9_company_jobs",
    _jobs_sql(f"is_active AND company_id = {_COMPANY}", "ORDER BY last_seen_at DESC, id DESC LIMIT 100"),
)
def q9(spark, sf_dir):
    return _job_columns(catalog.company_jobs(jobs(spark, sf_dir), hashlib.sha256(b"src3|greenhouse").hexdigest()))


@query(
    "q9_newest_per_company",
    _jobs_sql("is_active", "QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY last_seen_at DESC, id DESC) = 1"),
)
def q9_newest(spark, sf_dir):
    return _job_columns(catalog.newest_jobs_per_company(jobs(spark, sf_dir)))


# --- events ------------------------------------------------------------------------


def event_table(spark, sf_dir, at="2024-01-15 00:00:00"):
    """Current-state events table with matched sources."""
    events = with_event_columns(view(spark, sf_dir, "recruiting_events"))
    matched = match_sources(events, source_table(spark, sf_dir))
    return event_rows(matched, F.lit(at).cast("timestamp"))


def source_table(spark, sf_dir):
    status = F.when(F.col("status") == "success", "productive").otherwise(F.col("status"))
    return view(spark, sf_dir, "event_sources").withColumns(
        {"id": row_id("source_url"), "source_status": status}
    )


_EVENT_OUT = "event_url, event_title, firm_name, event_type, location_type, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts"


def _event_columns(df):
    return df.select("event_url", "event_title", "firm_name", "event_type", "location_type", stamp("starts_at").alias("starts"))


@query(
    "q10_list_events",
    with_events(
        f"SELECT {_EVENT_OUT} FROM event_table WHERE is_active AND firm_kind = 'technology'"
        " AND starts_at <= TIMESTAMP '2024-01-28 00:00:00'"
        " AND (event_title ILIKE '%work%' OR firm_name ILIKE '%work%' OR description ILIKE '%work%'"
        " OR len(list_filter(location, lambda x: x ILIKE '%work%')) > 0)"
        " ORDER BY starts_at, last_seen_at DESC, id DESC LIMIT 25 OFFSET 10"
    ),
)
def q10(spark, sf_dir):
    where = catalog.EventFilter(firm_kind="technology", search="work", starts_before=datetime(2024, 1, 28))
    return _event_columns(catalog.list_events(event_table(spark, sf_dir), where, limit=25, offset=10))


@query(
    "q10_count_events",
    with_events("SELECT count(*) AS total FROM event_table WHERE is_active AND location_type = 'virtual'"
                " AND firm_name ILIKE '%goo%' AND starts_at >= TIMESTAMP '2024-01-16 00:00:00'"),
)
def q10_count(spark, sf_dir):
    where = catalog.EventFilter(firm="goo", location_type="virtual", starts_after=datetime(2024, 1, 16))
    return catalog.count_events(event_table(spark, sf_dir), where)


@query(
    "q11_event_detail",
    with_events("SELECT event_url, event_title, raw_payload, array_to_string(audience_tags, '|') AS audience_tags"
                " FROM event_table WHERE id = sha256('42')"),
)
def q11(spark, sf_dir):
    found = catalog.event_detail(event_table(spark, sf_dir), hashlib.sha256(b"42").hexdigest())
    return found.select("event_url", "event_title", "raw_payload", joined("audience_tags").alias("audience_tags"))


# --- board ---------------------------------------------------------------------------

# A static board: the last command of each user and listing number.
_BOARD_SQL = """
applications AS (
  SELECT user_id, ats_job_id, status, issued_at AS updated_at, CAST(command_id AS BIGINT) AS kanban_order,
    CASE WHEN command_id % 3 = 0 THEN 'call back' END AS notes
  FROM commands
  QUALIFY row_number() OVER (PARTITION BY user_id, ats_job_id ORDER BY issued_at DESC, command_id DESC) = 1
)"""


def applications(spark, sf_dir):
    """Board rows keyed by the listing's content hash; the job may be gone."""
    commands = view(spark, sf_dir, "commands")
    last = catalog.best_per_key(commands, ["user_id", "ats_job_id"], [F.col("issued_at").desc(), F.col("command_id").desc()])
    ids = listings(spark, sf_dir).select("ats_job_id", F.col("content_hash").alias("job_id"))
    return last.join(ids, "ats_job_id", "left").select(
        "user_id", "ats_job_id", F.coalesce("job_id", F.concat(F.lit("gone-"), "ats_job_id")).alias("job_id"), "status",
        F.col("issued_at").alias("updated_at"), F.col("command_id").alias("kanban_order"),
        F.when(F.col("command_id") % 3 == 0, "call back").alias("notes"),
    )


@query(
    "q12_list_applications",
    duck.with_jobs(
        "SELECT a.user_id, a.ats_job_id, a.status, a.kanban_order, coalesce(j.job_title, '') AS job_title"
        " FROM applications a LEFT JOIN jobs j ON j.ats_job_id = a.ats_job_id",
        "commands", extra=_BOARD_SQL.strip(),
    ),
)
def q12(spark, sf_dir):
    rows = catalog.list_applications(applications(spark, sf_dir), jobs(spark, sf_dir))
    return rows.select(
        "user_id", "ats_job_id", "status", "kanban_order", F.coalesce("job.job_title", F.lit("")).alias("job_title")
    )


_SUMMARY = """
summary AS (
  SELECT c.name, c.ats_provider, count(j.id) AS job_count, count_if(j.is_active) AS active_job_count
  FROM (SELECT DISTINCT company_name AS name, ats_provider FROM listings) c
  LEFT JOIN jobs j ON j.company_name = c.name AND j.ats_provider = c.ats_provider
  GROUP BY 1, 2
)"""


def _summary(spark, sf_dir):
    return stats.company_summary(companies(spark, sf_dir), jobs(spark, sf_dir, ("is_active",)))


@query(
    "q13_company_index",
    duck.with_jobs(
        "SELECT name, ats_provider, job_count, active_job_count,"
        " CAST(greatest(4, floor(active_job_count * 100.0 / greatest(1, (SELECT max(active_job_count) FROM summary"
        " WHERE active_job_count <> 0 AND (lower(name) LIKE '%src1%' OR ats_provider LIKE '%src1%'))) + 0.5)) AS BIGINT)"
        " AS bar_width FROM summary WHERE active_job_count <> 0"
        " AND (lower(name) LIKE '%src1%' OR ats_provider LIKE '%src1%')",
        extra=_SUMMARY.strip(),
    ),
)
def q13(spark, sf_dir):
    index = catalog.company_index(_summary(spark, sf_dir), mode="active", query="SRC1")
    return index.select("name", "ats_provider", "job_count", "active_job_count", F.col("bar_width").cast("bigint").alias("bar_width"))


@query(
    "q13_featured",
    duck.with_jobs(
        "SELECT name, ats_provider, active_job_count FROM summary"
        " ORDER BY active_job_count DESC, job_count DESC, lower(name), name, sha256(name || '|' || ats_provider) LIMIT 8",
        extra=_SUMMARY.strip(),
    ),
)
def q13_featured(spark, sf_dir):
    return catalog.featured(_summary(spark, sf_dir)).select("name", "ats_provider", "active_job_count")


_STAGE = "list_position(['SAVED','APPLIED','PHONE_SCREEN','TECHNICAL','FINAL','OFFER','REJECTED'], a.status)"


@query(
    "q14_board_view",
    duck.with_jobs(
        f"SELECT a.user_id, j.job_title, a.status, CAST({_STAGE} AS BIGINT) AS stage"
        " FROM applications a JOIN jobs j ON j.ats_job_id = a.ats_job_id"
        " WHERE contains(lower(concat_ws(' ', j.company_name, j.job_title, CASE WHEN len(j.location) > 1"
        " THEN j.location[1] || ' +' || CAST(len(j.location) - 1 AS VARCHAR) ELSE j.location[1] END,"
        " coalesce(a.notes, ''), CASE a.status WHEN 'SAVED' THEN 'Saved' WHEN 'APPLIED' THEN 'Applied'"
        " WHEN 'PHONE_SCREEN' THEN 'Phone Screen' WHEN 'TECHNICAL' THEN 'Technical' WHEN 'FINAL' THEN 'Final Round'"
        " WHEN 'OFFER' THEN 'Offer' ELSE 'Rejected' END)), 'call')",
        "commands", extra=_BOARD_SQL.strip(),
    ),
)
def q14(spark, sf_dir):
    rows = catalog.board_view(applications(spark, sf_dir), jobs(spark, sf_dir), query=" CALL ")
    return rows.select("user_id", "job.job_title", "status", F.col("stage").cast("bigint").alias("stage"))


@query(
    "q15_display_scalars",
    duck.with_listings(
        "SELECT doc_id, CASE WHEN len(location) = 1 THEN location[1] ELSE location[1] || ' +' ||"
        " CAST(len(location) - 1 AS VARCHAR) END AS place, company_name AS label,"
        " upper(substr(company_name, 1, 2)) AS initials,"
        " upper(substr(ats_provider, 1, 1)) || substr(ats_provider, 2) AS provider FROM listings"
    ),
)
def q15(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "doc_id", display.compact_location(F.col("location")).alias("place"),
        display.company_label(F.col("company_name")).alias("label"),
        display.company_initials(F.col("company_name")).alias("initials"),
        display.title_case(F.col("ats_provider")).alias("provider"),
    )


@query("q16_firm_names", f"WITH {duck_views('event_sources')}\nSELECT DISTINCT firm_name FROM event_sources")
def q16(spark, sf_dir):
    return catalog.firm_names(view(spark, sf_dir, "event_sources"))


# --- aggregations ----------------------------------------------------------------------


@query(
    "a1_company_summary",
    duck.with_jobs("SELECT name, ats_provider, job_count, active_job_count FROM summary", extra=_SUMMARY.strip()),
)
def a1(spark, sf_dir):
    return _summary(spark, sf_dir).select("name", "ats_provider", "job_count", "active_job_count")


@query(
    "a2_stats",
    duck.with_jobs(
        "SELECT count(*) AS total_jobs, count_if(is_active) AS active_jobs,"
        " strftime(max(last_seen_at), '%Y-%m-%d %H:%M:%S') AS last_updated,"
        " count_if(normalization_status = 'NEEDS_REVIEW') AS needs_review_count,"
        " (SELECT count(*) FROM (SELECT DISTINCT company_name, ats_provider FROM listings)) AS total_companies FROM jobs"
    ),
)
def a2(spark, sf_dir):
    row = stats.stats(jobs(spark, sf_dir), companies(spark, sf_dir))
    return row.withColumn("last_updated", stamp("last_updated"))


@query(
    "a3_active_counts",
    duck.with_jobs(
        " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS jobs FROM jobs WHERE is_active GROUP BY 2"
            for d in ("program_type", "remote_type", "visa_status")
        )
    ),
)
def a3(spark, sf_dir):
    return stats.active_counts(jobs(spark, sf_dir), "program_type", "remote_type", "visa_status")


@query(
    "a4_popular_skills",
    duck.with_jobs(
        "SELECT skill, count(*) AS count FROM (SELECT unnest(required_skills) AS skill FROM jobs WHERE is_active)"
        " GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
    ),
)
def a4(spark, sf_dir):
    return stats.popular_skills(jobs(spark, sf_dir), 10)


@query(
    "a5_source_summary",
    with_events(
        "SELECT s.source_url, s.firm_name, count(e.id) AS event_count, coalesce(count_if(e.is_active), 0) AS active_event_count"
        " FROM event_sources s LEFT JOIN event_table e ON e.source_url = s.source_url GROUP BY 1, 2"
    ),
)
def a5(spark, sf_dir):
    summary = stats.source_summary(source_table(spark, sf_dir), event_table(spark, sf_dir))
    return summary.select("source_url", "firm_name", "event_count", "active_event_count")


@query("a6_active_companies", duck.with_jobs("SELECT count(DISTINCT company_id) AS active_companies FROM jobs WHERE is_active"))
def a6(spark, sf_dir):
    return stats.active_companies(jobs(spark, sf_dir))


@query(
    "a7_source_health",
    f"WITH {duck_views('event_sources')}\nSELECT CASE WHEN status = 'success' THEN 'productive' ELSE status END"
    " AS source_status, count(*) AS sources FROM event_sources GROUP BY 1",
)
def a7(spark, sf_dir):
    return stats.source_health(source_table(spark, sf_dir))


def _with_board(select: str) -> str:
    return f"WITH {duck_views('commands')},{_BOARD_SQL}\n{select}"


@query(
    "a8_board_counts",
    _with_board(
        "SELECT s.status, count(a.status) AS applications FROM (SELECT unnest(['SAVED','APPLIED','PHONE_SCREEN',"
        "'TECHNICAL','FINAL','OFFER','REJECTED']) AS status) s LEFT JOIN applications a ON a.status = s.status GROUP BY 1"
    ),
)
def a8(spark, sf_dir):
    return stats.board_counts(applications(spark, sf_dir))


@query(
    "a8_board_totals",
    _with_board("SELECT count(*) AS tracked, count_if(status NOT IN ('OFFER', 'REJECTED')) AS active,"
                " count_if(status <> 'SAVED') AS applied FROM applications"),
)
def a8_totals(spark, sf_dir):
    return stats.board_totals(applications(spark, sf_dir))


@query(
    "a9_company_totals",
    duck.with_jobs(
        "SELECT count_if(active_job_count > 0) AS active_companies, CAST(sum(active_job_count) AS BIGINT) AS active_jobs,"
        " count(*) AS total_companies, CAST(sum(job_count) AS BIGINT) AS total_jobs FROM summary",
        extra=_SUMMARY.strip(),
    ),
)
def a9(spark, sf_dir):
    return stats.company_totals(_summary(spark, sf_dir))


# The early half of the commands is the board, the late half brings new rows.
_SPLIT = "1998-06-01 00:00:00"


@query(
    "a10_next_positions",
    f"WITH {duck_views('commands')}\n"
    f"""SELECT n.command_id, CAST(coalesce(b.last, -1) + row_number() OVER
        (PARTITION BY n.user_id, n.status ORDER BY n.issued_at, n.command_id) AS BIGINT) AS kanban_order
    FROM commands n LEFT JOIN (SELECT user_id, status, max(command_id % 50) AS last FROM commands
      WHERE issued_at < TIMESTAMP '{_SPLIT}' GROUP BY 1, 2) b ON b.user_id = n.user_id AND b.status = n.status
    WHERE n.issued_at >= TIMESTAMP '{_SPLIT}'""",
)
def a10(spark, sf_dir):
    commands = view(spark, sf_dir, "commands")
    split = F.lit(_SPLIT).cast("timestamp")
    old = commands.filter(F.col("issued_at") < split).withColumn("kanban_order", F.col("command_id") % 50)
    new = commands.filter(F.col("issued_at") >= split)
    placed = stats.next_positions(new, old, ["issued_at", "command_id"])
    return placed.select("command_id", F.col("kanban_order").cast("bigint").alias("kanban_order"))
