"""Registered queries: upserts, board commands, streams (U, B, ST, E15-E17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiretide.operators import board, classify, state
from hiretide.operators.events import with_event_columns
from hiretide.operators.skew import best_per_key
from hiretide.plans import duck_rules as duck
from hiretide.plans import tables
from hiretide.plans.checks_query import event_table, source_table
from hiretide.plans.dialect import DUCK, SPARK, choose
from hiretide.plans.duck_events import with_events
from hiretide.plans.registry import query
from hiretide.plans.standin import duck_views, given, view
from hiretide.plans.tables import as_of, joined, listings, stamp
from hiretide.session import scratch_path
from hiretide.streaming import refresh

# --- listings -----------------------------------------------------------------------

_EARLIER = "2026-05-20 00:00:00"


def _earlier():
    return F.lit(_EARLIER).cast("timestamp")


def _two_runs(spark, sf_dir):
    """First and last run of the three; they share part of the listings."""
    runs = view(spark, sf_dir, "runs")
    return runs.filter("run_ord = 0"), runs.filter("run_ord = 2")


def _company_snapshot(spark, sf_dir):
    first, _ = _two_runs(spark, sf_dir)
    empty = tables.companies(spark, sf_dir).withColumn("created_at", as_of()).limit(0)
    return state.upsert_companies(empty, first, ["pos"], _earlier(), touch=False)


_COMPANY_RUNS = """
first AS (SELECT DISTINCT company_name, ats_provider FROM runs WHERE run_ord = 0),
last AS (SELECT company_name, ats_provider, arg_max(extracted_at, pos) AS at FROM runs WHERE run_ord = 2 GROUP BY 1, 2)"""


def _with_company_runs(select: str) -> str:
    return f"WITH {duck_views('runs')},{_COMPANY_RUNS}\n{select}"


@query(
    "u1_upsert_companies",
    _with_company_runs(
        "SELECT coalesce(f.company_name, l.company_name) AS name, coalesce(f.ats_provider, l.ats_provider) AS ats_provider,"
        " coalesce(strftime(l.at, '%Y-%m-%d %H:%M:%S'), '') AS scraped,"
        " CASE WHEN f.company_name IS NULL THEN '2026-06-01 00:00:00' ELSE '2026-05-20 00:00:00' END AS created"
        " FROM first f FULL JOIN last l ON f.company_name = l.company_name AND f.ats_provider = l.ats_provider"
    ),
)
def u1(spark, sf_dir):
    _, second = _two_runs(spark, sf_dir)
    merged = state.upsert_companies(_company_snapshot(spark, sf_dir), second, ["pos"], as_of(), touch=True)
    return merged.select(
        "name", "ats_provider", F.coalesce(stamp("last_scraped_at"), F.lit("")).alias("scraped"),
        stamp("created_at").alias("created"),
    )


@query(
    "u1_bulk_companies",
    _with_company_runs(
        "SELECT coalesce(f.company_name, l.company_name) AS name, coalesce(f.ats_provider, l.ats_provider) AS ats_provider,"
        " '' AS scraped FROM first f FULL JOIN last l ON f.company_name = l.company_name AND f.ats_provider = l.ats_provider"
    ),
)
def u1_bulk(spark, sf_dir):
    _, second = _two_runs(spark, sf_dir)
    merged = state.upsert_companies(_company_snapshot(spark, sf_dir), second, ["pos"], as_of(), touch=False)
    return merged.select("name", "ats_provider", F.coalesce(stamp("last_scraped_at"), F.lit("")).alias("scraped"))


def _job_rows(run, at):
    return state.job_rows(classify.normalize(run, at), at)


def _job_snapshot(spark, sf_dir):
    first, _ = _two_runs(spark, sf_dir)
    return _job_rows(first, _earlier())


@query(
    "u2_upsert_jobs",
    duck.with_jobs(
        "SELECT content_hash, CASE WHEN bool_or(run_ord = 0) THEN '2026-05-20 00:00:00' ELSE '2026-06-01 00:00:00' END AS first_seen,"
        " CASE WHEN bool_or(run_ord = 2) THEN '2026-06-01 00:00:00' ELSE '2026-05-20 00:00:00' END AS last_seen,"
        " any_value(is_active) AS is_active, any_value(CASE WHEN run_ord = 2 THEN job_title || ' (updated)' END) IS NOT NULL AS updated"
        " FROM (SELECT r.run_ord, j.* FROM runs r JOIN jobs j ON j.doc_id = r.doc_id WHERE r.run_ord <> 1) GROUP BY 1",
        "runs",
    ),
)
def u2(spark, sf_dir):
    _, second = _two_runs(spark, sf_dir)
    rows = _job_rows(second, as_of()).withColumn("job_title", F.concat("job_title", F.lit(" (updated)")))
    merged = state.upsert_jobs(_job_snapshot(spark, sf_dir), rows, state.LISTING_COLUMNS)
    return merged.select(
        "content_hash", stamp("first_seen_at").alias("first_seen"), stamp("last_seen_at").alias("last_seen"),
        "is_active", F.col("job_title").endswith(" (updated)").alias("updated"),
    )


@query(
    "u2_blank_and_repeated_hashes",
    duck.with_jobs(
        "SELECT content_hash, 1 AS rows, job_title FROM jobs WHERE doc_id % 11 <> 1 AND doc_id % 13 <> 2"
    ),
)
def u2_blank_and_repeated(spark, sf_dir):
    """Blank, NULL and repeated hashes, imported twice: the table stays the same."""
    n = F.col("doc_id")
    spoiled = listings(spark, sf_dir).withColumn(
        "content_hash", F.when(n % 11 == 1, "").when(n % 13 == 2, None).otherwise(F.col("content_hash"))
    )
    rows = _job_rows(spoiled, as_of())
    older = rows.withColumns({"extracted_at": F.col("extracted_at") - F.expr("INTERVAL 1 DAY"), "job_title": F.lit("older")})
    batch = rows.unionByName(older).unionByName(rows)
    once = state.upsert_jobs(rows.limit(0), batch)
    twice = state.upsert_jobs(once, batch)
    return twice.groupBy("content_hash").agg(F.count(F.lit(1)).alias("rows"), F.max("job_title").alias("job_title"))


@query(
    "u3_job_rows",
    duck.with_jobs(
        "SELECT content_hash, company_id, array_to_string(location, '|') AS location, coalesce(min_gpa, -1.0) AS min_gpa,"
        " confidence AS normalization_confidence, is_active FROM jobs"
    ),
)
def u3(spark, sf_dir):
    rows = _job_rows(listings(spark, sf_dir), as_of())
    return rows.select(
        "content_hash", "company_id", joined("location").alias("location"),
        F.coalesce(F.col("min_gpa").cast("double"), F.lit(-1.0)).alias("min_gpa"),
        F.col("normalization_confidence").cast("double").alias("normalization_confidence"), "is_active",
    )


@query(
    "u4_import_summary",
    _with_company_runs(
        "SELECT count(*) AS records_read, (SELECT count(*) FROM (SELECT company_name, ats_provider FROM runs WHERE run_ord > 0"
        " EXCEPT SELECT company_name, ats_provider FROM first)) AS companies_inserted,"
        " count_if(content_hash <> '' AND NOT known) AS jobs_inserted, count_if(content_hash <> '' AND known) AS jobs_updated,"
        " count_if(content_hash = '') AS skipped, 0 AS failed FROM (SELECT CASE WHEN doc_id % 13 = 0 THEN '' ELSE content_hash END"
        " AS content_hash, doc_id IN (SELECT doc_id FROM runs WHERE run_ord = 0) AS known FROM runs WHERE run_ord > 0)"
    ),
)
def u4(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    spoiled = runs.filter("run_ord > 0").withColumn(
        "content_hash", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("content_hash"))
    )
    records = spoiled.select(F.struct("*").alias("job"))
    known = runs.filter("run_ord = 0").select("content_hash")
    summary = state.import_summary(records, known, _company_snapshot(spark, sf_dir))
    return summary.select(
        "records_read", "companies_inserted", "jobs_inserted", "jobs_updated", "skipped", "failed"
    )


@query(
    "u5_existing_keys",
    f"WITH {duck_views('runs')}\nSELECT DISTINCT content_hash FROM runs WHERE run_ord = 2 AND content_hash IN"
    " (SELECT content_hash FROM runs WHERE run_ord = 0)",
)
def u5(spark, sf_dir):
    first, second = _two_runs(spark, sf_dir)
    return state.existing_keys(second, first)


@query(
    "u6_mark_stale",
    duck.with_jobs("SELECT content_hash, is_active AND last_seen_at >= TIMESTAMP '2026-05-30 00:00:00' AS is_active FROM jobs"),
)
def u6(spark, sf_dir):
    return state.mark_stale(tables.jobs(spark, sf_dir), as_of(), 48).select("content_hash", "is_active")


@query(
    "u6_stale_count",
    duck.with_jobs("SELECT count(*) AS jobs_marked_inactive FROM jobs WHERE is_active AND last_seen_at < TIMESTAMP '2026-05-31 22:00:00'"),
)
def u6_count(spark, sf_dir):
    return state.stale_count(tables.jobs(spark, sf_dir), as_of(), 2)


# --- event sources and events ---------------------------------------------------------


def _source_results(spark, sf_dir, shift):
    statuses = ("success", "empty", "blocked", "auth-required", "parser-needed", "inactive", "failed")
    status = F.expr(choose(SPARK, f"source_ord + {shift}", statuses))
    return view(spark, sf_dir, "event_sources").withColumns(
        {
            "status": status,
            "error_type": F.when(status.isin("blocked", "auth-required", "inactive", "failed"), "HTTPError"),
            "message": F.concat(F.lit("shift "), F.lit(str(shift))),
        }
    )


def _empty_sources(spark):
    return spark.createDataFrame(
        [], "id string, firm_name string, firm_kind string, source_url string, source_provider string, "
        "source_scope string, source_status string, is_active boolean, created_at timestamp, "
        "last_scraped_at timestamp, last_success_at timestamp, last_error_type string, last_error_message string"
    )


_STATUS = ("success", "empty", "blocked", "auth-required", "parser-needed", "inactive", "failed")
_S0, _S3 = (choose(DUCK, f"source_ord + {k}", _STATUS) for k in (0, 3))


@query(
    "u7_upsert_event_sources",
    f"""WITH {duck_views('event_sources')}
    SELECT source_url, CASE WHEN b = 'success' THEN 'productive' ELSE b END AS source_status, b <> 'inactive' AS is_active,
      CASE WHEN b IN ('success', 'empty', 'parser-needed') THEN '2026-06-01 00:00:00'
           WHEN a IN ('success', 'empty', 'parser-needed') THEN '2026-05-20 00:00:00' ELSE '' END AS last_success,
      CASE WHEN b IN ('success', 'empty', 'parser-needed') THEN '' ELSE 'HTTPError' END AS last_error_type
    FROM (SELECT source_url, {_S0} AS a, {_S3} AS b FROM event_sources)""",
)
def u7(spark, sf_dir):
    first = state.upsert_event_sources(_empty_sources(spark), _source_results(spark, sf_dir, 0), ["source_ord"], _earlier())
    merged = state.upsert_event_sources(first, _source_results(spark, sf_dir, 3), ["source_ord"], as_of())
    return merged.select(
        "source_url", "source_status", "is_active",
        F.coalesce(stamp("last_success_at"), F.lit("")).alias("last_success"),
        F.coalesce("last_error_type", F.lit("")).alias("last_error_type"),
    )


@query("u8_match_sources", with_events("SELECT event_id, coalesce(source_url, '') AS source_url FROM event_table"))
def u8(spark, sf_dir):
    events = with_event_columns(view(spark, sf_dir, "recruiting_events"))
    sources = source_table(spark, sf_dir)
    matched = state.match_sources(events, sources).join(
        sources.select(F.col("id").alias("source_id"), "source_url"), "source_id", "left"
    )
    return matched.select("event_id", F.coalesce("source_url", F.lit("")).alias("source_url"))


@query(
    "u8_repeated_events",
    with_events("SELECT event_id, coalesce(source_url, '') AS source_url, 1 + event_id % 3 AS copies FROM event_table"),
)
def u8_repeated(spark, sf_dir):
    """Every event up to three times: no row more, no row less."""
    events = with_event_columns(view(spark, sf_dir, "recruiting_events"))
    repeated = events.withColumn("_copy", F.expr("explode(sequence(0, cast(event_id % 3 AS int)))")).drop("_copy")
    sources = source_table(spark, sf_dir)
    matched = state.match_sources(repeated, sources).join(
        sources.select(F.col("id").alias("source_id"), "source_url"), "source_id", "left"
    )
    return matched.groupBy("event_id", F.coalesce("source_url", F.lit("")).alias("source_url")).agg(
        F.count(F.lit(1)).alias("copies")
    )


_U9_OLD, _U9_NEW = "2024-01-20 00:00:00", "2024-01-10 00:00:00"
_IN_NEW = f"starts_at >= TIMESTAMP '{_U9_NEW}'"


@query(
    "u9_upsert_events",
    with_events(
        f"SELECT event_url, CASE WHEN starts_at < TIMESTAMP '{_U9_OLD}' THEN '2024-01-12 00:00:00' ELSE '2024-01-18 00:00:00' END"
        f" AS first_seen, CASE WHEN {_IN_NEW} THEN '2024-01-18 00:00:00' ELSE '2024-01-12 00:00:00' END AS last_seen,"
        f" coalesce(ends_at, starts_at) >= CASE WHEN {_IN_NEW} THEN TIMESTAMP '2024-01-18 00:00:00'"
        " ELSE TIMESTAMP '2024-01-12 00:00:00' END AS is_active,"
        " content_hash AS id, '' AS source_id, firm_name, firm_kind, event_title, coalesce(registration_url, '') AS registration_url,"
        " source_provider, coalesce(source_event_id, '') AS source_event_id, event_type, array_to_string(audience_tags, '|') AS audience_tags,"
        " array_to_string(location, '|') AS location, location_type, strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts,"
        " coalesce(strftime(ends_at, '%Y-%m-%d %H:%M:%S'), '') AS ends, '' AS timezone, description, content_hash,"
        " strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS extracted FROM ev"
    ),
)
def u9(spark, sf_dir):
    """Two overlapping pulls by start time; together they hold every event."""
    events = with_event_columns(view(spark, sf_dir, "recruiting_events")).withColumn("source_id", F.lit(None).cast("string"))
    starts = F.col("starts_at")
    old = state.event_rows(events.filter(starts < F.lit(_U9_OLD)), F.lit("2024-01-12 00:00:00").cast("timestamp"))
    new = state.event_rows(events.filter(starts >= F.lit(_U9_NEW)), F.lit("2024-01-18 00:00:00").cast("timestamp"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return state.upsert_events(old, new).select(
        "event_url", stamp("first_seen_at").alias("first_seen"), stamp("last_seen_at").alias("last_seen"), "is_active",
        "id", text("source_id"), "firm_name", "firm_kind", "event_title", text("registration_url"), "source_provider",
        text("source_event_id"), "event_type", joined("audience_tags").alias("audience_tags"), joined("location").alias("location"),
        "location_type", stamp("starts_at").alias("starts"), F.coalesce(stamp("ends_at"), F.lit("")).alias("ends"), text("timezone"),
        "description", "content_hash", stamp("extracted_at").alias("extracted"),
    )


@query(
    "u10_event_import_summary",
    f"WITH {duck_views('recruiting_events', 'event_sources')}\n"
    "SELECT count(*) AS events_read, count_if(starts_at >= TIMESTAMP '2024-01-12') AS events_inserted,"
    " count_if(starts_at < TIMESTAMP '2024-01-12') AS events_updated,"
    " (SELECT count(*) FROM event_sources WHERE source_ord >= 20) AS sources_inserted, 0 AS skipped, 0 AS failed"
    " FROM recruiting_events",
)
def u10(spark, sf_dir):
    events, sources = view(spark, sf_dir, "recruiting_events"), view(spark, sf_dir, "event_sources")
    known = events.filter("starts_at < TIMESTAMP '2024-01-12 00:00:00'")
    return state.event_import_summary(events, known, sources, sources.filter("source_ord < 20"))


@query(
    "u10_single_source_status",
    f"WITH {duck_views('event_sources')}\nSELECT s.source_url, count(e.event_id) AS event_count,"
    " CASE WHEN count(e.event_id) > 0 THEN 'productive' ELSE 'empty' END AS status FROM event_sources s"
    " LEFT JOIN events e ON s.source_url LIKE '%/' || CAST(e.user_id AS VARCHAR) GROUP BY 1"
    " UNION ALL SELECT 'https://quiet.example.org/' || source_ord, 0, 'empty' FROM event_sources",
)
def u10_single(spark, sf_dir):
    """All sources with their events, and as many without any."""
    users = view(spark, sf_dir, "event_sources").withColumn("user_id", F.element_at(F.split("source_url", "/"), -1))
    quiet = users.withColumn("source_url", F.concat(F.lit("https://quiet.example.org/"), F.col("source_ord").cast("string")))
    brought = given(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id")).join(
        users.select("user_id", "source_url"), "user_id"
    )
    return state.single_source_status(brought, users.union(quiet)).select("source_url", "event_count", "status")


_HTTP = (401, 403, 404, 429, 500, 503)


@query(
    "u11_fetch_status",
    "SELECT page_id, CASE WHEN code = 401 OR (hs AND code = 403) THEN 'auth-required' WHEN code IN (403, 429) THEN 'blocked'"
    " WHEN code = 404 THEN 'inactive' ELSE 'failed' END AS status FROM (SELECT page_id, page_id % 4 = 0 AS hs,"
    " CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 403 ELSE 503 END"
    " AS code FROM pages)",
)
def u11(spark, sf_dir):
    code = F.expr("CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 403 ELSE 503 END")
    url = F.when(F.col("page_id") % 4 == 0, F.lit("https://app.joinhandshake.com/events/1")).otherwise(F.col("url"))
    return given(spark, sf_dir, "pages").select("page_id", state.fetch_status(url, code).alias("status"))


# --- board ---------------------------------------------------------------------------


def _jobs_by_number(spark, sf_dir):
    return listings(spark, sf_dir).select(F.col("ats_job_id").alias("id"))


def _empty_board(spark):
    return spark.createDataFrame([], board.BOARD_SCHEMA)


def _first_commands(spark, sf_dir):
    """The first command of every user and job."""
    commands = view(spark, sf_dir, "commands").withColumnRenamed("ats_job_id", "job_id")
    return best_per_key(commands, ["user_id", "job_id"], [F.col("issued_at"), F.col("command_id")])


_FIRST = """
firsts AS (SELECT * FROM commands WHERE ats_job_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)
  QUALIFY row_number() OVER (PARTITION BY user_id, ats_job_id ORDER BY issued_at, command_id) = 1)"""


@query(
    "b1_create",
    f"""WITH {duck_views('commands')},{_FIRST}
    SELECT user_id, ats_job_id AS job_id, status, CAST(row_number() OVER (PARTITION BY user_id, status ORDER BY issued_at, ats_job_id) - 1 AS BIGINT)
      AS kanban_order, CASE WHEN status = 'APPLIED' THEN strftime(issued_at, '%Y-%m-%d %H:%M:%S') ELSE '' END AS applied FROM firsts""",
)
def b1(spark, sf_dir):
    created = board.create(_empty_board(spark), _jobs_by_number(spark, sf_dir), _first_commands(spark, sf_dir))
    return _board_out(created)


@query(
    "b1_create_on_a_board",
    f"""WITH {duck_views('commands')},{_FIRST},
    board AS (SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY issued_at, ats_job_id) - 1 AS pos FROM firsts
      WHERE command_id % 2 = 0),
    tops AS (SELECT user_id, status, max(pos) AS top FROM board GROUP BY ALL)
    SELECT user_id, ats_job_id AS job_id, CASE WHEN command_id % 4 = 0 THEN 'APPLIED' ELSE status END AS status, pos AS kanban_order,
      CASE WHEN status = 'APPLIED' THEN strftime(issued_at, '%Y-%m-%d %H:%M:%S')
           WHEN command_id % 4 = 0 THEN strftime(issued_at + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') ELSE '' END AS applied
    FROM board
    UNION ALL
    SELECT f.user_id, ats_job_id, f.status, coalesce(top, -1) + row_number() OVER (PARTITION BY f.user_id, f.status ORDER BY issued_at, ats_job_id),
      CASE WHEN f.status = 'APPLIED' THEN strftime(issued_at + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') ELSE '' END
    FROM firsts f LEFT JOIN tops t ON t.user_id = f.user_id AND t.status = f.status WHERE command_id % 2 = 1""",
)
def b1_again(spark, sf_dir):
    """Half of the rows are on the board; a day later all are created again, some as
    applied."""
    firsts, n = _first_commands(spark, sf_dir), F.col("command_id")
    before = board.create(_empty_board(spark), _jobs_by_number(spark, sf_dir), firsts.filter(n % 2 == 0))
    later = firsts.withColumns(
        {"status": F.when(n % 4 == 0, "APPLIED").otherwise(F.col("status")), "issued_at": F.col("issued_at") + F.expr("INTERVAL 24 HOUR")}
    )
    return _board_out(board.create(before, _jobs_by_number(spark, sf_dir), later))


def _board_out(df):
    return df.select(
        "user_id", "job_id", "status", F.col("kanban_order").cast("bigint").alias("kanban_order"),
        F.coalesce(stamp("applied_at"), F.lit("")).alias("applied"),
    )


@query(
    "b2_patch",
    f"""WITH {duck_views('commands')},{_FIRST},
    board AS (SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY issued_at, ats_job_id) - 1 AS pos FROM firsts)
    SELECT user_id, ats_job_id AS job_id, CASE WHEN command_id % 2 = 0 THEN 'APPLIED' ELSE status END AS status,
      CAST(CASE WHEN command_id % 3 = 0 THEN 77 ELSE pos END AS BIGINT) AS kanban_order,
      CASE WHEN status = 'APPLIED' THEN strftime(issued_at, '%Y-%m-%d %H:%M:%S')
           WHEN command_id % 2 = 0 THEN '2026-06-01 00:00:00' ELSE '' END AS applied
    FROM board""",
)
def b2(spark, sf_dir):
    firsts = _first_commands(spark, sf_dir)
    created = board.create(_empty_board(spark), _jobs_by_number(spark, sf_dir), firsts)
    n = F.col("command_id")
    patches = firsts.select(
        "user_id", "job_id", F.when(n % 2 == 0, "APPLIED").alias("status"), F.lit(None).cast("string").alias("notes"),
        F.when(n % 3 == 0, 77).alias("kanban_order"), F.lit(None).cast("timestamp").alias("applied_at"),
        as_of().alias("issued_at"),
    )
    return _board_out(board.patch(created, patches))


# Patches of every field, a third of them by a user who does not own the row, and some on
# applications that do not exist.
_PATCHED = f"""
board AS (SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY issued_at, ats_job_id) - 1 AS pos,
    command_id % 3 = 1 AS foreign_user FROM firsts)"""


def _patched(spark, sf_dir):
    known = _jobs_by_number(spark, sf_dir)
    firsts = board.known_jobs(_first_commands(spark, sf_dir), known)
    created = board.create(_empty_board(spark), known, firsts)
    n = F.col("command_id")
    user = F.when(n % 3 == 1, F.concat(F.lit("not-"), F.col("user_id"))).otherwise(F.col("user_id"))
    patches = firsts.select(
        user.alias("user_id"), "job_id", F.when(n % 2 == 0, "APPLIED").alias("status"),
        F.when(n % 5 > 0, F.concat(F.lit("note "), n)).alias("notes"), F.when(n % 7 == 0, 77).alias("kanban_order"),
        F.when(n % 4 == 0, F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("applied_at"), as_of().alias("issued_at"),
    )
    unknown = patches.withColumn("job_id", F.concat(F.lit("no-"), F.col("job_id")))
    return created, patches.unionByName(unknown)


@query(
    "b2_patch_all_fields",
    f"""WITH {duck_views('commands')},{_FIRST},{_PATCHED}
    SELECT user_id, ats_job_id AS job_id, CASE WHEN command_id % 2 = 0 AND NOT foreign_user THEN 'APPLIED' ELSE status END AS status,
      CASE WHEN command_id % 7 = 0 AND NOT foreign_user THEN 77 ELSE pos END::BIGINT AS kanban_order,
      CASE WHEN command_id % 5 > 0 AND NOT foreign_user THEN 'note ' || command_id ELSE '' END AS notes,
      CASE WHEN command_id % 4 = 0 AND NOT foreign_user THEN '2025-01-01 00:00:00'
           WHEN status = 'APPLIED' THEN strftime(issued_at, '%Y-%m-%d %H:%M:%S')
           WHEN command_id % 2 = 0 AND NOT foreign_user THEN '2026-06-01 00:00:00' ELSE '' END AS applied,
      CASE WHEN foreign_user THEN strftime(issued_at, '%Y-%m-%d %H:%M:%S') ELSE '2026-06-01 00:00:00' END AS updated
    FROM board""",
)
def b2_all(spark, sf_dir):
    """Notes, explicit times and positions; foreign users and unknown rows change nothing."""
    patched = board.patch(*_patched(spark, sf_dir))
    return patched.select(
        "user_id", "job_id", "status", F.col("kanban_order").cast("bigint").alias("kanban_order"), F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce(stamp("applied_at"), F.lit("")).alias("applied"), stamp("updated_at").alias("updated"),
    )


@query(
    "b2_misses",
    f"""WITH {duck_views('commands')},{_FIRST},{_PATCHED}
    SELECT CASE WHEN foreign_user THEN 'not-' ELSE '' END || user_id AS user_id, ats_job_id AS job_id FROM board WHERE foreign_user
    UNION ALL SELECT CASE WHEN foreign_user THEN 'not-' ELSE '' END || user_id, 'no-' || ats_job_id FROM board""",
)
def b2_misses(spark, sf_dir):
    """Patches on rows that are not there for their user."""
    return board.patch_misses(*_patched(spark, sf_dir)).select("user_id", "job_id")


def _log(spark, sf_dir):
    return view(spark, sf_dir, "commands").select(
        "user_id", F.col("ats_job_id").alias("job_id"), F.lit("create").alias("kind"), "status",
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("int").alias("kanban_order"),
        F.lit(None).cast("timestamp").alias("applied_at"), "issued_at", F.col("command_id").alias("seq"),
    )


@query(
    "b3_fold_log",
    f"""WITH {duck_views('commands')}
    SELECT user_id, ats_job_id AS job_id, arg_max(status, command_id) AS status,
      coalesce(strftime(arg_min(issued_at, command_id) FILTER (status = 'APPLIED'), '%Y-%m-%d %H:%M:%S'), '') AS applied,
      strftime(arg_max(issued_at, command_id), '%Y-%m-%d %H:%M:%S') AS updated
    FROM commands WHERE ats_job_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) GROUP BY 1, 2""",
)
def b3(spark, sf_dir):
    folded = board.fold_log(_empty_board(spark), _jobs_by_number(spark, sf_dir), _log(spark, sf_dir))
    return folded.select(
        "user_id", "job_id", "status", F.coalesce(stamp("applied_at"), F.lit("")).alias("applied"),
        stamp("updated_at").alias("updated"),
    )


@query(
    "b3_positions",
    # one command of every user a step; as many steps as the longest log
    f"""WITH RECURSIVE {duck_views('commands')},
    log AS (SELECT user_id, ats_job_id AS job, status, strftime(issued_at, '%Y-%m-%d %H:%M:%S') AS at,
        row_number() OVER (PARTITION BY user_id ORDER BY command_id) AS n
      FROM commands WHERE ats_job_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)),
    steps AS (
      SELECT DISTINCT user_id, 0::BIGINT AS n, CAST([] AS STRUCT(job VARCHAR, status VARCHAR, pos BIGINT, applied VARCHAR)[]) AS board FROM log
      UNION ALL
      SELECT s.user_id, l.n, CASE WHEN len(list_filter(s.board, lambda r: r.job = l.job)) > 0
        THEN list_transform(s.board, lambda r: CASE WHEN r.job = l.job THEN struct_pack(job := r.job, status := l.status, pos := r.pos,
          applied := CASE WHEN r.applied = '' AND l.status = 'APPLIED' THEN l.at ELSE r.applied END) ELSE r END)
        ELSE list_append(s.board, struct_pack(job := l.job, status := l.status,
          pos := coalesce(list_max(list_transform(list_filter(s.board, lambda r: r.status = l.status), lambda r: r.pos)), -1) + 1,
          applied := CASE WHEN l.status = 'APPLIED' THEN l.at ELSE '' END)) END
      FROM steps s JOIN log l ON l.user_id = s.user_id AND l.n = s.n + 1
    ),
    ended AS (SELECT user_id, unnest(board) AS r FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1))
    SELECT user_id, r.job AS job_id, r.status AS status, r.pos AS kanban_order, r.applied AS applied FROM ended""",
)
def b3_positions(spark, sf_dir):
    folded = board.fold_log(_empty_board(spark), _jobs_by_number(spark, sf_dir), _log(spark, sf_dir))
    return _board_out(folded)


# --- streams --------------------------------------------------------------------------


def _landed(spark, sf_dir, df, label):
    """Land a table as files and open it as a stream."""
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _collected(spark, stream, label):
    """Run a stream over what has landed and read what it wrote."""
    out, marks = scratch_path(spark, label), scratch_path(spark, f"{label}-marks")
    running = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks)
        .trigger(availableNow=True).start(out)
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _requests(spark, sf_dir):
    return given(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id"
    )


@query(
    "st1_refresh_jobs",
    duck.with_jobs("SELECT content_hash, program_type, is_active FROM jobs"),
)
def st1(spark, sf_dir):
    empty = state.job_rows(classify.normalize(listings(spark, sf_dir).limit(0), as_of()), as_of())
    store = refresh.KeyedTable(scratch_path(spark, "jobs"), spark.createDataFrame([], empty.schema), ("content_hash",))
    blank = tables.companies(spark, sf_dir).withColumn("created_at", as_of())
    firms = refresh.KeyedTable(scratch_path(spark, "companies"), spark.createDataFrame([], blank.schema), ("name", "ats_provider",))
    stream = _landed(spark, sf_dir, listings(spark, sf_dir), "landed-jobs")
    running = refresh.refresh_jobs(
        stream, store, firms, scratch_path(spark, "letters"), as_of(), scratch_path(spark, "jobs-marks"), ["doc_id"]
    )
    running.awaitTermination()
    return store.read().select("content_hash", "program_type", "is_active")


_GREEDY = """
WITH RECURSIVE req AS (SELECT CAST(user_id AS VARCHAR) AS key, ts FROM events),
hops AS (
  SELECT key, min(ts) AS ts FROM req GROUP BY 1
  UNION ALL
  SELECT h.key, (SELECT min(r.ts) FROM req r WHERE r.key = h.key AND r.ts >= h.ts + INTERVAL 30 MINUTE)
  FROM hops h WHERE h.ts IS NOT NULL
)
SELECT key, count(ts) AS accepted FROM hops GROUP BY 1"""


@query("st2_throttle", _GREEDY)
def st2(spark, sf_dir):
    judged = refresh.throttle(_requests(spark, sf_dir), ["key"], ["ts", "event_id"])
    return judged.groupBy("key").agg(F.count_if("accepted").alias("accepted"))


@query("st2_throttle_stream", _GREEDY)
def st2_stream(spark, sf_dir):
    with _state_store(spark):
        stream = _landed(spark, sf_dir, _requests(spark, sf_dir), "requests")
        judged = _collected(
            spark, refresh.throttle_stream(stream, "key", "key string, ts timestamp, event_id bigint"), "throttled"
        )
    return judged.groupBy("key").agg(F.count_if("accepted").alias("accepted"))


_BUSY = """
WITH RECURSIVE req AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'busy' ELSE CAST(user_id AS VARCHAR) END AS key, ts FROM events),
hops AS (
  SELECT key, min(ts) AS ts FROM req GROUP BY 1
  UNION ALL
  SELECT h.key, (SELECT min(r.ts) FROM req r WHERE r.key = h.key AND r.ts >= h.ts + INTERVAL 30 MINUTE)
  FROM hops h WHERE h.ts IS NOT NULL
)
SELECT key, count(ts) AS accepted FROM hops GROUP BY 1"""


@query("st2_busy_key_stream", _BUSY)
def st2_busy_stream(spark, sf_dir):
    """A third of all requests have one key and arrive out of order."""
    busy = _requests(spark, sf_dir).withColumn("key", F.when(F.col("event_id") % 3 == 0, "busy").otherwise(F.col("key")))
    shuffled = busy.repartition(3).sortWithinPartitions(F.xxhash64("event_id"))
    with _state_store(spark):
        stream = _landed(spark, sf_dir, shuffled, "busy")
        judged = _collected(
            spark, refresh.throttle_stream(stream, "key", "key string, ts timestamp, event_id bigint"), "busy-throttled"
        )
    return judged.groupBy("key").agg(F.count_if("accepted").alias("accepted"))


class _state_store:
    """The state API needs the RocksDB provider while its query runs."""

    NAME = "spark.sql.streaming.stateStore.providerClass"
    ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, self.ROCKSDB)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(self.NAME)
        else:
            self.spark.conf.set(self.NAME, self.before)


@query(
    "st3_stale_keys",
    "SELECT CAST(user_id AS VARCHAR) AS key, max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR AS is_active FROM events GROUP BY 1",
)
def st3(spark, sf_dir):
    at = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return refresh.stale_keys(_requests(spark, sf_dir), "key", at, 12).select("key", "is_active")


@query(
    "st3_staleness_stream",
    "SELECT CAST(user_id AS VARCHAR) AS key, true AS is_active, '' AS last_seen FROM events GROUP BY 1 UNION ALL"
    " SELECT CAST(user_id AS VARCHAR), false, strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events GROUP BY 1"
    " HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
)
def st3_stream(spark, sf_dir):
    """Every key turns up once; those not sighted for twelve hours at the end go stale."""
    with _state_store(spark):
        stream = _landed(spark, sf_dir, _requests(spark, sf_dir).select("key", "ts"), "sightings")
        changes = _collected(spark, refresh.staleness_stream(stream, "key", 12), "staleness")
    last_seen = F.when(F.col("is_active"), "").otherwise(stamp("last_seen_at"))
    return changes.select("key", "is_active", last_seen.alias("last_seen"))


@query(
    "u4_import_records",
    duck.with_jobs(
        "SELECT content_hash, CASE WHEN doc_id % 4 = 0 THEN '2026-05-20 00:00:00' ELSE '2026-06-01 00:00:00' END AS first_seen,"
        " (SELECT count(*) FROM documents WHERE doc_id % 11 <> 1 AND doc_id % 4 <> 0) AS inserted,"
        " (SELECT count(*) FROM documents WHERE doc_id % 11 <> 1 AND doc_id % 4 = 0) AS updated,"
        " (SELECT count(*) FROM documents WHERE doc_id % 11 = 1) AS skipped"
        " FROM jobs WHERE doc_id % 11 <> 1 OR doc_id % 4 = 0"
    ),
)
def u4_import_records(spark, sf_dir):
    """A second import over a table that holds a quarter of the listings."""
    rows, n = listings(spark, sf_dir), F.col("doc_id")
    before = _job_rows(rows.filter(n % 4 == 0), _earlier())
    firms = tables.companies(spark, sf_dir).withColumn("created_at", _earlier()).filter("ats_provider <> 'lever'")
    spoiled = rows.withColumn("content_hash", F.when(n % 11 == 1, "").otherwise(F.col("content_hash")))
    jobs, _, summary = state.import_records(before, firms, classify.normalize(spoiled, as_of()), ["doc_id"], as_of())
    counts = summary.select(F.col("jobs_inserted").alias("inserted"), F.col("jobs_updated").alias("updated"), "skipped")
    return jobs.select("content_hash", stamp("first_seen_at").alias("first_seen")).join(F.broadcast(counts))


@query("st4_refresh_events", with_events("SELECT event_url, coalesce(source_url, '') AS source_url, is_active FROM event_table WHERE event_id % 10 <> 3"))
def st4(spark, sf_dir):
    store, sources, _ = _refreshed_events(spark, sf_dir)
    named = store.read().join(sources.read().select(F.col("id").alias("source_id"), "source_url"), "source_id", "left")
    return named.select("event_url", F.coalesce("source_url", F.lit("")).alias("source_url"), "is_active")


@query(
    "st4_source_states",
    f"""WITH {duck_views('event_sources')}
    SELECT source_url, CASE WHEN status = 'success' THEN 'productive' ELSE status END AS source_status FROM event_sources
    UNION ALL SELECT 'letter', 'event_title' FROM events WHERE event_id % 10 = 3""",
)
def st4_states(spark, sf_dir):
    """What the refresh leaves besides events: source states and dead letters."""
    _, sources, letters = _refreshed_events(spark, sf_dir)
    back = spark.read.schema("failure struct<message:string>").json(letters)
    return sources.read().select("source_url", "source_status").union(back.select(F.lit("letter"), "failure.message"))


def _refreshed_events(spark, sf_dir):
    """Every tenth landed event has no title."""
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    landed = with_event_columns(view(spark, sf_dir, "recruiting_events"))
    landed = landed.withColumn("event_title", F.when(F.col("event_id") % 10 == 3, " ").otherwise(F.col("event_title")))
    store = refresh.KeyedTable(scratch_path(spark, "events"), spark.createDataFrame([], event_table(spark, sf_dir).schema), ("content_hash",))
    sources = refresh.KeyedTable(scratch_path(spark, "event-sources"), _empty_sources(spark), ("source_url",))
    results = view(spark, sf_dir, "event_sources").withColumns(
        {"error_type": F.lit(None).cast("string"), "message": F.lit(None).cast("string")}
    )
    letters = scratch_path(spark, "event-letters")
    running = refresh.refresh_events(
        _landed(spark, sf_dir, landed, "landed-events"), store, sources, results, letters, at, scratch_path(spark, "events-marks"), ["event_id"]
    )
    running.awaitTermination()
    return store, sources, letters


@query(
    "st5_dead_letters",
    duck.with_listings(
        "SELECT CASE WHEN doc_id % 83 = 2 THEN 'ftp://x' ELSE job_url END AS source_url, CASE WHEN doc_id % 83 = 2 AND"
        " doc_id % 89 = 3 THEN 'job_title, job_url' WHEN doc_id % 83 = 2 THEN 'job_url' ELSE 'job_title' END AS message"
        " FROM listings WHERE doc_id % 83 = 2 OR doc_id % 89 = 3"
    ),
)
def st5(spark, sf_dir):
    n = F.col("doc_id")
    damaged = listings(spark, sf_dir).withColumns(
        {
            "job_url": F.when(n % 83 == 2, "ftp://x").otherwise(F.col("job_url")),
            "job_title": F.when(n % 89 == 3, " ").otherwise(F.col("job_title")),
        }
    )
    empty = state.job_rows(classify.normalize(damaged.limit(0), as_of()), as_of())
    store = refresh.KeyedTable(scratch_path(spark, "jobs"), spark.createDataFrame([], empty.schema), ("content_hash",))
    blank = tables.companies(spark, sf_dir).withColumn("created_at", as_of())
    firms = refresh.KeyedTable(scratch_path(spark, "companies"), spark.createDataFrame([], blank.schema), ("name", "ats_provider",))
    letters = scratch_path(spark, "letters")
    running = refresh.refresh_jobs(
        _landed(spark, sf_dir, damaged, "landed-damaged"), store, firms, letters, as_of(),
        scratch_path(spark, "damaged-marks"), ["doc_id"],
    )
    running.awaitTermination()
    back = spark.read.schema("recorded_at timestamp, failure struct<source_url:string,message:string>").json(letters)
    return back.select("failure.source_url", "failure.message")


_ATTEMPTS = """
WITH tries AS (
  SELECT CAST(user_id AS VARCHAR) AS source_url, event_id, ts, event_id * 7 % 10 AS k FROM events
),
told AS (
  SELECT *, k IN (0, 1, 2, 3, 4, 5) AS again,
    count_if(k > 5) OVER (PARTITION BY source_url ORDER BY ts, event_id) AS island FROM tries
),
counted AS (
  SELECT *, count_if(again) OVER (PARTITION BY source_url, island ORDER BY ts, event_id) AS n FROM told
)
"""


def _attempts(spark, sf_dir):
    """Each event is an attempt on its user's source: six of ten end in an error that is
    worth a retry, two in one that is not, two well."""
    k = F.col("event_id") * 7 % 10
    error = F.when(k < 3, "Timeout").when(k < 6, "ConnectionError").when(k < 8, "UnsupportedAtsError")
    return given(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source_url"), error.alias("error_type"),
        F.concat(F.lit("event "), "event_id").alias("message"), F.col("ts").cast("timestamp").alias("attempted_at"),
        F.col("event_id").cast("bigint").alias("ord"),
    )


@query(
    "st5_attempts",
    _ATTEMPTS + "SELECT event_id, CASE WHEN again THEN (n - 1) % 4 + 1 ELSE 0 END AS attempt,"
    " CASE WHEN again AND n % 4 = 0 THEN 'exhausted' WHEN again THEN 'retry' WHEN k < 8 THEN 'failed' ELSE 'done' END AS verdict"
    " FROM counted",
)
def st5_attempts(spark, sf_dir):
    """Attempts judged by what is known of their source."""
    with _state_store(spark):
        stream = _landed(spark, sf_dir, _attempts(spark, sf_dir), "attempts")
        judged = _collected(spark, refresh.judge_attempts(stream), "judged-attempts")
    return judged.select(F.col("ord").alias("event_id"), F.col("attempt").cast("bigint").alias("attempt"), "verdict")


@query(
    "st5_letters_of_both_kinds",
    _ATTEMPTS + "SELECT 'spent' AS kind, source_url AS subject FROM counted WHERE again AND n % 4 = 0"
    " UNION ALL SELECT 'invalid', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 10 = 3",
)
def st5_both(spark, sf_dir):
    """Invalid events and exhausted sources in one folder of letters."""
    _, _, letters = _refreshed_events(spark, sf_dir)
    with _state_store(spark):
        stream = _landed(spark, sf_dir, _attempts(spark, sf_dir), "spent-attempts")
        refresh.retry_letters(stream, letters, as_of(), scratch_path(spark, "attempt-marks")).awaitTermination()
    failure = spark.read.schema("failure struct<source_url:string,error_type:string,message:string>").json(letters).select("failure.*")
    invalid = F.col("error_type") == "ExtractionError"
    return failure.select(
        F.when(invalid, "invalid").otherwise("spent").alias("kind"),
        F.when(invalid, F.regexp_extract("source_url", r"([0-9]+)$", 1)).otherwise(F.col("source_url")).alias("subject"),
    )


@query(
    "st6_first_sightings",
    f"WITH {duck_views('runs')}\nSELECT DISTINCT content_hash FROM runs",
)
def st6(spark, sf_dir):
    sighted = view(spark, sf_dir, "runs").select("content_hash", F.col("extracted_at").alias("ts"))
    stream = _landed(spark, sf_dir, sighted, "sighted")
    return _collected(spark, refresh.first_sightings(stream, "content_hash", "90 days"), "first").select("content_hash")
