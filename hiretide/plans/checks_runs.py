"""Registered queries: routing, runs, sources and sinks (RT, C, M, V, SRC, SNK, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions import dates
from hiretide.operators import classify, routing, runs, validate
from hiretide.plans import duck_rules as duck
from hiretide.plans.dialect import DUCK, SPARK, choose
from hiretide.plans.registry import query
from hiretide.plans.standin import duck_views, given, view
from hiretide.plans.tables import as_of, joined, listings, stamp
from hiretide.session import scratch_path
from hiretide.sources import artifacts, lists, reports

# --- routing ----------------------------------------------------------------------

# Career URLs grown from the page URLs: the page number goes into the path.
_SHAPES = (
    # (URL around the page id, provider, token; '#' stands for the page id)
    ("https://boards.greenhouse.io/firm#/jobs/1", "greenhouse", "firm#"),
    ("https://boards-api.greenhouse.io/v1/boards/firm#/jobs?content=true", "greenhouse", "firm#"),
    ("https://Firm#.greenhouse.io", "greenhouse", "firm#"),
    ("https://jobs.lever.co/firm#", "lever", "firm#"),
    ("https://api.lever.co/v0/postings/firm#?mode=json", "lever", "firm#"),
    ("https://jobs.lever.co/?team=&company=firm%20#", "lever", "firm #"),
    ("https://jobs.ashbyhq.com/firm#/apply", "ashby", "firm#"),
    ("https://firm#.wd5.myworkdayjobs.com/External", "workday", "firm#"),
    ("https://www.amazon.jobs/en/search?offset=#", "amazon", "amazon"),
    ("https://www.google.com/about/careers/applications/jobs/#", "google", "google"),
    ("https://www.metacareers.com/jobs/#", "meta", "meta"),
    ("https://jobs.apple.com/en-us/search?page=#", "apple", "apple"),
    ("https://careers.walmart.com/results?page=#", "walmart", "walmart"),
    ("https://careers.homedepot.com/job-search-results/#", "mcloud", "homedepot"),
    ("https://mycareer.verizon.com/jobs/#", "verizon", "verizon"),
    ("https://explore.jobs.netflix.net/careers/#", "eightfold", "netflix"),
    ("https://careers.qualcomm.com/careers/search?start=#", "eightfold", "qualcomm"),
    ("https://jobs.smartrecruiters.com/Firm#", "smartrecruiters", "Firm#"),
    ("https://api.smartrecruiters.com/v1/companies/Firm#/postings", "smartrecruiters", "Firm#"),
    ("https://jobs.sap.com/search/?startrow=#", "successfactors", "sap"),
    ("https://careers.arm.com/search-jobs/#", "talentbrew", "careers"),
    ("https://careers.twosigma.com/careers/#", "avature", "careers"),
    ("https://www.usajobs.gov/Search/Results?d=nn&p=#", "usajobs", "nasa"),
    ("https://www.usajobs.gov/Search/Results?d=xx&p=#", None, None),
    ("https://careers.ti.com/en/sites/CX#/jobs", "oracle", "CX#"),
    ("https://firm#.fa.us2.oraclecloud.com/hcmUI", "oracle", "firm#"),
    ("https://jobs.lever.co/", None, None),
    ("https://databricks.example.com/#", None, None),
)


def _urls_sql(d) -> str:
    shape = choose(d, "page_id", [u for u, _, _ in _SHAPES])
    return f"SELECT page_id, replace({shape}, '#', CAST(page_id AS STRING)) AS source_url FROM pages"


_URLS = f"WITH urls AS ({_urls_sql(DUCK)})\n"


def urls(spark, sf_dir):
    return spark.sql(_urls_sql(SPARK).replace("FROM pages", "FROM {pages}"), pages=given(spark, sf_dir, "pages"))


def _expected(index: int) -> str:
    return (
        "replace(coalesce(" + choose(DUCK, "page_id", [s[index] for s in _SHAPES])
        + ", ''), '#', CAST(page_id AS VARCHAR))"
    )


@query(
    "rt1_route",
    _URLS + f"SELECT page_id, {_expected(1)} AS provider, {_expected(2)} AS token,"
    f" CASE WHEN {_expected(1)} = '' THEN 'UnsupportedAtsError' ELSE '' END AS error FROM urls",
)
def rt1(spark, sf_dir):
    routed = routing.route_urls(urls(spark, sf_dir))
    return routed.select(
        "page_id", F.coalesce("ats_provider", F.lit("")).alias("provider"),
        F.coalesce("board_token", F.lit("")).alias("token"), F.coalesce("error_type", F.lit("")).alias("error"),
    )


@query(
    "rt2_token_after_marker",
    "SELECT page_id, CASE WHEN split_part(url, '/', 4) IN ('en', 'fr', 'de', 'es') AND"
    " regexp_full_match(split_part(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', 3), '[A-Za-z0-9._-]+')"
    " THEN split_part(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', 3) ELSE '' END AS token FROM pages",
)
def rt2(spark, sf_dir):
    parts = routing.path_parts(F.col("url"))
    after = [routing.part_after(F.col("_parts"), lang) for lang in ("en", "fr", "de", "es")]
    pages = given(spark, sf_dir, "pages").withColumn("_parts", parts)
    return pages.select("page_id", F.coalesce(*after, F.lit("")).alias("token"))


_QUEUE = (
    "CASE WHEN regexp_matches(lower(source_url), '" + "|".join(rules.HIGH_PRIORITY_MARKERS) + "') THEN 'high'"
    " WHEN contains(lower(source_url), 'ashbyhq.com') OR contains(lower(source_url), 'myworkdayjobs.com') THEN 'slow'"
    " ELSE 'standard' END"
)


@query("rt3_choose_queue", _URLS + f"SELECT page_id, {_QUEUE} AS queue FROM urls")
def rt3(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", routing.choose_queue(F.col("source_url")).alias("queue"))


@query("rt4_urls_for_queue", _URLS + f"SELECT page_id, source_url FROM urls WHERE {_QUEUE} = 'slow'")
def rt4(spark, sf_dir):
    return routing.urls_for_queue(urls(spark, sf_dir), "slow")


@query(
    "rt5_enqueue_plan",
    _URLS + f"SELECT source_url, queue, CASE queue WHEN 'high' THEN 'high-priority company' WHEN 'slow' THEN"
    f" 'slower or browser-heavy ATS' ELSE 'default cadence' END AS reason FROM (SELECT source_url, {_QUEUE} AS queue FROM urls)",
)
def rt5(spark, sf_dir):
    return routing.enqueue_plan(urls(spark, sf_dir))


# Company names grown from the customer names.
_NAMES = ("The % Bank & Trust (US)", "% Holdings, Inc.", "%", "Acme % Labs", "DoorDash", "AI")


def _companies_sql(d) -> str:
    shape = choose(d, "c_custkey", _NAMES)
    return f"SELECT c_custkey, replace({shape}, '%', replace(c_name, 'Customer#', 'Cust ')) AS company_name FROM customer"


def _company_names(spark, sf_dir):
    sql = _companies_sql(SPARK).replace("FROM customer", "FROM {customer}")
    return spark.sql(sql, customer=given(spark, sf_dir, "customer"))


_TOKENS = """
CASE CAST(c_custkey % 6 AS INT)
  WHEN 0 THEN 'cust' || n || 'bankandtrust|cust-' || n || '-bank-and-trust|cust' || n || 'andtrust|cust-' || n || '-and-trust|cust|cust' || n || '|cust-' || n
  WHEN 1 THEN 'cust' || n || 'holdingsinc|cust-' || n || '-holdings-inc|cust' || n || '|cust-' || n || '|cust'
  WHEN 2 THEN 'cust' || n || '|cust-' || n || '|cust'
  WHEN 3 THEN 'acmecust' || n || 'labs|acme-cust-' || n || '-labs|acmecust' || n || '|acme-cust-' || n || '|acme|acmecust|acme-cust'
  WHEN 4 THEN 'doordashusa|doordash' ELSE 'ai' END"""


@query(
    "rt6_candidate_tokens",
    f"SELECT c_custkey, {_TOKENS} AS tokens FROM (SELECT c_custkey, replace(c_name, 'Customer#', '') AS n FROM customer)",
)
def rt6(spark, sf_dir):
    tokens = routing.candidate_tokens(F.col("company_name"))
    return _company_names(spark, sf_dir).select("c_custkey", joined(tokens).alias("tokens"))


def _boards(spark, sf_dir):
    """A landed board directory: every supplier runs one or two boards."""
    number = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    suppliers = given(spark, sf_dir, "supplier")
    first = suppliers.select(
        F.lit("ashby").alias("ats_provider"), F.concat(F.lit("cust"), number).alias("board_token"),
        F.col("s_suppkey").alias("job_count"),
    )
    second = suppliers.select(
        F.lit("lever").alias("ats_provider"), F.concat(F.lit("cust-"), number).alias("board_token"),
        (F.col("s_suppkey") + 1).alias("job_count"),
    )
    return first.unionByName(second)


@query(
    "rt7_discover",
    """SELECT replace(CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'The % Bank & Trust (US)' WHEN 1 THEN '% Holdings, Inc.'
      WHEN 2 THEN '%' ELSE 'x' END, '%', replace(c_name, 'Customer#', 'Cust ')) AS company_name,
      'ashby' AS ats_provider, 'https://jobs.ashbyhq.com/cust' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS source_url,
      CAST(s_suppkey AS BIGINT) AS job_count
    FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 6 IN (0, 1, 2)""",
)
def rt7(spark, sf_dir):
    hits, _ = routing.discover(_company_names(spark, sf_dir), _boards(spark, sf_dir))
    return hits.select("company_name", "ats_provider", "source_url", F.col("job_count").cast("bigint").alias("job_count"))


# --- dates -----------------------------------------------------------------------------


def _date_texts(spark, sf_dir):
    """Order dates written in the forms providers use."""
    at = F.col("o_orderdate").cast("timestamp")
    form = F.col("o_orderkey") % 8
    text = (
        F.when(form == 0, F.date_format(at, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 2, F.date_format(at, "MMMM d, yyyy"))
        .when(form == 3, F.date_format(at, "MMM  d, yyyy"))
        .when(form == 4, F.date_format(at, "yyyy-M-d"))
        .when(form == 5, F.concat(F.lit("Sun "), F.date_format(at, "MMM dd HH:mm:ss"), F.lit(" UTC "), F.date_format(at, "yyyy")))
        .when(form == 6, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise(F.lit("soon"))
    )
    return given(spark, sf_dir, "orders").withColumns({"at": at, "text": text})


@query(
    "t1_listing_timestamp",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN '' WHEN o_orderkey % 8 = 6 THEN"
    " strftime(CAST(o_orderdate AS TIMESTAMP) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')"
    " ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders",
)
def t1(spark, sf_dir):
    parsed = dates.listing_timestamp(F.col("text"))
    return _date_texts(spark, sf_dir).select("o_orderkey", F.coalesce(stamp(parsed), F.lit("")).alias("parsed"))


@query(
    "t1_epoch_timestamp",
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_seconds,"
    " strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_millis FROM events",
)
def t1_epoch(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return given(spark, sf_dir, "events").select(
        "event_id", stamp(dates.epoch_timestamp(F.unix_seconds(at))).alias("from_seconds"),
        stamp(dates.epoch_timestamp(F.unix_millis(at))).alias("from_millis"),
    )


@query(
    "t2_relative_posting",
    "SELECT o_orderkey, strftime(CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN TIMESTAMP '2026-06-01' WHEN 1 THEN"
    " TIMESTAMP '2026-05-31' WHEN 2 THEN TIMESTAMP '2026-06-01' - to_days(CAST(o_custkey % 40 AS INT))"
    " ELSE CAST(o_orderdate AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS posted FROM orders",
)
def t2(spark, sf_dir):
    form = F.col("o_orderkey") % 4
    texts = _date_texts(spark, sf_dir).withColumns(
        {
            "relative": F.when(form == 0, "Posted Today").when(form == 1, " yesterday ").when(
                form == 2, F.concat(F.lit("Posted "), (F.col("o_custkey") % 40).cast("string"), F.lit("+ Days Ago"))
            ).otherwise("Posted 5 Days Ago"),
            "absolute": F.when(form == 3, F.date_format("at", "yyyy-MM-dd")),
        }
    )
    posted = dates.posting_date(as_of(), F.col("absolute"), F.col("relative"), relative=F.col("relative"))
    return texts.select("o_orderkey", stamp(posted).alias("posted"))


def _clock_texts(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    form = F.col("event_id") % 6
    day = (
        F.when(form == 0, F.date_format(at, "MM/dd/yyyy"))
        .when(form == 1, F.concat(F.lit("Wednesday, "), F.date_format(at, "MMMM dd, yyyy")))
        .when(form == 2, F.date_format(at, "MMM. d, yyyy"))
        .when(form == 3, F.date_format(at, "d MMMM yyyy"))
        .when(form == 4, F.date_format(at, "yyyy-MM-dd"))
        .otherwise(F.date_format(at, "d MMM yyyy"))
    )
    clock = (
        F.when(form == 0, F.date_format(at, "h:mm a"))
        .when(form == 1, F.concat(F.date_format(at, "hh:mm a"), F.lit(" GMT")))
        .when(form == 2, F.concat(F.date_format(at, "h:mm"), F.lit(" "), F.when(F.hour(at) < 12, "a.m.").otherwise("p.m.")))
        .when(form == 3, F.date_format(at, "HH:mm"))
        .when(form == 4, F.date_format(at, "h a"))
        .otherwise(F.lit(None))
    )
    return given(spark, sf_dir, "events").withColumns({"at": at, "day": day, "clock": clock})


_CLOCK = (
    "CASE CAST(event_id % 6 AS INT) WHEN 4 THEN date_trunc('hour', ts) WHEN 5 THEN date_trunc('day', ts)"
    " ELSE date_trunc('minute', ts) END"
)


@query("t3_date_and_time", f"SELECT event_id, strftime({_CLOCK}, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def t3(spark, sf_dir):
    parsed = dates.date_and_time(F.col("day"), F.col("clock"))
    return _clock_texts(spark, sf_dir).select("event_id", stamp(parsed).alias("parsed"))


@query(
    "t4_event_timestamp",
    "SELECT event_id, strftime(CASE CAST(event_id % 3 AS INT) WHEN 0 THEN date_trunc('second', ts)"
    " WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
)
def t4(spark, sf_dir):
    form = F.col("event_id") % 3
    text = (
        F.when(form == 0, F.concat(F.lit("Starts at "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" in the hall")))
        .when(form == 1, F.concat(F.lit("Join us on "), F.date_format("at", "MMMM d, yyyy"), F.lit(" at "),
                                  F.date_format("at", "h:mm a"), F.lit(" or 9:59 PM")))
        .otherwise(F.date_format("at", "yyyyMMdd"))
    )
    return _clock_texts(spark, sf_dir).select("event_id", stamp(dates.event_timestamp(text)).alias("parsed"))


@query(
    "t5_calendar_timestamp",
    "SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END,"
    " '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
)
def t5(spark, sf_dir):
    text = F.when(
        F.col("event_id") % 2 == 0, F.concat(F.lit("TZID=America/New_York:"), F.date_format("at", "yyyyMMdd'T'HHmmss"), F.lit("Z"))
    ).otherwise(F.date_format("at", "yyyyMMdd"))
    return _clock_texts(spark, sf_dir).select("event_id", stamp(dates.calendar_timestamp(text)).alias("parsed"))


_DAYS = "date_diff('day', CAST(date_posted AS DATE), DATE '2026-01-20')"
_AGE = (
    f"CASE WHEN date_posted IS NULL THEN 'Fresh' WHEN {_DAYS} = -1 THEN 'Tomorrow' WHEN {_DAYS} < 0 THEN 'In ' ||"
    f" CAST(-{_DAYS} AS VARCHAR) || ' days' WHEN {_DAYS} = 0 THEN 'Today' WHEN {_DAYS} = 1 THEN '1 day'"
    f" ELSE CAST({_DAYS} AS VARCHAR) || ' days' END"
)


@query(
    "t6_age_labels",
    duck.with_listings(
        f"SELECT doc_id, age, CASE age WHEN 'Fresh' THEN 'Fresh posting' WHEN 'Today' THEN 'Posted today'"
        " WHEN 'Tomorrow' THEN 'Posts tomorrow' ELSE CASE WHEN starts_with(age, 'In ') THEN 'Posts ' || lower(age)"
        " ELSE 'Posted ' || age || ' ago' END END AS sentence, CASE WHEN age IN ('Fresh', 'Today', 'Tomorrow')"
        " OR starts_with(age, 'In ') THEN age ELSE age || ' ago' END AS compact"
        f" FROM (SELECT doc_id, {_AGE} AS age FROM listings)"
    ),
)
def t6(spark, sf_dir):
    at, posted = F.lit("2026-01-20 12:00:00").cast("timestamp"), F.col("date_posted")
    return listings(spark, sf_dir).select(
        "doc_id", dates.age_label(posted, at).alias("age"), dates.age_sentence(posted, at).alias("sentence"),
        dates.age_compact(posted, at).alias("compact"),
    )


@query(
    "t7_short_date",
    duck.with_listings("SELECT doc_id, coalesce(strftime(date_posted, '%b %-d, %Y'), 'Not available') AS shown FROM listings"),
)
def t7(spark, sf_dir):
    return listings(spark, sf_dir).select("doc_id", dates.short_date(F.col("date_posted")).alias("shown"))


# --- consolidation ------------------------------------------------------------------------


def _with_runs(select: str) -> str:
    return f"WITH {duck_views('run_sources')}\n{select}"


@query("c1_combine_jobs", _with_runs("SELECT doc_id, min(run_ord) AS run_ord FROM runs GROUP BY 1"))
def c1(spark, sf_dir):
    combined = runs.combine_jobs(view(spark, sf_dir, "runs"))
    return combined.select("doc_id", F.col("run_ord").cast("bigint").alias("run_ord"))


_COMBINED = (
    "combined AS (SELECT * FROM run_sources QUALIFY row_number() OVER (PARTITION BY ats_provider, board_token, source_url"
    " ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END,"
    " CASE WHEN status = 'success' THEN run_ord ELSE -run_ord END) = 1)"
)


def _with_combined(select: str) -> str:
    return f"WITH {duck_views('run_sources')},\n{_COMBINED}\n{select}"


@query("c2_combine_sources", _with_combined("SELECT source_url, status, run_ord, job_count FROM combined"))
def c2(spark, sf_dir):
    combined = runs.combine_sources(view(spark, sf_dir, "run_sources"))
    return combined.select("source_url", "status", F.col("run_ord").cast("bigint").alias("run_ord"), "job_count")


def _failures(spark, sf_dir):
    return view(spark, sf_dir, "run_sources").filter("status = 'failed'").select(
        "source_url", "ats_provider", "board_token", "error_type", "run_ord", "pos"
    )


@query(
    "c3_combine_failures",
    _with_combined(
        "SELECT source_url, max(run_ord) AS run_ord FROM run_sources f WHERE status = 'failed' AND NOT EXISTS"
        " (SELECT 1 FROM combined c WHERE c.source_url = f.source_url AND c.status = 'success') GROUP BY 1"
    ),
)
def c3(spark, sf_dir):
    combined = runs.combine_sources(view(spark, sf_dir, "run_sources"))
    return runs.combine_failures(_failures(spark, sf_dir), combined).select(
        "source_url", F.col("run_ord").cast("bigint").alias("run_ord")
    )


@query(
    "c4_combined_counters",
    _with_combined(
        "SELECT count(*) AS source_count, count_if(status = 'success') AS successful_source_count,"
        " count_if(status <> 'success') AS failed_source_count, (SELECT count(DISTINCT doc_id) FROM runs) AS job_count"
        " FROM combined"
    ),
)
def c4(spark, sf_dir):
    combined = runs.combine_sources(view(spark, sf_dir, "run_sources"))
    return runs.run_counters(combined, runs.combine_jobs(view(spark, sf_dir, "runs")))


@query(
    "c5_extraction_summary",
    _with_runs(
        "SELECT source_url, CASE WHEN failed THEN 'failed' ELSE 'success' END AS status,"
        " CASE WHEN failed THEN 0 ELSE n END AS job_count FROM (SELECT s.source_url, bool_or(s.status = 'failed') AS failed,"
        " CAST(max(c.n) AS BIGINT) AS n FROM run_sources s JOIN (SELECT company_name, ats_provider, count(*) AS n FROM runs"
        " GROUP BY 1, 2) c ON c.company_name = s.board_token AND c.ats_provider = s.ats_provider GROUP BY 1)"
    ),
)
def c5(spark, sf_dir):
    url = F.concat(F.lit("https://boards.example.com/"), "company_name", F.lit("/"), "ats_provider")
    requested = view(spark, sf_dir, "run_sources").select("source_url").distinct()
    found = view(spark, sf_dir, "runs").select(url.alias("source_url"))
    summary = runs.extraction_summary(requested, found, _failures(spark, sf_dir))
    return summary.select("source_url", "status", F.col("job_count").cast("bigint").alias("job_count"))


_REPLACE = ("src1", "src4", "src13")
_COMPANIES = {"src4": "SRC4"}


def _primary_and_fallback(df):
    return df.filter("run_ord = 1"), df.filter("run_ord <> 1")


@query(
    "m1_merge_sources",
    _with_runs(
        "SELECT source_url, run_ord FROM run_sources WHERE run_ord = 1 AND board_token NOT IN ('src1', 'src4', 'src13')"
        " UNION ALL SELECT source_url, run_ord FROM (SELECT * FROM run_sources WHERE run_ord <> 1 AND status = 'success'"
        " AND board_token IN ('src1', 'src4', 'src13') QUALIFY row_number() OVER (PARTITION BY board_token"
        " ORDER BY run_ord DESC, pos DESC) = 1)"
    ),
)
def m1(spark, sf_dir):
    primary, fallback = _primary_and_fallback(view(spark, sf_dir, "run_sources"))
    return runs.merge_sources(primary, fallback, _REPLACE).select("source_url", F.col("run_ord").cast("bigint").alias("run_ord"))


@query(
    "m2_merge_failures",
    _with_runs("SELECT source_url FROM run_sources WHERE run_ord = 1 AND status = 'failed'"
               " AND board_token NOT IN ('src1', 'src4', 'src13')"),
)
def m2(spark, sf_dir):
    return runs.merge_failures(_failures(spark, sf_dir).filter("run_ord = 1"), _REPLACE).select("source_url")


# 'src1' is a substring of src10..src19, as a broad token may be
_M3_TOKEN = (
    "CASE WHEN company_name = 'src4' THEN 'src4' WHEN contains(company_name, 'src1') THEN 'src1' END"
)
_MERGED = f"""
SELECT doc_id, '' AS added_token FROM runs WHERE run_ord = 1
UNION ALL
SELECT DISTINCT doc_id, {_M3_TOKEN} AS added_token FROM runs r WHERE run_ord <> 1 AND {_M3_TOKEN} IS NOT NULL
  AND doc_id NOT IN (SELECT doc_id FROM runs WHERE run_ord = 1)"""


def _merged(spark, sf_dir):
    primary, fallback = _primary_and_fallback(view(spark, sf_dir, "runs"))
    return runs.merge_jobs(primary, fallback, _REPLACE, _COMPANIES)


@query("m3_merge_jobs", _with_runs(_MERGED))
def m3(spark, sf_dir):
    return _merged(spark, sf_dir).select("doc_id", F.coalesce("added_token", F.lit("")).alias("added_token"))


@query(
    "m3_added_by_token",
    _with_runs(f"SELECT added_token, count(*) AS jobs FROM ({_MERGED}) WHERE added_token <> '' GROUP BY 1"),
)
def m3_added(spark, sf_dir):
    return runs.added_by_token(_merged(spark, sf_dir))


# Tokens as a table: customer numbers, looked for in the listings' addresses and numbers
_NUMBER_TOKENS = "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS token FROM customer"


@query(
    "m3_broad_tokens",
    _with_runs(
        f"""SELECT r.doc_id, min(t.token) AS added_token
        FROM (SELECT DISTINCT doc_id, lower(company_name || ' ' || job_url || ' ' || ats_provider || ' ' || ats_job_id) AS hay
              FROM runs WHERE run_ord <> 1) r
        JOIN ({_NUMBER_TOKENS}) t ON contains(r.hay, t.token) GROUP BY 1"""
    ),
)
def m3_broad(spark, sf_dir):
    """Thousands of broad tokens from a table."""
    fallback = view(spark, sf_dir, "runs").filter("run_ord <> 1")
    tokens = given(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("token"))
    matched = runs.with_replacement_token(fallback, tokens, {})
    return matched.select("doc_id", "added_token").distinct()


# --- validation ---------------------------------------------------------------------------


def _damaged(spark, sf_dir):
    """Listings with faults in some rows, on boards of two policies."""
    n = F.col("doc_id")
    return listings(spark, sf_dir).withColumns(
        {
            "ats_provider": F.when(n % 97 == 5, "unknown").when(n % 2 == 0, "walmart").otherwise("greenhouse"),
            "job_title": F.when(n % 89 == 3, "  ").otherwise(F.col("job_title")),
            "job_url": F.when(n % 83 == 2, "ftp://x").otherwise(F.col("job_url")),
            "content_hash": F.when(n % 79 == 1, "short").otherwise(F.col("content_hash")),
        }
    )


_DAMAGED = """
damaged AS (
  SELECT doc_id, company_name, CASE WHEN doc_id % 97 = 5 THEN 'unknown' WHEN doc_id % 2 = 0 THEN 'walmart' ELSE 'greenhouse' END AS ats_provider,
    concat_ws('|', CASE WHEN doc_id % 89 = 3 THEN 'job_title' END, CASE WHEN doc_id % 83 = 2 THEN 'job_url' END,
      CASE WHEN doc_id % 97 = 5 THEN 'ats_provider' END, CASE WHEN doc_id % 79 = 1 THEN 'content_hash' END) AS errors
  FROM listings
)"""


def _with_damaged(select: str) -> str:
    return f"WITH {duck_views('listings')},{_DAMAGED}\n{select}"


@query("v1_listing_errors", _with_damaged("SELECT doc_id, errors FROM damaged"))
def v1(spark, sf_dir):
    return validate.with_errors(_damaged(spark, sf_dir), validate.listing_errors()).select(
        "doc_id", joined("errors").alias("errors")
    )


@query("v1_event_errors", f"WITH {duck_views('recruiting_events')}\nSELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'firm_kind' ELSE '' END AS errors FROM recruiting_events")
def v1_events(spark, sf_dir):
    events = view(spark, sf_dir, "recruiting_events").withColumns(
        {"location_type": F.lit("unknown"),
         "firm_kind": F.when(F.col("event_id") % 7 == 0, "bakery").otherwise(F.col("firm_kind"))}
    )
    return events.select("event_id", joined(validate.event_errors()).alias("errors"))


_SPOILED = ("program_type", "academic_levels", "visa_status", "remote_type", "normalization_status", "confidence")


@query(
    "v1_normalization_errors",
    duck.with_listings(
        "SELECT doc_id, concat_ws('|', "
        + ", ".join(f"CASE WHEN doc_id % 13 = {i} OR doc_id % 17 = {i + 3} THEN '{name}' END" for i, name in enumerate(_SPOILED))
        + ") AS errors FROM listings"
    ),
)
def v1_normalization(spark, sf_dir):
    """Structs spoiled in one or two fields by the listing's number: a value outside its
    table, a NULL, a level that does not exist, a confidence above 1 or missing."""
    records = classify.normalize(listings(spark, sf_dir), as_of())
    n, doc = F.col("normalization"), F.col("job.doc_id")
    wrong = {
        "program_type": F.lit("wizard"), "academic_levels": F.array_append(n.academic_levels, F.lit("kindergarten")),
        "visa_status": F.lit(None).cast("string"), "remote_type": F.lit("REMOTE"), "normalization_status": F.lit(""),
        "confidence": F.when(doc % 2 == 0, F.lit(1.01)),
    }
    for i, name in enumerate(_SPOILED):
        spoiled = (doc % 13 == i) | (doc % 17 == i + 3)
        n = n.withField(name, F.when(spoiled, wrong[name]).otherwise(F.col(f"normalization.{name}")))
    return records.select(doc.alias("doc_id"), joined(validate.normalization_errors(n)).alias("errors"))


@query(
    "v2_quarantine",
    _with_damaged(
        "SELECT doc_id FROM damaged d WHERE errors = '' AND NOT EXISTS (SELECT 1 FROM damaged b WHERE b.errors <> ''"
        " AND b.ats_provider <> 'walmart' AND b.ats_provider = d.ats_provider AND b.company_name = d.company_name)"
    ),
)
def v2(spark, sf_dir):
    kept, _ = validate.quarantine(
        _damaged(spark, sf_dir), validate.listing_errors(), ["ats_provider", "company_name"]
    )
    return kept.select("doc_id")


@query("v2_dead_letters", _with_damaged("SELECT doc_id, errors FROM damaged WHERE errors <> ''"))
def v2_letters(spark, sf_dir):
    _, letters = validate.quarantine(
        _damaged(spark, sf_dir), validate.listing_errors(), ["ats_provider", "company_name"]
    )
    return letters.select("doc_id", joined("errors").alias("errors"))


_ERRORS = ("Timeout", "ExtractionError", "KeyError", "RateLimitedError", "UnsupportedAtsError", "ReadTimeout", "ConnectionError")


@query(
    "v3_retryable",
    f"SELECT event_id, error IN ('Timeout', 'ExtractionError', 'RateLimitedError', 'ReadTimeout', 'ConnectionError') AS"
    f" retry FROM (SELECT event_id, {choose(DUCK, 'event_id', _ERRORS)} AS error FROM events)",
)
def v3(spark, sf_dir):
    error = F.expr(choose(SPARK, "event_id", _ERRORS))
    return given(spark, sf_dir, "events").select("event_id", validate.retryable(error).alias("retry"))


# --- sources and sinks ----------------------------------------------------------------------


@query("src1_read_pull", _with_runs("SELECT doc_id, run_ord FROM runs"))
def src1(spark, sf_dir):
    """Writes the runs as nested artifact documents and reads them back."""
    path = scratch_path(spark, "pull-documents")
    documents = artifacts.pull_documents(view(spark, sf_dir, "runs"), "run_ord", 50)
    documents.write.partitionBy("run_ord").json(path)
    _, jobs, _ = artifacts.read_pull(spark, [f"{path}/run_ord={r}" for r in range(3)], multi_line=False)
    return jobs.select(F.col("ats_job_id").cast("bigint").alias("doc_id"), F.col("run_ord").cast("bigint").alias("run_ord"))


@query(
    "src1_documents_in_ranges",
    _with_runs("SELECT doc_id, run_ord, company_name, job_title, md5(raw_description) AS description FROM runs"),
)
def src1_ranges(spark, sf_dir):
    """Writes nested documents of 5,000 listings, a file each, and reads them in byte ranges."""
    path = scratch_path(spark, "large-documents")
    documents = artifacts.pull_documents(view(spark, sf_dir, "runs"), "run_ord", 5000)
    documents.withColumn("part", F.monotonically_increasing_id()).write.partitionBy("run_ord", "part").json(path)
    _, jobs, _ = artifacts.read_pull(spark, [f"{path}/run_ord={r}" for r in range(3)], range_bytes=1 << 20)
    return jobs.select(
        F.col("ats_job_id").cast("bigint").alias("doc_id"), F.col("run_ord").cast("bigint").alias("run_ord"),
        "company_name", "job_title", F.md5(F.col("raw_description").cast("binary")).alias("description"),
    )


@query("src1_paths_that_end_alike", _with_runs("SELECT doc_id, run_ord FROM runs"))
def src1_alike(spark, sf_dir):
    """Runs in folders whose names end, or contain, one another."""
    path, names = scratch_path(spark, "alike"), ("r", "old_r", "x/r")
    documents = artifacts.pull_documents(view(spark, sf_dir, "runs"), "run_ord", 50)
    for run, name in enumerate(names):
        documents.filter(F.col("run_ord") == run).drop("run_ord").write.json(f"{path}/{name}")
    _, jobs, _ = artifacts.read_pull(spark, [f"{path}/{name}" for name in names], multi_line=False)
    return jobs.select(F.col("ats_job_id").cast("bigint").alias("doc_id"), F.col("run_ord").cast("bigint").alias("run_ord"))


@query(
    "src2_read_normalized",
    duck.with_jobs("SELECT content_hash, program_type, array_to_string(required_skills, '|') AS skills FROM elig"),
)
def src2(spark, sf_dir):
    path = scratch_path(spark, "normalized")
    rows = listings(spark, sf_dir)
    artifacts.write_normalized(classify.normalize(rows, as_of()), rows, path, as_of())
    return _record_columns(artifacts.read_normalized(spark, [path]))


def _record_columns(records):
    n = F.col("normalization")
    return records.select(
        F.col("job.content_hash").alias("content_hash"), n.program_type.alias("program_type"),
        joined(n.required_skills).alias("skills"),
    )


@query(
    "src2_nested_documents",
    duck.with_jobs("SELECT content_hash, program_type, array_to_string(required_skills, '|') AS skills FROM elig"),
)
def src2_nested(spark, sf_dir):
    """Documents of fifty records each."""
    path = scratch_path(spark, "normalized-documents")
    records = classify.normalize(listings(spark, sf_dir), as_of())
    block = F.floor(F.col("job.doc_id") / 50).alias("block")
    records.groupBy(block).agg(
        F.collect_list(F.struct("job", "cleaned_description", "normalization", "normalization_method", "normalized_at")).alias("records")
    ).write.partitionBy("block").json(path)
    return _record_columns(artifacts.read_normalized(spark, [path], nested=True))


@query(
    "snk2_write_normalized",
    duck.with_jobs(
        "SELECT count(*) + count_if(doc_id % 10 < 6) AS source_job_count, count(*) AS normalized_job_count,"
        " count_if(doc_id % 10 < 6) AS duplicate_job_count, count_if(normalization_status = 'COMPLETE') AS complete,"
        " count_if(normalization_status = 'NEEDS_REVIEW') AS needs_review FROM jobs"
    ),
)
def snk2(spark, sf_dir):
    """Two overlapping runs as one: what is repeated falls out."""
    path = scratch_path(spark, "normalized")
    rows = listings(spark, sf_dir).withColumn("copy", F.lit(0))
    twice = rows.unionByName(rows.filter("doc_id % 10 < 6").withColumn("copy", F.lit(1)))
    artifacts.write_normalized(classify.normalize_run(twice, ["copy", "doc_id"], as_of()), twice, path, as_of())
    schema = "source_job_count bigint, normalized_job_count bigint, duplicate_job_count bigint, status_counts map<string,bigint>"
    back = spark.read.schema(schema).json(f"{path}/summary")
    status = lambda name: F.coalesce(F.try_element_at("status_counts", F.lit(name)), F.lit(0))
    return back.select(
        "source_job_count", "normalized_job_count", "duplicate_job_count", status("COMPLETE").alias("complete"),
        status("NEEDS_REVIEW").alias("needs_review"),
    )


@query("src4_read_url_list", _URLS + "SELECT source_url FROM urls")
def src4(spark, sf_dir):
    """Every URL between a comment and a blank line."""
    path = scratch_path(spark, "url-list")
    lines = urls(spark, sf_dir).select(
        F.explode(F.array(F.lit("# sources"), F.concat(F.lit("  "), "source_url", F.lit(" ")), F.lit("   "))).alias("value")
    )
    lines.write.text(path)
    return lists.read_url_list(spark, path).select("source_url")


@query(
    "src5_dedupe_urls",
    "SELECT url AS source_url, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)"
    " GROUP BY 1",
)
def src5(spark, sf_dir):
    bare = F.regexp_replace("url", "[?#].*$", "")
    marked = given(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(" \ufeff"), bare).alias("source_url"))
    return routing.dedupe_urls(marked, ["page_id"])


@query("src7_read_company_list", "SELECT c_name AS company_name FROM customer")
def src7(spark, sf_dir):
    path = scratch_path(spark, "company-list")
    numbered = F.concat((F.col("c_custkey") + 1).cast("string"), F.lit(". "), "c_name", F.lit("  "))
    header = F.lit("Top 500 companies")
    given(spark, sf_dir, "customer").select(F.explode(F.array(header, numbered)).alias("value")).write.text(path)
    return lists.read_company_list(spark, path).select("company_name")


def _letters(spark, sf_dir):
    events = view(spark, sf_dir, "recruiting_events")
    return events.select(
        F.col("starts_at").alias("recorded_at"),
        F.struct(F.col("event_url").alias("source_url"), F.lit("Timeout").alias("error_type")).alias("failure"),
    )


@query(
    "src8_recent_dead_letters",
    f"WITH {duck_views('recruiting_events')}\nSELECT event_url AS source_url FROM recruiting_events ORDER BY starts_at DESC, event_url LIMIT 5",
)
def src8(spark, sf_dir):
    path = scratch_path(spark, "dead-letters")
    lists.write_dead_letters(_letters(spark, sf_dir), path)
    return lists.recent_dead_letters(spark, path, 5).select("failure.source_url")


@query(
    "snk1_write_pull",
    _with_runs("SELECT source_url, status, run_ord, job_count FROM run_sources"),
)
def snk1(spark, sf_dir):
    path = scratch_path(spark, "pull")
    sources = view(spark, sf_dir, "run_sources").withColumn("message", F.lit(None).cast("string"))
    artifacts.write_pull(view(spark, sf_dir, "runs"), sources, _failures(spark, sf_dir), path, as_of())
    back = spark.read.json(f"{path}/sources")
    return back.select("source_url", "status", "run_ord", "job_count")


@query(
    "snk1_pull_counters",
    _with_runs(
        "SELECT count(*) AS source_count, count_if(status = 'success') AS successful_source_count,"
        " count_if(status <> 'success') AS failed_source_count, (SELECT count(*) FROM runs) AS job_count FROM run_sources"
    ),
)
def snk1_counters(spark, sf_dir):
    return runs.run_counters(view(spark, sf_dir, "run_sources"), view(spark, sf_dir, "runs"))


@query(
    "snk3_audit_csv",
    duck.with_jobs(
        "SELECT job_url, program_type, array_to_string(required_skills, '|') AS required_skills,"
        " replace(cleaned_description, chr(10), ' ') AS description_preview FROM elig"
    ),
)
def snk3(spark, sf_dir):
    """Round trip through the CSV (an empty value comes back as NULL)."""
    path = scratch_path(spark, "audit")
    records = classify.normalize(listings(spark, sf_dir), as_of())
    reports.write_audit_csv(records, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        "job_url", "program_type", *[F.coalesce(c, F.lit("")).alias(c) for c in ("required_skills", "description_preview")]
    )


@query(
    "snk4_company_counts",
    duck.with_listings("SELECT company_name, count(*) AS count FROM listings GROUP BY 1"),
)
def snk4(spark, sf_dir):
    path = scratch_path(spark, "company-counts")
    reports.write_company_counts(listings(spark, sf_dir), path)
    back = spark.read.schema("company_name string, count bigint").option("sep", "\t").csv(path)
    return back


@query(
    "snk6_write_discovery",
    "SELECT 'https://jobs.ashbyhq.com/cust' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS value"
    " FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 6 IN (0, 1, 2)",
)
def snk6(spark, sf_dir):
    path = scratch_path(spark, "discovery")
    hits, unmatched = routing.discover(_company_names(spark, sf_dir), _boards(spark, sf_dir))
    lists.write_discovery(hits, unmatched, path)
    return spark.read.text(f"{path}/sources")
