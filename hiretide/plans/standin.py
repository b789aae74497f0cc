"""Listings, runs, boards and events derived from the given tables.

The listing and event models come without a corpus, so every row of ``documents``
becomes a listing, every row of ``orders`` a board command and every row of
``events`` a recruiting event.  Each derivation is one projection, rendered for
Spark and for the DuckDB check from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hiretide.plans.dialect import DUCK, SPARK, Duck, choose

AS_OF = "2026-06-01 00:00:00"

TITLES = (
    "Software Engineering Intern, Summer 2026", "Senior Backend Engineer", "Data Scientist",
    "Retail Sales Associate", "New Grad Software Engineer", "Accountant, International",
    "Cloud Engineer / Platform", "Marketing Engineer", "Network Technician", "Summer Analyst",
    "Quantitative Researcher", "Warehouse Worker", "Solutions Architect", "Product Manager",
    "PhD Machine Learning Intern", "Customer Success Manager II", "Systems-Engineer Co-op",
    "Staff Nurse", "Entry Level QA Engineer", "Legal Counsel", "Front-End Developer",
    "Truck Driver", "Data Analyst",
)
PHRASES = (
    "Please apply online.",
    "We sponsor visas. Python, React and SQL required. Minimum GPA of 3.2.",
    "Must be legally authorized to work in the United States. Java or Go.",
    "Undergrad students graduating in 2026 through 2030 are welcome. Fully remote.",
    "We cannot sponsor. Security clearance required. Hybrid schedule.",
    "Nice to have: Docker, Kubernetes (k8s), C++. On-site, in office.",
    "OPT/CPT candidates are welcome. PhD or master's degree, class of 2027.",
    "Work from home. 5+ years of experience with AWS, Rust and Node.js.",
    "Visa questions: ask us. GPA 4.9 minimum. Bonus: TypeScript, Redis.",
    "We are an equal opportunity employer and value diversity at our company.",
    "Sophomore or junior standing; final year students may apply for fall 2028.",
    "Reasonable accommodation is available on request. Polygraph needed.",
    "Preferred qualifications: GraphQL, PostgreSQL. 3.75 GPA preferred.",
    "MBA degree in 2025 or 2026. Golang, C# and Swift. Distributed team.",
    "Our tower was finished in 2031.",
    "Equal Employment Opportunity notice. EEO statement follows.",
    "10 years of trust-building; go-to-market planning; no rusty javascripts.",
    "Sponsorship is available. Internship for recent graduate hires. Ruby on Linux.",
    "Built for -cloud- teams and -software- lovers.",
)
PROVIDER_CYCLE = ("greenhouse", "lever", "ashby")


def listings_sql(d: Duck) -> str:
    n = "doc_id"
    location = (
        f"CASE WHEN {n} % 11 = 0 THEN {d.array(d.text('London, UK'), d.text('Hybrid'))} "
        f"WHEN lang = 'fr' THEN {d.array(d.text('Paris, France'))} "
        f"WHEN lang = 'de' THEN {d.array(d.text('Berlin, Germany'))} "
        f"WHEN lang = 'es' THEN {d.array(d.text('Madrid, Spain'))} "
        f"WHEN {n} % 2 = 0 THEN {d.array(d.text('New York, NY'), d.text('Remote'))} "
        f"ELSE {d.array(d.text('Austin, TX, USA'))} END"
    )
    departments = (
        f"CASE CAST({n} % 5 AS INT) WHEN 0 THEN {d.empty_strings()} "
        f"WHEN 1 THEN {d.array(d.text('Engineering'))} "
        f"WHEN 2 THEN {d.array(d.text('Software and Services'))} "
        f"WHEN 3 THEN {d.array(d.text('Data Science'), d.text('Research'))} "
        f"ELSE {d.array(d.text('Stores'))} END"
    )
    title = choose(d, n, TITLES)
    base = f"TIMESTAMP '2026-01-01 00:00:00'"
    return f"""
    SELECT doc_id, source AS company_name, {title} AS job_title,
      'https://boards.example.com/' || source || '/jobs/' || CAST({n} AS STRING) AS job_url,
      {choose(d, n, PROVIDER_CYCLE)} AS ats_provider,
      CAST({n} AS STRING) AS ats_job_id,
      {location} AS location,
      CASE WHEN {n} % 41 = 0 THEN '' ELSE text || chr(10) || {choose(d, f"{n} * 7 + 3", PHRASES)} END
        AS raw_description,
      CAST(NULL AS STRING) AS description_html,
      {choose(d, n, (None, "Intern", "Full-time", "Contract"))} AS employment_type,
      {departments} AS departments,
      CASE WHEN {n} % 7 = 0 THEN NULL ELSE {d.ts(base)} + {d.hours(f"{n} % 8760")} END AS date_posted,
      {d.sha256(f"{title} || '|' || source || '|' || CAST({n} AS STRING)")} AS content_hash,
      {d.ts("TIMESTAMP '2026-05-01 00:00:00'")} + {d.hours(f"{n} % 48")} AS extracted_at
    FROM documents
    """


def runs_sql(d: Duck) -> str:
    """Three overlapping runs: every listing is in one to three of them."""
    member = (
        f"CASE WHEN doc_id % 10 < 3 THEN {d.array('0', '1', '2')} "
        f"WHEN doc_id % 10 < 6 THEN {d.array('0', '1')} "
        f"WHEN doc_id % 10 < 8 THEN {d.array('1', '2')} ELSE {d.array('2')} END"
    )
    return f"SELECT {d.unnest(member)} AS run_ord, doc_id AS pos, l.* FROM listings l"


def sources_sql(d: Duck) -> str:
    """Per-run source results: one row per company and run, some failed."""
    mix = "CAST(substring(company_name, 4) AS INT) * 3 + run_ord * 5"
    return f"""
    SELECT run_ord, company_name AS board_token, ats_provider,
      'https://boards.example.com/' || company_name || '/' || ats_provider AS source_url,
      CASE WHEN ({mix}) % 4 = 0 THEN 'failed' ELSE 'success' END AS status,
      CASE WHEN ({mix}) % 4 = 0 THEN 'ExtractionError' END AS error_type,
      count(*) AS job_count, min(pos) AS pos
    FROM runs GROUP BY run_ord, company_name, ats_provider
    """


def commands_sql(d: Duck) -> str:
    """Board commands from orders over all listings and fifty ids that no listing has;
    a status only moves when the priority says so."""
    status = (
        "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'OFFER' "
        "WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'REJECTED' "
        "WHEN o_orderstatus = 'F' THEN 'FINAL' "
        "WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'TECHNICAL' "
        "WHEN o_orderstatus = 'P' THEN 'PHONE_SCREEN' "
        "WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'APPLIED' "
        "ELSE 'SAVED' END"
    )
    return f"""
    SELECT o_orderkey AS command_id, CAST(o_custkey AS STRING) AS user_id,
      CAST(CAST(o_orderkey * 7919 % (SELECT max(doc_id) + 51 FROM documents) AS BIGINT) AS STRING) AS ats_job_id, {status} AS status,
      {d.ts("o_orderdate")} AS issued_at
    FROM orders
    """


EVENT_TITLES = {
    "view": "Campus Career Fair for Students",
    "click": "Engineering Info Session at the Office",
    "purchase": "Virtual Software Workshop with Amazon Web Services",
    "signup": "Women in Tech Networking Night",
    "error": "Early Career Webinar with NVIDIA",
}
EVENT_FIRMS = (
    ("Google", "technology"), ("Morgan Stanley", "finance"), ("NASA", "government"),
    ("Amazon", "technology"), ("Northrop Grumman", "industrial"), ("Public Campus Events", "other"),
    ("Meta", "technology"),
)


def recruiting_events_sql(d: Duck) -> str:
    arms = " ".join(f"WHEN {d.text(k)} THEN {d.text(v)}" for k, v in EVENT_TITLES.items())
    firm = choose(d, "user_id", [f for f, _ in EVENT_FIRMS])
    kind = choose(d, "user_id", [k for _, k in EVENT_FIRMS])
    title = f"CASE event_type {arms} END || ' ' || CAST(event_id AS STRING)"
    return f"""
    SELECT event_id, {firm} AS firm_name, {kind} AS firm_kind, {title} AS event_title,
      'https://events.example.com/' || CAST(user_id AS STRING) || '/' || CAST(event_id AS STRING) AS event_url,
      CASE WHEN event_id % 3 = 0 THEN 'https://rsvp.example.org/' || CAST(user_id AS STRING) END AS registration_url,
      'company_events' AS source_provider, CAST(event_id AS STRING) AS source_event_id,
      {d.ts("ts")} AS starts_at,
      CASE WHEN event_id % 4 = 0 THEN NULL ELSE {d.ts("ts")} + {d.hours("1 + event_id % 5")} END AS ends_at,
      'Join us. Value ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '.' AS description,
      props AS raw_payload, user_id,
      {d.sha256("CAST(event_id AS STRING)")} AS content_hash
    FROM events
    """


def event_sources_sql(d: Duck) -> str:
    """One source per user: its first event names the firm."""
    firm = choose(d, "user_id", [f for f, _ in EVENT_FIRMS])
    kind = choose(d, "user_id", [k for _, k in EVENT_FIRMS])
    return f"""
    SELECT min(event_id) AS source_ord, {firm} AS firm_name, {kind} AS firm_kind,
      CASE WHEN user_id % 5 = 0 THEN 'https://rsvp.example.org/' || CAST(user_id AS STRING)
           WHEN user_id % 5 = 1 THEN 'https://events.example.com/firm/' || CAST(user_id AS STRING)
           ELSE 'https://careers.example.net/' || CAST(user_id AS STRING) END AS source_url,
      'company_events' AS source_provider,
      {choose(d, "user_id", ("company_page", "university_calendar", "candidate"))} AS source_scope,
      {choose(d, "user_id", ("success", "empty", "blocked", "auth-required", "parser-needed", "inactive", "failed"))}
        AS status
    FROM events GROUP BY user_id
    """


# name -> (sql, names it reads)
VIEWS = {
    "listings": (listings_sql, ("documents",)),
    "runs": (runs_sql, ("listings",)),
    "run_sources": (sources_sql, ("runs",)),
    "commands": (commands_sql, ("orders", "documents")),
    "recruiting_events": (recruiting_events_sql, ("events",)),
    "event_sources": (event_sources_sql, ("events",)),
}


# tables whose rows carry whole texts
TEXT_TABLES = ("documents", "pages")
TEXT_PARTITIONS = "spark.hiretide.textPartitions"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored; a caller who knows that its text tables come in too
    few splits may name a number of partitions (bench.py does)."""
    scan, wanted = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get(TEXT_PARTITIONS, None)
    return scan.repartition(int(wanted)) if wanted and name in TEXT_TABLES else scan


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame (no temp views are left behind)."""
    if name not in VIEWS:
        return given(spark, sf_dir, name)
    sql, reads = VIEWS[name]
    text = sql(SPARK)
    for source in reads:
        text = text.replace(f"FROM {source}", "FROM {" + source + "}")
    return spark.sql(text, **{source: view(spark, sf_dir, source) for source in reads})


def duck_views(*names: str) -> str:
    """WITH clause text that defines the named views for DuckDB."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for upstream in VIEWS[name][1]:
                need(upstream)
            ordered.append(name)

    for name in names:
        need(name)
    return ",\n".join(f"{n} AS ({VIEWS[n][0](DUCK)})" for n in ordered)
