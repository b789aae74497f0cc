"""Registered queries: provider payloads (PAY0-PAY22).

Every listing is written into payloads of each provider's shape, twenty to a page,
and mapped back; the checks state the expected listings straight from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hiretide import names
from hiretide.operators import payloads
from hiretide.plans.dialect import DUCK, SPARK, choose
from hiretide.plans.duck_rules import tidy
from hiretide.plans.registry import query
from hiretide.plans.standin import duck_views
from hiretide.plans.tables import as_of, joined, listings, stamp

PER_PAGE = 20
_c = F.col


def _n():
    return F.col("doc_id")


def _page_id():
    return F.floor(_n() / PER_PAGE)


def _url(template: str):
    return F.replace(F.lit(template), F.lit("#"), _page_id().cast("string"))


def _boards(spark, sf_dir, job, wrap, url, token, extra=None):
    """Pages of twenty listings: ``job`` is the item text, ``wrap`` = (before,
    between, after); ``url`` holds '#' for the page number."""
    before, between, after = wrap
    rows = listings(spark, sf_dir).select(
        _page_id().alias("page_ord"), "doc_id", _url(url).alias("source_url"), F.expr(token).alias("board_token"), job.alias("item"),
        *(extra or []),
    )
    more = [c for c in rows.columns if c not in ("page_ord", "doc_id", "source_url", "board_token", "item")]
    grouped = rows.groupBy("page_ord", "source_url", "board_token", *more).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items")
    )
    body = F.concat(F.lit(before), F.array_join(F.transform("items", lambda x: x["item"]), between), F.lit(after))
    return grouped.select("source_url", "board_token", "page_ord", *more, body.alias("payload"))


def _obj(**fields):
    shaped = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]
    return F.to_json(F.struct(*shaped))


def _named(value, *path):
    """value nested as an object under the given keys."""
    for key in reversed(path):
        value = F.struct(value.alias(key))
    return value


def _token(*tokens):
    """Board token by page."""
    return choose(SPARK, f"doc_id div {PER_PAGE}", tokens)


def _out(df):
    return df.select(
        "company_name", "job_title", "job_url", "ats_job_id", joined("location").alias("location"), "raw_description",
        F.coalesce("employment_type", F.lit("")).alias("employment_type"), joined("departments").alias("departments"),
        F.coalesce(stamp("date_posted"), F.lit("")).alias("posted"), "content_hash",
    )


_WHEN = "coalesce(strftime(date_posted, '%Y-%m-%d %H:%M:%S'), '')"
_DAY = "coalesce(strftime(date_trunc('day', date_posted), '%Y-%m-%d %H:%M:%S'), '')"
_BODY = tidy("raw_description")
_LOC = "array_to_string(location, '|')"
_DEP = "array_to_string(departments, '|')"
_EMP = "coalesce(employment_type, '')"
_ID = "ats_job_id"
_BLOCK = f"doc_id // {PER_PAGE}"


def _expect(company: str, url: str, number=_ID, location=_LOC, body=_BODY, employment=_EMP, departments=_DEP, posted=_WHEN,
            title="job_title", where="true") -> str:
    return f"""WITH {duck_views('listings')}
    SELECT *, sha256(job_title || '|' || company_name || '|' || ats_job_id) AS content_hash FROM (
      SELECT {company} AS company_name, {title} AS job_title, {url} AS job_url, {number} AS ats_job_id, {location} AS location,
        {body} AS raw_description, {employment} AS employment_type, {departments} AS departments, {posted} AS posted
      FROM listings WHERE {where})"""


def _by_token(*values: str) -> str:
    return choose(DUCK, _BLOCK, values)




def _html():
    return F.concat(F.lit("<p>"), "raw_description", F.lit("</p>"))


def _iso():
    return F.date_format("date_posted", "yyyy-MM-dd'T'HH:mm:ss'Z'")




def _register(name: str, provider: str, boards, check: str) -> None:
    @query(name, check)
    def build(spark, sf_dir):
        landed = boards(spark, sf_dir)
        pages, details = landed if isinstance(landed, tuple) else (landed, None)
        return _out(payloads.map_landed(pages, provider, as_of(), details))


# --- PAY0: the shared listing record -------------------------------------------------


@query(
    "pay0_build_listing",
    f"WITH {duck_views('listings')}\nSELECT content_hash, CASE WHEN doc_id % 3 = 0 THEN 'Unspecified' ELSE company_name END AS location FROM listings",
)
def pay0(spark, sf_dir):
    flat = listings(spark, sf_dir).select(
        F.lit("x").alias("source_url"), F.lit("x").alias("board_token"), _n().alias("page_ord"), F.lit(0).alias("pos"),
        _c("company_name").alias("_company"), _c("job_title").alias("_title"), _c("job_url").alias("_url"),
        _c("ats_job_id").alias("_number"), F.array_compact(F.array(F.when(_n() % 3 != 0, _c("company_name")))).alias("_location"),
        _c("raw_description").alias("_markup"),
    )
    built = payloads._listing(flat, "lever", as_of(), ["source_url", "board_token", "page_ord"])
    return built.select("content_hash", joined("location").alias("location"))


# --- JSON providers --------------------------------------------------------------------

_register(
    "pay1_greenhouse", "greenhouse",
    lambda spark, d: _boards(
        spark, d,
        _obj(
            id="doc_id", title="job_title", absolute_url=F.when(_n() % 2 == 0, F.concat(F.lit(" "), "job_url")), content=_html(), updated_at=_iso(),
            location=F.when(_n() % 3 != 0, _named(F.get("location", F.lit(0)), "name")),
            offices=F.transform("location", lambda x: F.struct(x.alias("name"))),
            departments=F.transform("departments", lambda x: F.struct(x.alias("name"))),
        ),
        ('{"name":"Payload Co","jobs":[', ",", "]}"), "https://boards.greenhouse.io/page#", _token("xai", "n26", "newfirm"),
    ),
    _expect(
        _by_token("xAI", "N26", "Payload Co"),
        f"CASE WHEN doc_id % 2 = 0 THEN job_url ELSE 'https://boards.greenhouse.io/' || {_by_token('xai', 'n26', 'newfirm')} || '/jobs/' || ats_job_id END",
        location=f"CASE WHEN doc_id % 3 <> 0 THEN location[1] ELSE {_LOC} END", employment="''",
    ),
)

_register(
    "pay2_lever", "lever",
    lambda spark, d: _boards(
        spark, d,
        _obj(
            id="ats_job_id", text="job_title", hostedUrl="job_url", createdAt=F.unix_millis("date_posted"),
            categories=F.struct(
                F.get("location", F.lit(0)).alias("location"), F.lit("Core").alias("team"),
                F.get("departments", F.lit(0)).alias("department"), F.col("employment_type").alias("commitment"),
            ),
            descriptionPlain="raw_description", additionalPlain=F.lit("<b>More</b>"),
            lists=F.array(F.struct(F.lit("Needs").alias("text"), F.lit("<li>One</li><li>Two</li>").alias("content"))),
        ),
        ("[", ",", "]"), "https://jobs.lever.co/page#", _token("shieldai", "new-2k-firm"),
    ),
    _expect(
        _by_token("Shield AI", "New 2K Firm"), "job_url", location="location[1]",
        body=f"trim({_BODY} || chr(10) || chr(10) || 'More' || chr(10) || chr(10) || 'Needs' || chr(10) || chr(10) || 'One' || chr(10) || 'Two', chr(10))",
        departments="concat_ws('|', 'Core', departments[1])",
    ),
)

_register(
    "pay3_ashby", "ashby",
    lambda spark, d: _boards(
        spark, d,
        _obj(
            id="ats_job_id", title="job_title", isListed=F.when(_n() % 4 == 0, F.lit(None)).otherwise(_n() % 5 != 0), descriptionHtml=_html(),
            jobUrl=F.when(_n() % 2 == 0, _c("job_url")), publishedAt=_iso(), location=F.lit(" "), locations="location",
            employmentType="employment_type", department=_named(F.lit("Platform"), "name"), team=F.get("departments", F.lit(0)),
        ),
        ('{"organizationName":"Org","jobs":[', ",", "]}"), "https://jobs.ashbyhq.com/page#", _token("1password", "acme-labs"),
    ),
    _expect(
        _by_token("1Password", "Org"),
        f"CASE WHEN doc_id % 2 = 0 THEN job_url ELSE 'https://jobs.ashbyhq.com/' || {_by_token('1password', 'acme-labs')} || '/' || ats_job_id END",
        departments="concat_ws('|', 'Platform', departments[1])", where="doc_id % 4 = 0 OR doc_id % 5 <> 0",
    ),
)


def _workday_boards(spark, sf_dir):
    path = F.concat(F.lit("/job/Some-Role_"), F.col("ats_job_id"), F.lit("_R"), F.col("ats_job_id"))
    job = _obj(
        title=F.when(_n() % 2 == 0, _c("job_title")), externalPath=path, bulletFields=F.when(_n() % 3 == 0, F.array(F.concat(F.lit("REQ"), "ats_job_id"))),
        postedOn=F.when(_n() % 4 == 0, "Posted Yesterday").otherwise("Posted 3 Days Ago"), locationsText=F.get("location", F.lit(0)),
    )
    return _boards(
        spark, sf_dir, job, ('{"total":9,"jobPostings":[', ",", "]}"), "https://jll.wd1.myworkdayjobs.com/en-US/Site#", _token("jll", "some-firm"),
        extra=[F.lit("jobFamilyGroup").alias("facet_parameter"), F.concat(F.lit("Family "), (_page_id() % 3).cast("string")).alias("facet_descriptor")],
    )


_WD_TITLE = "CASE WHEN doc_id % 2 = 0 THEN job_title ELSE 'Some Role ' || ats_job_id END"

_register(
    "pay4_workday", "workday", _workday_boards,
    _expect(
        _by_token("Jones Lang LaSalle", "Some Firm"),
        f"'https://jll.wd1.myworkdayjobs.com/Site' || CAST({_BLOCK} AS VARCHAR) || '/job/Some-Role_' || ats_job_id || '_R' || ats_job_id",
        number="CASE WHEN doc_id % 3 = 0 THEN 'REQ' || ats_job_id ELSE 'Some-Role_' || ats_job_id || '_R' || ats_job_id END",
        location="location[1]", title=_WD_TITLE, body=_WD_TITLE, employment="''",
        departments=f"'Family ' || CAST({_BLOCK} % 3 AS VARCHAR)",
        posted="CASE WHEN doc_id % 4 = 0 THEN '2026-05-31 00:00:00' ELSE '2026-05-29 00:00:00' END",
    ),
)


@query(
    "pay5_workday_merge",
    f"""WITH {duck_views('listings')}
    SELECT 'REQ' || ats_job_id AS ats_job_id, CASE WHEN doc_id % 2 = 0 THEN 'Detail' ELSE 'Family A' END AS departments,
      CASE WHEN doc_id % 2 = 0 THEN {_BODY} ELSE job_title END AS raw_description,
      CASE WHEN doc_id % 2 = 0 THEN '2026-05-18 00:00:00' ELSE '2026-05-27 00:00:00' END AS posted FROM listings""",
)
def pay5(spark, sf_dir):
    """Two slices of the same postings, and landed details for half of them."""
    path = F.concat(F.lit("/job/"), F.col("ats_job_id"))
    job = _obj(jobReqId=F.concat(F.lit("REQ"), "ats_job_id"), title="job_title", externalPath=path, postedOn=F.lit("Posted 5 Days Ago"))

    def slices(facet: str, shift: int):
        pages = _boards(spark, sf_dir, job, ('{"jobPostings":[', ",", "]}"), "https://x.wd1.myworkdayjobs.com/Site", _token("x"),
                        extra=[F.lit("jobFamilyGroup").alias("facet_parameter"), F.lit(facet).alias("facet_descriptor")])
        return pages.withColumn("page_ord", F.col("page_ord") + shift)

    boards = slices("Family A", 0).unionByName(slices("Family B", 1 << 40))
    info = F.struct(_c("raw_description").alias("jobDescription"), F.lit("Detail").alias("jobFamily"), F.lit("2026-05-18").alias("startDate"))
    details = listings(spark, sf_dir).filter((_n() % 2 == 0) & (_c("raw_description") != "")).select(
        F.lit("https://x.wd1.myworkdayjobs.com/Site").alias("source_url"), path.alias("detail_key"), F.to_json(info).alias("payload")
    )
    blank = listings(spark, sf_dir).filter((_n() % 2 == 0) & (_c("raw_description") == "")).select(
        F.lit("https://x.wd1.myworkdayjobs.com/Site").alias("source_url"), path.alias("detail_key"),
        F.lit('{"jobDescription":"<br>","jobFamily":"Detail","startDate":"2026-05-18"}').alias("payload"),
    )
    mapped = payloads.map_landed(boards, "workday", as_of(), details.unionByName(blank))
    return mapped.select("ats_job_id", joined("departments").alias("departments"), "raw_description", stamp("date_posted").alias("posted"))


_register(
    "pay6_amazon", "amazon",
    lambda spark, d: _boards(
        spark, d,
        _obj(
            id_icims=F.when(_n() % 2 == 0, _c("ats_job_id")), job_path=F.concat(F.lit("/en/jobs/"), "ats_job_id"), title="job_title",
            description="raw_description", basic_qualifications=F.lit("<b>Basic</b>"), preferred_qualifications=F.lit(""),
            normalized_location=F.get("location", F.lit(0)), job_type="employment_type", team=F.get("departments", F.lit(0)),
            business_category=F.lit("retail"), posted_date=F.date_format("date_posted", "MMMM d, yyyy"),
        ),
        ('{"hits":9,"jobs":[', ",", "]}"), "https://www.amazon.jobs/en/search#", _token("amazon"),
    ),
    _expect(
        "'Amazon'", "'https://www.amazon.jobs/en/jobs/' || ats_job_id", number="CASE WHEN doc_id % 2 = 0 THEN ats_job_id ELSE '/en/jobs/' || ats_job_id END",
        location="location[1]", body=f"trim({_BODY} || chr(10) || 'Basic', chr(10))",
        departments="coalesce(departments[1], 'retail')", posted=_DAY,
    ),
)


def _google_boards(spark, sf_dir):
    """Even pages hold positional data blocks, odd pages only sign-in links."""
    js = lambda v: F.to_json(F.array(v))  # noqa: E731  a JSON string inside one-element brackets
    inner = lambda v: F.regexp_replace(F.regexp_replace(js(v), r"^\[", ""), r"\]$", "")
    record = F.concat(
        F.lit("["), inner(_c("ats_job_id")), F.lit(","), inner(_c("job_title")), F.lit(',"https://www.google.com/about/careers/signin?jobId='),
        "ats_job_id", F.lit('",[null,"<p>Resp</p>"],[null,"<p>Qual</p>"],"c",null,'), inner(F.coalesce(F.get("departments", F.lit(0)), F.lit(""))),
        F.lit(',"en",[['), inner(F.get("location", F.lit(0))), F.lit(',["x"]],[" "]],[null,'), inner(_html()), F.lit("],[2],["),
        F.coalesce(F.unix_seconds("date_posted").cast("string"), F.lit("null")), F.lit(",24000000],[1],[1]]"),
    )
    links = F.concat(
        F.lit('<a href="https://www.google.com/about/careers/applications/signin?jobId\\u003d'), "ats_job_id", F.lit("&amp;loc=US&amp;title="),
        F.url_encode("job_title"), F.lit('">x</a>'),
    )
    even = _page_id() % 2 == 0
    item = F.when(even, F.concat(F.lit("<script>AF_initDataCallback({key: 'ds:1', hash: '2', data:[["), record, F.lit("]], sideChannel: {}});</script>")))
    return _boards(spark, sf_dir, item.otherwise(links), ("<html>", "", "</html>"), "https://www.google.com/about/careers/applications/jobs/results?page=#", _token("google"))


_EVEN = f"{_BLOCK} % 2 = 0"
_register(
    "pay7_google", "google", _google_boards,
    _expect(
        "'Google'",
        f"CASE WHEN {_EVEN} THEN 'https://www.google.com/about/careers/signin?jobId=' || ats_job_id ELSE 'https://www.google.com/about/careers/applications/signin?jobId=' || ats_job_id || '&loc=US&title=' || replace(replace(replace(job_title, ' ', '+'), ',', '%2C'), '/', '%2F') END",
        location=f"CASE WHEN {_EVEN} THEN location[1] ELSE 'US' END",
        body=f"CASE WHEN {_EVEN} THEN trim({_BODY} || chr(10) || 'Qual' || chr(10) || 'Resp', chr(10)) ELSE job_title END", employment="''",
        departments=f"CASE WHEN {_EVEN} THEN coalesce(departments[1], '') ELSE '' END", posted=f"CASE WHEN {_EVEN} THEN {_WHEN} ELSE '' END",
    ),
)


def _apple_boards(spark, sf_dir):
    job = _obj(
        id=F.when(_n() % 2 == 0, F.concat(F.lit("PIPE-"), "ats_job_id")).otherwise(_c("ats_job_id")), positionId=F.concat(F.lit("9"), "ats_job_id"),
        postingTitle="job_title", jobSummary="raw_description", transformedPostingTitle=F.lit("a-role"), type="employment_type",
        postExternal=F.when(_n() % 6 == 0, F.lit(False)), postDateInGMT=_iso(), team=F.struct(F.lit("Soft ware").alias("teamName"), F.lit("SF&T").alias("teamCode")),
        locations=F.array(F.struct(F.get("location", F.lit(0)).alias("name"), F.lit("X").alias("countryName")), F.struct(F.lit("").alias("name"), F.lit("Y").alias("countryName"))),
    )
    pages = _boards(spark, sf_dir, job, ('{"loaderData":{"a":1,"search":{"searchResults":[', ",", '],"totalRecords":3}}}'),
                    "https://jobs.apple.com/en-us/search?page=#", _token("apple"))
    literal = F.regexp_replace(F.regexp_replace(F.to_json(F.array("payload")), r"^\[", ""), r"\]$", "")
    return pages.withColumn("payload", F.concat(F.lit("<script>window.__data = JSON.parse("), literal, F.lit(");</script>")))


_register(
    "pay8_apple", "apple", _apple_boards,
    _expect(
        "'Apple'", "'https://jobs.apple.com/en-us/details/' || CASE WHEN doc_id % 2 = 0 THEN '9' ELSE '' END || ats_job_id || '/a-role?team=SF%26T'",
        number="CASE WHEN doc_id % 2 = 0 THEN 'PIPE-' ELSE '' END || ats_job_id", location="location[1] || ', X|Y'",
        body=f"CASE WHEN raw_description = '' THEN job_title ELSE {_BODY} END", departments="'Soft ware'", where="doc_id % 6 <> 0",
    ),
)


def _meta_boards(spark, sf_dir):
    url = "https://www.metacareers.com/jobs#"
    job = _obj(id="ats_job_id", title="job_title", locations="location", teams="departments", sub_teams=F.array(F.lit("Sub")))
    pages = _boards(spark, sf_dir, job, ('{"data":{"job_search_with_featured_jobs_v2":{"all_jobs":[', ",", "]}}}"), url, _token("meta"))
    schema = F.struct(_c("raw_description").alias("description"), _iso().alias("datePosted"), _c("employment_type").alias("employmentType"))
    details = listings(spark, sf_dir).filter(_n() % 2 == 0).select(
        _url(url).alias("source_url"), _c("ats_job_id").alias("detail_key"), F.to_json(schema).alias("payload")
    )
    return pages, details


_SUMMARY = "concat_ws(' | ', job_title, array_to_string(location, ', '), array_to_string(list_append(departments, 'Sub'), ', '))"
_register(
    "pay9_meta", "meta", _meta_boards,
    _expect(
        "'Meta'", "'https://www.metacareers.com/jobs/' || ats_job_id || '/'",
        body=f"CASE WHEN doc_id % 2 = 0 AND raw_description <> '' THEN {_BODY} ELSE {_SUMMARY} END",
        employment=f"CASE WHEN doc_id % 2 = 0 THEN {_EMP} ELSE '' END", departments="array_to_string(list_append(departments, 'Sub'), '|')",
        posted=f"CASE WHEN doc_id % 2 = 0 THEN {_WHEN} ELSE '' END",
    ),
)


def _eightfold_boards(spark, sf_dir):
    """Even pages embed escaped data, odd pages are search responses."""
    job = _obj(
        id="doc_id", displayJobId="ats_job_id", name="job_title", job_description=F.when(_n() % 3 == 0, _html()), positionUrl=F.concat(F.lit("/careers/job/"), "ats_job_id"),
        locations="location", department=F.get("departments", F.lit(0)), business_unit=F.get("departments", F.lit(0)),
        workLocationOption="employment_type", t_create=F.unix_seconds("date_posted"),
    )
    pages = _boards(spark, sf_dir, job, ("[", ",", "]"), "https://explore.jobs.netflix.net/careers#", _token("net-flix"))
    escaped = F.replace(F.replace(F.replace("payload", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    embedded = F.concat(F.lit("<html><code id=\"smartApplyData\" style='x'>{&quot;branding&quot;:{&quot;companyName&quot;:&quot;Net Co&quot;},&quot;positions&quot;:"), escaped, F.lit("}</code></html>"))
    return pages.withColumn("payload", F.when(_c("page_ord") % 2 == 0, embedded).otherwise(
        F.concat(F.lit('{"data":{"count":9,"positions":'), "payload", F.lit("}}"))))


_register(
    "pay10_eightfold", "eightfold", _eightfold_boards,
    _expect(
        f"CASE WHEN {_EVEN} THEN 'Net Co' ELSE 'Net Flix' END", "'https://explore.jobs.netflix.net/careers/job/' || ats_job_id",
        body=f"CASE WHEN doc_id % 3 = 0 THEN {_BODY} ELSE job_title END", departments="coalesce(departments[1], '')",
    ),
)


def _oracle_boards(spark, sf_dir):
    url = "https://jpmc.fa.oraclecloud.com/en/sites/CX#/jobs"
    job = _obj(
        Id="doc_id", Title="job_title", PostingEndDate=F.when(_n() % 5 == 0, "2026-01-01").when(_n() % 5 == 1, "2027-01-01"),
        ShortDescriptionStr=F.lit("Short"), PrimaryLocation=F.get("location", F.lit(0)),
        workLocation=F.transform("location", lambda x: F.struct(x.alias("LocationName"))), otherWorkLocations=F.array(F.lit("Extra")),
        JobSchedule="employment_type", PostedDate=F.date_format("date_posted", "yyyy-MM-dd"), Organization=F.lit("Org"), Category=F.lit("Org"),
    )
    pages = _boards(spark, sf_dir, job, ('{"items":[{"TotalJobsCount":6,"requisitionList":[', ",", "]}]}"), url, _token("cx"))
    detail = F.struct(_c("raw_description").alias("ExternalDescriptionStr"), F.lit("Fn").alias("JobFunction"))
    details = listings(spark, sf_dir).filter(_n() % 2 == 0).select(
        _url(url).alias("source_url"), _c("ats_job_id").alias("detail_key"), F.to_json(detail).alias("payload")
    )
    return pages, details


_register(
    "pay11_oracle", "oracle", _oracle_boards,
    _expect(
        "'JPMorgan Chase'", f"'https://jpmc.fa.oraclecloud.com/en/sites/CX' || CAST({_BLOCK} AS VARCHAR) || '/job/' || ats_job_id",
        location=f"{_LOC} || '|Extra'", body=f"CASE WHEN doc_id % 2 = 0 THEN trim({_BODY} || chr(10) || 'Short', chr(10)) ELSE 'Short' END",
        departments="CASE WHEN doc_id % 2 = 0 THEN 'Org|Fn' ELSE 'Org' END", posted=_DAY, where="doc_id % 5 <> 0",
    ),
)

_register(
    "pay12_smartrecruiters", "smartrecruiters",
    lambda spark, d: _boards(
        spark, d,
        _obj(
            id="ats_job_id", name="job_title", company=_named(_c("company_name"), "name"), location=F.when(_n() % 3 != 0, _named(F.get("location", F.lit(0)), "fullLocation")),
            department=_named(F.get("departments", F.lit(0)), "label"), function=_named(F.lit("Fn"), "label"),
            typeOfEmployment=_named(_c("employment_type"), "label"), releasedDate=_iso(),
        ),
        ('{"totalFound":7,"content":[', ",", "]}"), "https://api.smartrecruiters.com/v1/companies/page#/postings", _token("SmartCo"),
    ),
    _expect(
        "company_name", "'https://jobs.smartrecruiters.com/SmartCo/' || ats_job_id", location="CASE WHEN doc_id % 3 <> 0 THEN location[1] ELSE 'Unspecified' END",
        body="concat_ws(' | ', job_title, CASE WHEN doc_id % 3 <> 0 THEN location[1] ELSE 'Unspecified' END, departments[1], 'Fn')",
        departments="concat_ws('|', departments[1], 'Fn')",
    ),
)

_register(
    "pay13_usajobs", "usajobs",
    lambda spark, d: _boards(
        spark, d,
        _obj(
            DocumentID="ats_job_id", Title="job_title", Agency=F.lit("Agency"), Department="company_name", WorkType="employment_type",
            WorkSchedule=F.lit("Days"), PositionURI=F.concat(F.lit("https://www.usajobs.gov:443/GetJob/"), "ats_job_id"), Location=F.lit(""),
            LocationName=F.get("location", F.lit(0)), DateDisplay=F.concat(F.lit("open "), F.date_format("date_posted", "M/d/yyyy"), F.lit(" to later")),
            JobCategoryCode=F.array(F.struct(F.lit("").alias("Name"), F.lit("0854").alias("Code")), F.struct(F.lit("IT").alias("Name"), F.lit("1").alias("Code"))),
        ),
        ('{"Jobs":[', ",", "]}"), "https://www.usajobs.gov/Search/Results?d=NN&p=#", _token("nasa"),
    ),
    _expect(
        "'NASA'", "'https://www.usajobs.gov/GetJob/' || ats_job_id", location="location[1]",
        body="concat_ws(' | ', job_title, 'Agency', company_name, '0854, IT', employment_type, 'Days', 'open ' || strftime(date_posted, '%-m/%-d/%Y') || ' to later')",
        employment="coalesce(employment_type, 'Days')", departments="'Agency|' || company_name || '|0854|IT'", posted=_DAY,
    ),
)

_register(
    "pay14_verizon", "verizon",
    lambda spark, d: _boards(
        spark, d,
        _obj(
            Id="ats_job_id", Title="job_title", Teams="departments",
            Urls=F.array(F.struct(F.lit("/first").alias("Url"), F.lit(False).alias("IsDefault")), F.struct(F.concat(F.lit("/jobs/"), "ats_job_id").alias("Url"), (_n() % 2 == 0).alias("IsDefault"))),
            Locations=F.array(
                F.struct(F.when(_n() % 2 == 0, "Spot").alias("Identifier"), F.lit("Paris").alias("City"), F.lit("Paris").alias("Region"), F.lit("France").alias("Country")),
                F.struct(F.lit("").alias("Identifier"), F.lit(None).cast("string").alias("City"), F.lit("R").alias("Region"), F.lit("Chile").alias("Country")),
            ),
        ),
        ('{"totalPages":1,"jobs":[', ",", "]}"), "https://mycareer.verizon.com/jobs/#", _token("verizon"),
    ),
    _expect(
        "'Verizon Communications'", "'https://mycareer.verizon.com' || CASE WHEN doc_id % 2 = 0 THEN '/jobs/' || ats_job_id ELSE '/first' END",
        location="CASE WHEN doc_id % 2 = 0 THEN 'Spot' ELSE 'Paris, France' END || '|Chile'",
        body="trim(job_title || ' | ' || CASE WHEN doc_id % 2 = 0 THEN 'Spot' ELSE 'Paris, France' END || ', Chile | ' || array_to_string(departments, ', '))",
        employment="''", posted="''",
    ),
)

_register(
    "pay15_walmart", "walmart",
    lambda spark, d: _boards(
        spark, d,
        _obj(
            job_id="ats_job_id", jobPostingTitle="job_title", city=F.get("location", F.lit(0)), state=F.lit(" "), country=F.lit("US"),
            brand=F.get("departments", F.lit(0)), employmentTypes=F.array(F.lit("FT"), F.lit("PT")), jobPostingStartDate=F.date_format("date_posted", "yyyy-MM-dd"),
        ),
        ('{"data":{"jobSearchAssistant":{"tool_messages":[{"artifact":{"total_jobs":3,"jobs":[', ",", "]}}]}}}"), "https://careers.walmart.com/results?page=#", _token("walmart"),
    ),
    _expect(
        "'Walmart'", "'https://careers.walmart.com/job/' || replace(replace(replace(lower(job_title), ' ', '-'), ',', '%2C'), '/', '%2F') || '/' || ats_job_id",
        location="location[1] || ', US'", body="trim(job_title || ' | ' || location[1] || ', US | ' || coalesce(departments[1], ''))",
        employment="'FT, PT'", departments="coalesce(departments[1], '')", posted=_DAY,
    ),
)

_register(
    "pay16_mcloud", "mcloud",
    lambda spark, d: _boards(
        spark, d,
        _obj(job=F.struct(
            F.when(_n() % 2 == 0, _n()).alias("id"), F.concat(F.lit("ref"), "ats_job_id").alias("ref"), _c("job_title").alias("title"), _c("job_url").alias("url"),
            F.when(_n() % 3 == 0, _html()).alias("description"), F.get("location", F.lit(0)).alias("primary_city"), F.lit("ZZ").alias("primary_country"),
            _c("employment_type").alias("employment_type"), _c("departments").alias("department"), F.date_format("date_posted", "yyyy-MM-dd").alias("open_date"),
        )),
        ('{"totalHits":4,"searchResults":[', ",", "]}"), "https://careers.homedepot.com/job-search-results/#", _token("homedepot"),
    ),
    _expect(
        "'Home Depot'", "job_url", number="CASE WHEN doc_id % 2 = 0 AND doc_id <> 0 THEN ats_job_id ELSE 'ref' || ats_job_id END",
        location="location[1] || ', ZZ'", body=f"CASE WHEN doc_id % 3 = 0 THEN {_BODY} ELSE job_title END", posted=_DAY,
    ),
)


def _xml(col):
    return F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


_register(
    "pay17_avature", "avature",
    lambda spark, d: _boards(
        spark, d,
        F.concat(
            F.lit("<item><title> "), _xml(_c("job_title")), F.lit("</title><link>https://careers.twosigma.com/careers/JobDetail/x/"), "ats_job_id",
            F.lit("/</link><description>"), _xml(F.when(_n() % 3 == 0, "").otherwise(F.get("location", F.lit(0)))), F.lit("</description><pubDate>"),
            F.coalesce(F.concat(F.date_format("date_posted", "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")), F.lit("")), F.lit("</pubDate></item>"),
        ),
        ('<rss version="2.0"><channel><title>t</title>', "", "</channel></rss>"), "https://careers.twosigma.com/careers/feed#", _token("careers"),
    ),
    _expect(
        "'Two Sigma'", "'https://careers.twosigma.com/careers/JobDetail/x/' || ats_job_id || '/'", location="CASE WHEN doc_id % 3 = 0 THEN 'Unspecified' ELSE location[1] END",
        body="job_title || ' | ' || CASE WHEN doc_id % 3 = 0 THEN 'Unspecified' ELSE location[1] END", employment="''", departments="''",
    ),
)


# --- HTML boards ---------------------------------------------------------------------


def _talentbrew_boards(spark, sf_dir):
    url = "https://careers.arm.com/search-jobs/#"
    anchor = F.concat(
        F.lit('<li><a class="section3__search-results-a" href="/job/x/'), "ats_job_id", F.lit('"><h2 class="section3__job-title">'), "job_title",
        F.lit('</h2><div class="section3__job-information"><span>Location:</span><p class="section3__job-info">'), F.regexp_replace(F.get("location", F.lit(0)), ", ", " "),
        F.lit(' | Far</p></div><div class="section3__job-information"><span>Team:</span><p class="section3__job-info">'), "company_name", F.lit("</p></div></a></li>"),
    )
    card = F.concat(
        F.lit('<li><a class="sr-job-item__link" data-job-id="'), "ats_job_id", F.lit('" href="/job/x/'), "ats_job_id", F.lit('"><h3>'), "job_title",
        F.lit('</h3></a><span class="sr-job-location">Here</span><span class="category">Team B</span></li>'),
    )
    pages = _boards(spark, sf_dir, F.when(_n() % 2 == 0, anchor).otherwise(card), ("<ul id='search-results'>", "", "</ul>"), url, _token("careers"))
    schema = F.struct(F.lit("JobPosting").alias("@type"), _html().alias("description"), F.date_format("date_posted", "yyyy-M-d").alias("datePosted"))
    details = listings(spark, sf_dir).filter(_n() % 4 == 0).select(
        _url(url).alias("source_url"), F.concat(F.lit("https://careers.arm.com/job/x/"), "ats_job_id").alias("detail_key"),
        F.concat(F.lit('<script type="application/ld+json">'), F.to_json(schema), F.lit("</script>")).alias("payload"),
    )
    return pages, details


_TB_LOC = "CASE WHEN doc_id % 2 = 0 THEN replace(location[1], ', ', ' ') || '|Far' ELSE 'Here' END"
_TB_TEAM = "CASE WHEN doc_id % 2 = 0 THEN company_name ELSE 'Team B' END"
_register(
    "pay18_talentbrew", "talentbrew", _talentbrew_boards,
    _expect(
        "'Arm Holdings'", "'https://careers.arm.com/job/x/' || ats_job_id", location=_TB_LOC,
        body=f"CASE WHEN doc_id % 4 = 0 THEN {_BODY} ELSE job_title || ' | ' || replace({_TB_LOC}, '|', ', ') || ' | ' || {_TB_TEAM} END",
        employment="''", departments=_TB_TEAM, posted=f"CASE WHEN doc_id % 4 = 0 THEN {_DAY} ELSE '' END",
    ),
)


def _successfactors_boards(spark, sf_dir):
    url = "https://jobs.sap.com/search/?startrow=#"
    row = F.concat(
        F.lit('<tr class="data-row"><td><a class="jobTitle-link" href="/job/x/'), "ats_job_id", F.lit('/">'), "job_title", F.lit("</a></td>"),
        F.when(_n() % 3 != 0, F.concat(F.lit('<td><span class="jobLocation"> '), F.get("location", F.lit(0)), F.lit("</span></td>"))).otherwise(F.lit("")), F.lit("</tr>"),
    )
    pages = _boards(spark, sf_dir, row, ("<table>", "", "</table>"), url, _token("sap"))
    detail = F.concat(
        F.lit('<meta itemprop="datePosted" content="'), F.coalesce(_iso(), F.lit("")), F.lit('"><div class="jobdescription"><p>'), F.replace("raw_description", F.lit("&"), F.lit("&amp;")),
        F.lit('</p></div><span data-careersite-propertyid="department">'), "company_name", F.lit("</span>"),
    )
    details = listings(spark, sf_dir).filter(_n() % 2 == 0).select(
        _url(url).alias("source_url"), F.concat(F.lit("https://jobs.sap.com/job/x/"), "ats_job_id", F.lit("/")).alias("detail_key"), detail.alias("payload"),
    )
    return pages, details


_register(
    "pay19_successfactors", "successfactors", _successfactors_boards,
    _expect(
        "'SAP'", "'https://jobs.sap.com/job/x/' || ats_job_id || '/'", location="CASE WHEN doc_id % 3 <> 0 THEN location[1] ELSE 'Unspecified' END",
        body=f"CASE WHEN doc_id % 2 = 0 THEN {_BODY} ELSE job_title END", employment="''",
        departments="CASE WHEN doc_id % 2 = 0 THEN company_name ELSE '' END", posted=f"CASE WHEN doc_id % 2 = 0 THEN {_WHEN} ELSE '' END",
    ),
)


# --- names, counts, facets --------------------------------------------------------------


@query(
    "pay20_company_name",
    f"WITH {duck_views('listings')}\nSELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'Zoox' WHEN 1 THEN 'Veeva Systems'"
    " WHEN 2 THEN 'Src' || substr(company_name, 4) || ' 2K' ELSE 'Big O''Neil' END AS company FROM listings",
)
def pay20(spark, sf_dir):
    token = F.when(_n() % 4 == 0, "zoox").when(_n() % 4 == 1, "veeva").when(_n() % 4 == 2, F.concat("company_name", F.lit("-2k"))).otherwise("big-o'neil")
    name = payloads.company_of(names.LEVER_COMPANIES, token, payloads.token_name(token))
    return listings(spark, sf_dir).select("doc_id", name.alias("company"))


def _counted_boards(spark, sf_dir):
    job = _obj(id="ats_job_id", isListed=_n() % 5 != 0)
    pages = _boards(spark, sf_dir, job, ("[", ",", "]"), "https://example.com/#", _token("t"))
    n = _c("page_ord") % 6
    provider = F.when(n == 0, "greenhouse").when(n == 1, "lever").when(n == 2, "ashby").when(n == 3, "smartrecruiters").when(n == 4, "amazon")
    body = (
        F.when(n.isin(0, 2), F.concat(F.lit('{"jobs":'), "payload", F.lit("}"))).when(n == 1, _c("payload"))
        .when(n == 3, F.lit('{"totalFound":77}')).otherwise(F.lit("{}"))
    )
    return pages.withColumns({"ats_provider": provider, "payload": body})


_PAGES_SQL = f"""pages_of AS (SELECT {_BLOCK} AS p, count(*) AS n, count_if(doc_id % 5 <> 0) AS listed FROM documents GROUP BY 1),
counted AS (SELECT p, CASE CAST(p % 6 AS INT) WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN listed WHEN 3 THEN 77 END AS expected,
  CASE WHEN p % 6 = 5 THEN 'failed' WHEN p % 6 = 4 THEN 'unsupported_count_probe' ELSE 'counted' END AS status FROM pages_of)"""


@query(
    "pay21_declared_counts",
    f"WITH {_PAGES_SQL}\nSELECT 'https://example.com/' || CAST(p AS VARCHAR) AS source_url, coalesce(expected, -1) AS expected_count, status FROM counted",
)
def pay21(spark, sf_dir):
    counts = payloads.declared_counts(_counted_boards(spark, sf_dir))
    return counts.select("source_url", F.coalesce(_c("expected_count").cast("bigint"), F.lit(-1)).alias("expected_count"), "status")


@query(
    "pay21_declared_summary",
    f"WITH {_PAGES_SQL}\nSELECT count(*) AS source_count, count(expected) AS counted_count,"
    " count_if(status = 'unsupported_count_probe') AS unsupported_count, count_if(status = 'failed') AS failed_count FROM counted",
)
def pay21_summary(spark, sf_dir):
    return payloads.declared_summary(payloads.declared_counts(_counted_boards(spark, sf_dir)))


_FACETS = ("ats_provider", "employment_type", "job_title", "company_name")


@query(
    "pay22_best_split",
    f"WITH {duck_views('listings')},\nsizes AS ("
    + " UNION ALL ".join(
        f"SELECT company_name AS board, '{f}' AS facet, {i} AS ord, max(n) AS largest, count(*) AS buckets FROM"
        f" (SELECT company_name, {f} AS v, count(*) AS n FROM listings GROUP BY company_name, {f}) GROUP BY company_name"
        for i, f in enumerate(_FACETS) if f != "company_name"
    )
    + ")\nSELECT board, facet, CAST(largest AS BIGINT) AS largest FROM sizes WHERE buckets >= 2"
    " QUALIFY row_number() OVER (PARTITION BY board ORDER BY largest, ord) = 1",
)
def pay22(spark, sf_dir):
    """Facet values of every board, counted in one pass."""
    pairs = [F.struct(F.lit(f).alias("facet"), F.lit(i).alias("facet_ord"), _c(f).alias("value")) for i, f in enumerate(_FACETS)]
    rows = listings(spark, sf_dir).select(_c("company_name").alias("board"), F.inline(F.array(*pairs)))
    buckets = rows.groupBy("board", "facet", "facet_ord", "value").agg(F.count(F.lit(1)).alias("bucket_count"))
    return payloads.best_split(buckets, ["board"]).select("board", "facet", "largest")
