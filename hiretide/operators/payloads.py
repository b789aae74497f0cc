"""Landed provider payloads to listings (PAY0-PAY22).

``boards`` is one row per landed page: source_url, board_token, page_ord, payload.
Each provider registers how to find its job objects in a payload and how to read
the listing fields from one; everything else is shared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiretide import names
from hiretide.functions import dates
from hiretide.functions import text as tx
from hiretide.functions.expr import (
    bound, clean_list, join_present, mapped, no_strings, present, strip, title_words,
)
from hiretide.functions.variant import Doc, at, elements, kind, named, objects, scalar_text, string_list, text, truthy_text
from hiretide.operators.routing import host, path_parts, query_values
from hiretide.operators.skew import best_per_key

LISTING_COLUMNS = (
    "company_name", "job_title", "job_url", "ats_provider", "ats_job_id", "location", "raw_description",
    "description_html", "employment_type", "departments", "date_posted", "content_hash", "extracted_at",
)


@dataclass(frozen=True)
class Page:
    """Columns of the landed page an item comes from; ``name`` is who the page says
    it belongs to (see PAGE_NAMES)."""

    url: Column
    token: Column
    name: Column
    as_of: Column


@dataclass(frozen=True)
class Mapping:
    """``items``: payload text and parsed payload -> array of job objects;
    ``fields``: job object and page -> listing fields; ``same``: dedupe key."""

    items: Callable[[Column, Column], Column]
    fields: Callable[[Doc, Page], dict[str, Column]]
    same: Callable[[Doc], Column] | None = None
    keep: Callable[[Doc, Page], Column] | None = None
    detail_key: Callable[[Doc], Column] | None = None


MAPPINGS: dict[str, Mapping] = {}


def register_mapping(provider: str, mapping: Mapping) -> None:
    MAPPINGS[provider] = mapping


# --- shared pieces ------------------------------------------------------------------


def content_hash(title: Column, company: Column, number: Column) -> Column:
    return F.sha2(F.concat_ws("|", title, company, number), 256)


def join_url(base: Column, link: Column) -> Column:
    """Resolve a link against its page: absolute, host-relative, path-relative, query
    or fragment only.  Dot segments of relative links are folded."""
    page = F.regexp_replace(base, r"#.*$", "")
    bare = F.regexp_replace(base, r"[?#].*$", "")
    target = F.regexp_extract(link, r"^([^?#]*)", 1)
    suffix = link.substr(F.length(target) + 1, F.length(link))
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/(?:.*/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, without_dots(target), suffix))
        .when(link.startswith("?"), F.concat(bare, link))
        .when(link.startswith("#"), F.concat(page, link))
        .when(link == "", base)
        .otherwise(F.concat(origin, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), target)), suffix))
    )


def without_dots(path: Column) -> Column:
    """An absolute path with its . and .. segments folded."""
    dotted = path.rlike(r"(^|/)\.{1,2}(/|$)")
    closed = F.when(path.rlike(r"(^|/)\.{1,2}$"), F.concat(path, F.lit("/"))).otherwise(path)
    segments = F.split(F.regexp_replace(closed, "^/", ""), "/")

    def fold(done: Column, segment: Column) -> Column:
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == "..", parent).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    folded = F.aggregate(segments, no_strings(), fold)
    return F.when(dotted, F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(path)


def token_name(token: Column) -> Column:
    return title_words(F.replace(token, F.lit("-"), F.lit(" ")))


def company_of(table: dict[str, str], key: Column, *fallbacks: Column) -> Column:
    """PAY20: fixed name of a token or host, else the fallbacks."""
    return F.coalesce(mapped(key, table), *fallbacks)


def _pages(boards: DataFrame) -> DataFrame:
    return boards.withColumn("_doc", F.try_parse_json("payload"))


def _once(rows: DataFrame, same: Column) -> DataFrame:
    """The first row of a source per value of ``same``; rows without a value all stay."""
    unique = F.concat_ws("#", F.lit(""), F.col("page_ord"), F.col("pos"))
    keyed = rows.withColumn("_same", F.coalesce(same, unique))
    return best_per_key(keyed, ["source_url", "_same"], [F.col("page_ord"), F.col("pos")])


def map_payload(boards: DataFrame, provider: str, as_of: Column, details: DataFrame | None = None) -> DataFrame:
    """PAY0: listings of one provider's landed pages, with source_url, page_ord
    and pos.  Rows that lack a required field come out incomplete and are caught
    by validation, they do not fail the job.

    ``details`` (source_url, detail_key, payload) overlays landed detail pages on the
    postings that are left once each is listed once.
    """
    mapping = MAPPINGS[provider]
    carry = ["source_url", "board_token", "page_ord"]
    extra = [c for c in ("facet_parameter", "facet_descriptor") if c in boards.columns]
    # what a job needs of its page is read before the page is taken apart
    own_name = PAGE_NAMES.get(provider, lambda doc: F.lit(None).cast("string"))
    pages = _pages(boards).withColumn("_page", own_name(F.col("_doc")))
    items = pages.select(
        *carry, *extra, "_page",
        F.posexplode(mapping.items(F.col("payload"), F.col("_doc"))).alias("pos", "_item"),
    )
    listed, page = Doc(F.col("_item")), Page(F.col("source_url"), F.col("board_token"), F.col("_page"), as_of)
    if mapping.keep is not None:
        items = items.filter(mapping.keep(listed, page))
    detailed = details is not None and mapping.detail_key is not None
    if detailed and mapping.same:
        # a posting listed twice is one posting before its detail page is asked for
        items = _once(items, mapping.same(listed))
    layers = [F.col("_item")]
    if detailed:
        keyed = items.withColumn("_key", mapping.detail_key(listed))
        parsed = details.select(
            "source_url", F.col("detail_key").alias("_key"), F.try_parse_json("payload").alias("_detail")
        )
        items = keyed.join(parsed, ["source_url", "_key"], "left")
        layers.insert(0, F.col("_detail"))
    if extra:
        items = items.withColumn("_facet", _facet_layer())
        layers.append(F.col("_facet"))
    doc = Doc(*layers)
    fields = mapping.fields(doc, page)
    flat = items.select(*carry, "pos", *[c.alias(f"_{n}") for n, c in fields.items()],
                        *([mapping.same(doc).alias("_same")] if mapping.same and not detailed else []))
    if mapping.same and not detailed:
        flat = _once(flat, F.col("_same"))
    return _listing(flat, provider, as_of, carry)


def _listing(flat: DataFrame, provider: str, as_of: Column, carry: list[str]) -> DataFrame:
    c = F.col
    have = set(flat.columns)

    def field(name: str, default) -> Column:
        return c(f"_{name}") if f"_{name}" in have else default

    location = F.when(F.size("_location") > 0, c("_location")).otherwise(F.array(F.lit("Unspecified")))
    raw = c("_raw") if "_raw" in have else tx.html_to_text(c("_markup"))
    if "_plain_parts" in have:
        flat, raw = _clean_parts(flat)
    null = F.lit(None).cast("string")
    return flat.select(
        *carry, "pos",
        c("_company").alias("company_name"), c("_title").alias("job_title"), c("_url").alias("job_url"),
        F.lit(provider).alias("ats_provider"), c("_number").alias("ats_job_id"), location.alias("location"),
        raw.alias("raw_description"),
        F.nullif(field("html", null), F.lit("")).alias("description_html"),
        field("employment", null).alias("employment_type"),
        F.coalesce(field("departments", no_strings()), no_strings()).alias("departments"),
        field("date", F.lit(None).cast("timestamp")).alias("date_posted"),
        content_hash(c("_title"), c("_company"), c("_number")).alias("content_hash"),
        as_of.alias("extracted_at"),
    )


def _clean_parts(flat: DataFrame) -> tuple[DataFrame, Column]:
    """Text parts cleaned separately and joined by blank lines.  A control
    character marks the joints, so that one pass cleans all parts."""
    marked = flat.withColumn("_joined", F.array_join("_plain_parts", "<br>\x1d<br>"))
    whole = tx.html_to_text(F.col("_joined"))
    return marked, strip(F.array_join(F.transform(F.split(whole, "\x1d"), strip), "\n\n"))


PAGE_NAMES: dict[str, Callable[[Column], Column]] = {
    "greenhouse": lambda doc: scalar_text(at(doc, "name")),
    "ashby": lambda doc: F.coalesce(*[text(at(doc, k)) for k in ("organizationName", "companyName", "name")]),
    "eightfold": lambda doc: scalar_text(at(doc, "branding", "companyName")),
}


def _facet_layer() -> Column:
    """PAY5: the facet a page was split by stands in for a missing field."""
    family = F.col("facet_parameter").isin("jobFamilyGroup", "jobFamily")
    name = F.when(family, "jobFamilyGroup").when(
        F.col("facet_parameter").isin("workerSubType", "timeType"), F.col("facet_parameter")
    )
    value = present(F.col("facet_descriptor"))
    return F.when(name.isNotNull() & value.isNotNull(), F.try_parse_json(F.to_json(F.create_map(name, value))))


def _blank_line_join(*parts: Column) -> Column:
    return join_present("\n\n", *parts)


# --- providers with JSON payloads ---------------------------------------------------


def _greenhouse(job: Doc, page: Page) -> dict[str, Column]:
    number = scalar_text(job["id"])
    own = text(job["absolute_url"])
    place = F.array_compact(F.array(scalar_text(job.under("location", "name"))))
    html = job.body("content")
    return {
        "company": company_of(names.GREENHOUSE_COMPANIES, page.token, page.name, page.token),
        "title": job.text("title"),
        "url": F.coalesce(own, F.concat(F.lit("https://boards.greenhouse.io/"), page.token, F.lit("/jobs/"), number)),
        "number": number,
        "location": F.when(F.size(place) > 0, place).otherwise(named(job["offices"], "name")),
        "markup": html, "html": html,
        "departments": named(job["departments"], "name"),
        "date": job.date("updated_at"),
    }


def _lever(job: Doc, page: Page) -> dict[str, Column]:
    lists = objects(job["lists"])

    def parts(*keys: str) -> Column:
        each = F.transform(lists, lambda s: F.array(*[F.nullif(F.try_variant_get(at(s, k), "$", "string"), F.lit("")) for k in keys]))
        return F.coalesce(F.flatten(each), no_strings())

    def joined_text(values: Column) -> Column:
        return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), "\n\n")

    plain = F.concat(F.array(job.body("descriptionPlain"), job.body("additionalPlain")), parts("text", "content"))
    html = F.concat(F.array(job.body("description"), job.body("additional")), parts("content"))
    return {
        "company": company_of(names.LEVER_COMPANIES, page.token, token_name(page.token)),
        "title": job.text("text"), "url": job.text("hostedUrl"), "number": job.text("id"),
        "location": string_list(job.under("categories", "location")),
        # parts are cleaned one by one, then joined by blank lines
        "plain_parts": F.filter(plain, lambda v: v.isNotNull()),
        "html": joined_text(F.transform(html, present)),
        "employment": scalar_text(job.under("categories", "commitment")),
        "departments": F.concat(
            string_list(job.under("categories", "team")), string_list(job.under("categories", "department"))
        ),
        "date": job.date("createdAt"),
    }


def _ashby(job: Doc, page: Page) -> dict[str, Column]:
    number = job.text("id")

    def team(key: str) -> Column:
        inside = truthy_name(job[key])
        return F.when(inside.isNotNull(), F.array(inside)).otherwise(string_list(job[key]))

    html = job.body("descriptionHtml", "description")
    return {
        "company": company_of(names.ASHBY_COMPANIES, page.token, page.name, token_name(page.token)),
        "title": job.text("title"),
        "url": F.coalesce(job.text("jobUrl", "applyUrl"), F.concat(F.lit("https://jobs.ashbyhq.com/"), page.token, F.lit("/"), number)),
        "number": number,
        "location": job.strings("locationName", "location", "locations"),
        "markup": html, "html": html,
        "employment": scalar_text(job["employmentType"]),
        "departments": F.concat(team("department"), team("team")),
        "date": job.first_date("publishedAt", "createdAt"),
    }


def truthy_name(value: Column) -> Column:
    return Doc(value).truthy("name")


WORKDAY_ID_KEYS = ("jobReqId", "requisitionId", "id", "bulletFields", "externalPath")
WORKDAY_TITLE_KEYS = ("title", "jobTitle", "name", "postingTitle", "displayTitle", "positionTitle")


def _workday_id(job: Doc) -> Column:
    def one(value: Column) -> Column:
        def shape(v: Column) -> Column:
            head = scalar_text(F.get(elements(v), F.lit(0)))
            tail = F.element_at(F.split(truthy_text(v), "/"), -1)
            return F.when(kind(v).startswith("ARRAY"), head).otherwise(tail)

        return bound(value, shape)

    return F.coalesce(*[one(job[k]) for k in WORKDAY_ID_KEYS])


def slug_title(external_path: Column) -> Column:
    """Title from the last path segment, without a trailing requisition number."""
    segment = F.element_at(F.split(F.regexp_replace(external_path, "/+$", ""), "/"), -1)
    words = F.regexp_replace(segment, "[_-]+", " ")
    return present(F.regexp_replace(words, r"(?i)\bR\d+\b$", ""))


def _workday(job: Doc, page: Page) -> dict[str, Column]:
    number = _workday_id(job)
    title = F.coalesce(job.text(*WORKDAY_TITLE_KEYS), slug_title(job.text("externalPath")))
    site_name = bound(path_parts(page.url), lambda parts: F.when(
        F.lower(F.get(parts, F.lit(0))).isin("en-us", "en"), F.get(parts, F.lit(1))
    ).otherwise(F.get(parts, F.lit(0))))
    site = F.concat(F.lit("https://"), host(page.url), F.lit("/"), site_name)
    link = job.text("externalPath", "jobPostingUrl", "applyUrl")
    own_path = job.text("externalPath")
    html = job.text("jobDescription", "descriptionHtml", "description")
    relative = dates.relative_posting(F.when(kind(job["postedOn"]) == "STRING", job.body("postedOn")), page.as_of)
    return {
        "company": company_of(names.WORKDAY_COMPANIES, page.token, token_name(page.token)),
        "title": title,
        "url": F.when(own_path.startswith("/"), F.concat(site, own_path)).otherwise(
            join_url(page.url, F.coalesce(link, number))
        ),
        "number": number,
        "location": job.strings("locationsText", "location", "locations", "primaryLocation"),
        "markup": F.coalesce(html, title), "html": html,
        "employment": F.coalesce(truthy_text(job["timeType"]), truthy_text(job["workerSubType"])),
        "departments": job.strings("jobFamily", "jobFamilyGroup"),
        "date": F.coalesce(job.date("postedDate", "datePosted", "startDate", "postedOn"), relative),
    }


def _amazon(job: Doc, page: Page) -> dict[str, Column]:
    html = _blank_line_join(job.body("description"), job.body("basic_qualifications"), job.body("preferred_qualifications"))
    job_path = job.text("job_path")
    return {
        "company": F.lit("Amazon"), "title": job.text("title"),
        "url": F.coalesce(F.concat(F.lit("https://www.amazon.jobs"), job_path), job.text("url_next_step")),
        "number": job.truthy("id_icims", "job_path", "title"),
        "location": job.strings("normalized_location", "location"),
        "markup": html, "html": html,
        "employment": scalar_text(job["job_type"]),
        "departments": job.strings("team", "business_category"),
        "date": job.date("posted_date"),
    }


def _meta(job: Doc, page: Page) -> dict[str, Column]:
    html = job.body("description")
    teams = job.all_strings("teams", "sub_teams")
    summary = join_present(" | ", job.text("title"), F.array_join(string_list(job["locations"]), ", "), F.array_join(teams, ", "))
    number = job.text("id")
    return {
        "company": F.lit("Meta"), "title": job.text("title"),
        "url": F.concat(F.lit("https://www.metacareers.com/jobs/"), number, F.lit("/")), "number": number,
        "location": string_list(job["locations"]),
        "markup": F.coalesce(html, summary), "html": html,
        "employment": F.coalesce(scalar_text(job["employment_type"]), scalar_text(job["employmentType"])),
        "departments": teams,
        "date": job.date("date_posted", "datePosted"),
    }


def _eightfold(job: Doc, page: Page) -> dict[str, Column]:
    title = job.truthy("posting_name", "name")
    html = F.coalesce(scalar_text(job["job_description"]), scalar_text(job["jobDescription"]))
    link = F.coalesce(*[scalar_text(job[k]) for k in ("canonicalPositionUrl", "positionUrl", "url")])
    number = job.truthy("ats_job_id", "atsJobId", "display_job_id", "displayJobId", "id")
    own_page = F.concat(F.regexp_replace(page.url, "/+$", ""), F.lit("/job/"), scalar_text(job["id"]))
    return {
        "company": F.coalesce(page.name, mapped(host(page.url), EIGHTFOLD_HOSTS),
                              token_name(page.token)),
        "title": title, "url": F.coalesce(join_url(page.url, link), own_page), "number": number,
        "location": job.strings("locations", "location"),
        "markup": F.coalesce(html, title), "html": html,
        "employment": F.coalesce(scalar_text(job["work_location_option"]), scalar_text(job["workLocationOption"])),
        "departments": F.array_distinct(job.all_strings("department", "business_unit", "businessUnit")),
        "date": job.first_date("postedTs", "creationTs", "t_create", "t_update"),
    }


# --- fixed values ---
EIGHTFOLD_HOSTS = {
    "apply.careers.microsoft.com": "Microsoft",
    "careers.qualcomm.com": "Qualcomm",
    "searchcareers.caci.com": "CACI International",
}
ORACLE_BODY_KEYS = (
    "ExternalDescriptionStr", "ShortDescriptionStr", "CorporateDescriptionStr", "OrganizationDescriptionStr",
    "ExternalResponsibilitiesStr", "ExternalQualificationsStr",
)
ORACLE_TEAM_KEYS = ("Category", "RequisitionType", "JobFamily", "JobFunction", "Department", "BusinessUnit", "Organization")


def _oracle(job: Doc, page: Page) -> dict[str, Column]:
    number = scalar_text(job["Id"])
    html = _blank_line_join(*[job.body(k) for k in ORACLE_BODY_KEYS])

    def places(key: str) -> Column:
        one = lambda v: F.when(kind(v).startswith("OBJECT"), scalar_text(at(v, "LocationName"))).otherwise(scalar_text(v))
        return F.coalesce(F.array_compact(F.transform(elements(job[key]), one)), no_strings())

    spots = F.concat(string_list(job["PrimaryLocation"]), *[places(k) for k in ("workLocation", "secondaryLocations", "otherWorkLocations")])
    return {
        "company": company_of(names.ORACLE_HOSTS, host(page.url), token_name(page.token)),
        "title": job.text("Title"), "url": join_url(page.url, F.concat(F.lit("job/"), number)), "number": number,
        "location": F.array_distinct(spots), "markup": html, "html": html,
        "employment": job.truthy("JobSchedule", "WorkerType"),
        "departments": F.array_distinct(job.all_strings(*ORACLE_TEAM_KEYS)),
        "date": job.first_date("ExternalPostedStartDate", "PostedDate"),
    }


def _oracle_open(job: Doc, page: Page) -> Column:
    end = job.date("PostingEndDate")
    return end.isNull() | (end >= page.as_of)


def _smartrecruiters(job: Doc, page: Page) -> dict[str, Column]:
    title, number = job.text("name"), job.text("id")
    place = F.coalesce(text(job.under("location", "fullLocation")), F.lit("Unspecified"))
    team, role = scalar_text(job.under("department", "label")), scalar_text(job.under("function", "label"))
    return {
        "company": F.coalesce(scalar_text(job.under("company", "name")), page.token), "title": title,
        "url": F.coalesce(job.text("postingUrl"), F.concat(F.lit("https://jobs.smartrecruiters.com/"), page.token, F.lit("/"), number)),
        "number": number, "location": F.array(place), "markup": join_present(" | ", title, place, team, role),
        "employment": scalar_text(job.under("typeOfEmployment", "label")),
        "departments": F.array_compact(F.array(team, role)), "date": job.date("releasedDate"),
    }


def _usajobs(job: Doc, page: Page) -> dict[str, Column]:
    title, number = job.text("Title"), job.truthy("DocumentID", "PositionID")
    agency, department = scalar_text(job["Agency"]), scalar_text(job["Department"])
    groups = F.array_compact(F.transform(
        objects(job["JobCategoryCode"]), lambda g: F.coalesce(*[text(at(g, k)) for k in ("Name", "Code", "Display")])
    ))
    groups = F.coalesce(groups, no_strings())
    shown = scalar_text(job["DateDisplay"])
    opened = F.regexp_extract(shown, r"(?i)\bOpen\s+(\d{1,2}/\d{1,2}/\d{4})\b", 1)
    link = job.text("PositionURI", "ApplyURI", "DetailsURI")
    return {
        "company": company_of(names.USAJOBS_COMPANIES, page.token, F.upper(page.token)), "title": title,
        "url": F.coalesce(F.replace(link, F.lit("https://www.usajobs.gov:443/"), F.lit("https://www.usajobs.gov/")),
                          F.concat(F.lit("https://www.usajobs.gov/job/"), number)),
        "number": number,
        "location": F.array(F.coalesce(job.text("Location", "LocationName", "Locations"), F.lit("Unspecified"))),
        "raw": join_present(" | ", title, agency, department, F.array_join(groups, ", "), scalar_text(job["WorkType"]),
                            scalar_text(job["WorkSchedule"]), shown),
        "employment": job.truthy("WorkType", "WorkSchedule"),
        "departments": F.concat(F.array_compact(F.array(agency, department)), groups),
        "date": F.try_to_timestamp(opened, F.lit("M/d/yyyy")),
    }


def _verizon_place(place: Column) -> Column:
    city, region, country = (text(at(place, k)) for k in ("City", "Region", "Country"))
    shown_region = F.when(region != city, region)
    spelled = join_present(
        ", ", city, shown_region, F.when((country != city) & ~country.eqNullSafe(shown_region), country)
    )
    return F.coalesce(text(at(place, "Identifier")), F.when(city.isNotNull(), spelled), country)


def _verizon(job: Doc, page: Page) -> dict[str, Column]:
    title, number = job.text("Title"), job.text("Id")
    places = F.array_distinct(F.array_compact(F.transform(objects(job["Locations"]), _verizon_place)))
    places = F.when(F.size(places) > 0, places).otherwise(F.array(F.lit("Unspecified")))
    teams = string_list(job["Teams"])
    urls = F.filter(objects(job["Urls"]), lambda u: kind(at(u, "Url")) == "STRING")
    marked = F.filter(urls, lambda u: truthy_text(at(u, "IsDefault")).isNotNull())
    link = F.coalesce(*[F.try_variant_get(F.get(u, F.lit(0)), "$.Url", "string") for u in (marked, urls)])
    return {
        "company": F.lit("Verizon Communications"), "title": title,
        "url": F.coalesce(join_url(F.lit("https://mycareer.verizon.com"), link),
                          F.concat(F.lit("https://mycareer.verizon.com/jobs/"), number)),
        "number": number, "location": places,
        "markup": F.concat(title, F.lit(" | "), F.array_join(places, ", "), F.lit(" | "), F.array_join(teams, ", ")),
        "departments": teams,
    }


def _walmart(job: Doc, page: Page) -> dict[str, Column]:
    title, number = job.text("jobPostingTitle"), job.text("job_id")
    place = join_present(", ", *[scalar_text(job[k]) for k in ("city", "state", "country")])
    brand = scalar_text(job["brand"])
    words = F.array_join(F.filter(F.split(F.lower(title), r"\s+"), lambda w: w != ""), "-")
    kinds = F.array_join(string_list(job["employmentTypes"]), ", ")
    return {
        "company": F.lit("Walmart"), "title": title,
        "url": F.concat(F.lit("https://careers.walmart.com/job/"), F.url_encode(words), F.lit("/"), number),
        "number": number, "location": F.array_compact(F.array(F.nullif(place, F.lit("")))),
        "markup": F.concat(title, F.lit(" | "), place, F.lit(" | "), F.coalesce(brand, F.lit(""))),
        "employment": F.nullif(kinds, F.lit("")), "departments": string_list(job["brand"]),
        "date": job.date("jobPostingStartDate"),
    }


def _mcloud(job: Doc, page: Page) -> dict[str, Column]:
    title, html = job.text("title"), scalar_text(job["description"])
    place = join_present(", ", *[scalar_text(job[k]) for k in ("primary_city", "primary_state", "primary_country")])
    return {
        "company": F.lit("Home Depot"), "title": title, "url": job.text("url"), "number": job.truthy("id", "ref"),
        "location": F.array_compact(F.array(F.nullif(place, F.lit("")))),
        "markup": F.coalesce(html, title), "html": html,
        "employment": job.truthy("job_type", "employment_type"),
        "departments": job.strings("primary_category", "department"), "date": job.date("open_date"),
    }


# --- providers with embedded or other payloads ---------------------------------------


def _google_records(payload: Column, _: Column) -> Column:
    """Positional records of every embedded data block."""
    blocks = F.regexp_extract_all(payload, F.lit(r"(?s)AF_initDataCallback\(\{key: 'ds:\d+'.*?data:(.*?), sideChannel"), 1)
    lists = F.transform(blocks, lambda b: elements(at(F.try_parse_json(b), 0)))
    records = F.flatten(F.filter(lists, lambda r: r.isNotNull()))
    return F.filter(records, lambda r: F.size(elements(r)) > 14)


def _google(job: Doc, page: Page) -> dict[str, Column]:
    record = job.layers[0]

    def html(i: int) -> Column:
        value = at(record, i, 1)
        return F.when(kind(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))

    markup = _blank_line_join(html(10), html(4), html(3))
    title = truthy_text(at(record, 1))
    places = F.transform(elements(at(record, 9)), lambda p: text(at(p, 0)))
    seconds = F.try_variant_get(record, "$[12][0]", "bigint")
    nanos = F.coalesce(F.try_variant_get(record, "$[12][1]", "bigint"), F.lit(0))
    raw_url = truthy_text(at(record, 2))
    site_path = F.regexp_replace(F.regexp_replace(raw_url, "^[a-z]+://[^/?#]*", ""), "#.*$", "")
    return {
        "company": F.lit("Google"), "title": title,
        "url": F.concat(F.lit("https://www.google.com"), site_path), "number": truthy_text(at(record, 0)),
        "location": clean_list(F.filter(places, lambda p: p.isNotNull())),
        "markup": F.coalesce(F.nullif(markup, F.lit("")), title), "html": markup,
        "departments": F.array_compact(F.array(truthy_text(at(record, 7)))),
        "date": F.timestamp_micros(seconds * 1_000_000 + F.floor(nanos / 1000)),
    }


def google_links(boards: DataFrame, as_of: Column) -> DataFrame:
    """PAY7 fallback: listings from sign-in links, for pages without data blocks."""
    links = F.regexp_extract_all(
        "payload", F.lit(r"""(https://www\.google\.com/about/careers/applications/signin\?[^"'<> ]+)"""), 1
    )
    found = boards.select("source_url", "board_token", "page_ord", F.posexplode(links).alias("pos", "_link"))
    url = F.replace(F.replace(tx.unescape_html(F.col("_link")), F.lit("\\u003d"), F.lit("=")), F.lit("\\u0026"), F.lit("&"))
    found = found.withColumn("_link", url)

    def parameter(name: str) -> Column:
        value = F.get(query_values(F.col("_link"), name), F.lit(0))
        return present(F.coalesce(F.try_url_decode(value), value))

    flat = found.select(
        "source_url", "board_token", "page_ord", "pos", F.lit("Google").alias("_company"),
        parameter("title").alias("_title"), F.regexp_replace("_link", "#.*$", "").alias("_url"),
        parameter("jobId").alias("_number"), F.array_compact(F.array(parameter("loc"))).alias("_location"),
    ).withColumn("_markup", F.col("_title"))
    kept = flat.filter(F.col("_number").isNotNull() & F.col("_title").isNotNull())
    first = best_per_key(kept, ["source_url", "_number"], [F.col("page_ord"), F.col("pos")])
    return _listing(first, "google", as_of, ["source_url", "board_token", "page_ord"])


@F.pandas_udf(T.StringType())
def _search_results(values: pd.Series) -> pd.Series:
    """First object, depth first, that holds a searchResults list."""
    import json

    def find(value):
        stack = [value]
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                if isinstance(node.get("searchResults"), list):
                    return node["searchResults"]
                stack.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                stack.extend(reversed(node))
        return None

    def results(document: str) -> str | None:
        try:
            found = find(json.loads(document))
        except ValueError:
            return None
        return None if found is None else json.dumps(found)

    return values.map(results, na_action="ignore")


def apple_pages(boards: DataFrame) -> DataFrame:
    """PAY8: replaces a page by the search results of its hydration string, which
    is JSON inside a JSON string.  The possessive repetition keeps the matcher from
    recursing once per character of a long page."""
    literals = F.regexp_extract_all("payload", F.lit(r'(?s)JSON\.parse\("((?:\\.|[^"\\])*+)"\)'), 1)
    decoded = F.transform(literals, lambda s: F.get_json_object(F.concat(F.lit('{"v":"'), s, F.lit('"}')), "$.v"))
    usable = F.filter(decoded, lambda s: F.try_parse_json(s).isNotNull())
    return boards.withColumn("_state", F.get(usable, F.lit(0))).withColumn(
        "payload", _search_results(F.col("_state"))
    ).drop("_state")


def _apple(job: Doc, page: Page) -> dict[str, Column]:
    number = job.truthy("id", "reqId", "positionId")
    position = job.truthy("positionId")
    detail = F.when(number.rlike("^(?:PIPE|REQ)-"), F.coalesce(position, number)).otherwise(number)
    slug = job.truthy("transformedPostingTitle")
    code = truthy_text(job.under("team", "teamCode"))
    title = job.text("postingTitle")
    body = F.coalesce(job.body("jobSummary"), title)

    def place(p: Column) -> Column:
        return F.nullif(join_present(", ", scalar_text(at(p, "name")), scalar_text(at(p, "countryName"))), F.lit(""))

    return {
        "company": F.lit("Apple"), "title": title,
        "url": F.concat(
            F.lit("https://jobs.apple.com/en-us/details/"), detail,
            F.coalesce(F.concat(F.lit("/"), slug), F.lit("")),
            F.coalesce(F.concat(F.lit("?team="), F.url_encode(code)), F.lit("")),
        ),
        "number": number, "location": F.array_compact(F.transform(objects(job["locations"]), place)),
        "markup": body, "html": body, "employment": scalar_text(job["type"]),
        "departments": string_list(job.under("team", "teamName")), "date": job.date("postDateInGMT"),
    }


def eightfold_pages(boards: DataFrame) -> DataFrame:
    """PAY10: replaces a page by its embedded data object when it has one."""
    embedded = F.regexp_extract("payload", r"""(?s)<code\s+id=["']smartApplyData["'][^>]*>(.*?)</code>""", 1)
    return boards.withColumn("_code", embedded).withColumn(
        "payload", F.when(F.col("_code") != "", tx.unescape_html(F.col("_code"))).otherwise(F.col("payload"))
    ).drop("_code")


RSS = "channel struct<item: array<struct<link: string, guid: string, title: string, description: string, pubDate: string>>>"


def map_avature(boards: DataFrame, as_of: Column) -> DataFrame:
    """PAY17: RSS feeds."""
    items = boards.select(
        "source_url", "board_token", "page_ord",
        F.posexplode(F.from_xml("payload", RSS)["channel"]["item"]).alias("pos", "_item"),
    )
    item = F.col("_item")
    url = F.coalesce(present(item.link), present(item.guid))
    place = F.coalesce(present(item.description), F.lit("Unspecified"))
    flat = items.select(
        "source_url", "board_token", "page_ord", "pos", present(item.title).alias("_title"), url.alias("_url"),
        place.alias("_place"), present(item.pubDate).alias("_published"),
    ).filter(F.col("_url").isNotNull() & F.col("_title").isNotNull())
    flat = flat.withColumns(
        {
            "_number": F.element_at(F.split(F.regexp_replace("_url", "/+$", ""), "/"), -1),
            "_company": company_of(names.AVATURE_HOSTS, host(F.col("source_url")), token_name(F.col("board_token"))),
            "_location": F.array("_place"),
            "_markup": F.concat_ws(" | ", "_title", "_place"),
            "_date": dates.rss_timestamp(F.col("_published")),
        }
    )
    first = best_per_key(flat, ["source_url", "_number"], [F.col("page_ord"), F.col("pos")])
    return _listing(first, "avature", as_of, ["source_url", "board_token", "page_ord"])


# --- registration ---------------------------------------------------------------------


def _list_at(*keys: str | int) -> Callable[[Column, Column], Column]:
    return lambda payload, doc: objects(at(doc, *keys))


def _workday_items(payload: Column, doc: Column) -> Column:
    places = [(k,) for k in ("jobPostings", "jobs", "postings", "data")]
    places += [("data", k) for k in ("jobPostings", "jobs", "postings")]
    return F.coalesce(objects(doc), *[objects(at(doc, *p)) for p in places])


def _eightfold_items(payload: Column, doc: Column) -> Column:
    return F.coalesce(objects(at(doc, "positions")), objects(at(doc, "data", "positions")))


def _one_key(*keys: str) -> Callable[[Doc], Column]:
    return lambda job: job.truthy(*keys)


register_mapping("greenhouse", Mapping(_list_at("jobs"), _greenhouse))
register_mapping("lever", Mapping(_list_at(), _lever, same=_one_key("id", "hostedUrl", "text")))
register_mapping(
    "ashby",
    Mapping(_list_at("jobs"), _ashby,
            keep=lambda job, page: ~((kind(job["isListed"]) == "BOOLEAN") & (scalar_text(job["isListed"]) == "False"))
            .eqNullSafe(F.lit(True))),
)
register_mapping(
    "workday",
    Mapping(_workday_items, _workday, same=lambda job: F.coalesce(_workday_id(job), job.truthy("externalPath")),
            detail_key=lambda job: job.text("externalPath")),
)
register_mapping("amazon", Mapping(_list_at("jobs"), _amazon, same=_one_key("id_icims", "job_path", "title")))
register_mapping("google", Mapping(_google_records, _google, same=lambda job: truthy_text(at(job.layers[0], 0)),
                                   keep=lambda job, page: reduce(
                                       lambda a, b: a & b, [truthy_text(at(job.layers[0], i)).isNotNull() for i in (0, 1, 2)])))
register_mapping(
    "meta",
    Mapping(_list_at("data", "job_search_with_featured_jobs_v2", "all_jobs"), _meta, detail_key=lambda job: job.text("id")),
)
register_mapping(
    "apple",
    Mapping(_list_at(), _apple, same=_one_key("id", "reqId", "positionId"),
            keep=lambda job, page: ~((kind(job["postExternal"]) == "BOOLEAN") & (scalar_text(job["postExternal"]) == "False"))
            .eqNullSafe(F.lit(True))),
)
register_mapping("eightfold", Mapping(_eightfold_items, _eightfold))
register_mapping(
    "oracle",
    Mapping(_list_at("items", 0, "requisitionList"), _oracle, same=_one_key("Id"), keep=_oracle_open,
            detail_key=lambda job: scalar_text(job["Id"])),
)
register_mapping("smartrecruiters", Mapping(_list_at("content"), _smartrecruiters))
register_mapping("usajobs", Mapping(_list_at("Jobs"), _usajobs))
register_mapping("verizon", Mapping(_list_at("jobs"), _verizon, same=_one_key("Id")))
register_mapping("walmart", Mapping(_list_at("data", "jobSearchAssistant", "tool_messages", 0, "artifact", "jobs"), _walmart,
                                    same=_one_key("job_id")))
register_mapping(
    "mcloud",
    Mapping(lambda payload, doc: F.filter(F.transform(objects(at(doc, "searchResults")), lambda r: at(r, "job")),
                                          lambda j: kind(j).startswith("OBJECT")),
            _mcloud, same=_one_key("id", "ref")),
)


def map_landed(boards: DataFrame, provider: str, as_of: Column, details: DataFrame | None = None) -> DataFrame:
    """Any provider, including the ones whose page needs unpacking first."""
    from hiretide.operators import page_payloads

    if provider == "avature":
        return map_avature(boards, as_of)
    if provider == "talentbrew":
        return page_payloads.map_talentbrew(boards, as_of, details)
    if provider == "successfactors":
        return page_payloads.map_successfactors(boards, as_of, details)
    if provider == "apple":
        boards = apple_pages(boards)
    if provider == "eightfold":
        boards = eightfold_pages(boards)
    listings = map_payload(boards, provider, as_of, details)
    if provider == "google":
        # decided page by page, then deduplicated over both kinds
        served = listings.select("source_url", "page_ord").distinct()
        links = google_links(boards.join(served, ["source_url", "page_ord"], "left_anti"), as_of)
        unique = F.coalesce("ats_job_id", F.concat_ws("#", F.lit(""), F.col("page_ord"), F.col("pos")))
        both = listings.unionByName(links).withColumn("_same", unique)
        return best_per_key(both, ["source_url", "_same"], [F.col("page_ord"), F.col("pos")]).drop("_same")
    return listings


# --- declared counts and facets ------------------------------------------------------------


def declared_counts(boards: DataFrame) -> DataFrame:
    """PAY21: the number of jobs each landed board page declares.

    ``boards`` carries ats_provider (NULL when the URL could not be routed).
    """
    doc = F.col("_doc")
    listed = F.filter(objects(at(doc, "jobs")), lambda j: ~(
        (kind(at(j, "isListed")) == "BOOLEAN") & (scalar_text(at(j, "isListed")) == "False")).eqNullSafe(F.lit(True)))
    provider = F.col("ats_provider")
    count = (
        F.when(provider == "greenhouse", F.size(elements(at(doc, "jobs"))))
        .when(provider == "lever", F.size(elements(doc)))
        .when(provider == "ashby", F.size(listed))
        .when(provider == "smartrecruiters", F.try_variant_get(doc, "$.totalFound", "int"))
    )
    must = provider.isin("greenhouse", "lever", "ashby")
    parsed = _pages(boards).withColumn("expected_count", F.when(count >= 0, count))
    known = F.col("expected_count").isNotNull()
    status = F.when(provider.isNull() | (must & ~known), "failed").when(known, "counted").otherwise("unsupported_count_probe")
    return parsed.select("source_url", "ats_provider", "board_token", "expected_count", status.alias("status"))


def declared_summary(counts: DataFrame) -> DataFrame:
    """PAY21 totals."""
    status = F.col("status")
    return counts.agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(F.col("expected_count").isNotNull()).alias("counted_count"),
        F.count_if(status == "unsupported_count_probe").alias("unsupported_count"),
        F.count_if(status == "failed").alias("failed_count"),
    )


def best_split(buckets: DataFrame, scope: list[str]) -> DataFrame:
    """PAY22: the facet whose largest bucket is smallest, among facets with two or
    more counted buckets; the first facet wins a tie.

    ``buckets``: scope columns, facet, facet_ord, bucket_count.
    """
    sizes = buckets.filter(F.col("bucket_count").isNotNull()).groupBy(*scope, "facet").agg(
        F.max("bucket_count").alias("largest"), F.count(F.lit(1)).alias("buckets"), F.min("facet_ord").alias("facet_ord")
    ).filter("buckets >= 2")
    return best_per_key(sizes, scope, [F.col("largest"), F.col("facet_ord")])
