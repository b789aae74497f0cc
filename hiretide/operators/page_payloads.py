"""HTML job boards to listings (PAY18, PAY19).

Arrow batches turn a page into plain facts (anchors, labels, texts); Spark does
the rest: URLs, dedupe, detail overlay, listing columns.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiretide import names
from hiretide.functions import dates
from hiretide.functions.dom import by_class, by_tag, link, outer_html, parse
from hiretide.functions.dom import facts as fact_schema
from hiretide.functions.expr import bound, clean_list, no_strings, present
from hiretide.operators.payloads import _listing, company_of, join_url, token_name
from hiretide.operators.routing import host
from hiretide.operators.skew import best_per_key

_ANCHOR = T.ArrayType(fact_schema(
    "href string, job_id string, title string, locations array<string>, teams array<string>"
))


def _labelled(anchor) -> dict[str, list[str]]:
    """Rows of 'label: value, value' inside a result link."""
    info = {}
    for row in anchor.select(by_class("section3__job-information")):
        label, value = row.first(by_tag("span")), row.first(by_class("section3__job-info"))
        if label and value:
            values = re.split(r"[,|]", value.text())
            info[label.text().rstrip(":")] = [v.strip() for v in values if v.strip()]
    return info


def _card_info(anchor) -> dict[str, list[str]]:
    """Location and category of the list item around a result link."""
    item = anchor.parent
    while item is not None and item.tag != "li":
        item = item.parent
    if item is None:
        return {}
    place = item.first(by_class("sr-job-location")) or item.first(by_class("location", "job-location"))
    team = item.first(by_class("sr-job-type")) or item.first(by_class("category"))
    found = {"Location": place, "Team": team}
    return {k: [v.text()] for k, v in found.items() if v}


def _anchor_title(anchor) -> str:
    marked = anchor.first(by_class("section3__job-title"))
    title = marked.text() if marked else anchor.attrs.get("data-title", "").strip()
    if title:
        return title
    heading = anchor.first(lambda e: e.tag in ("h1", "h2", "h3") or "job-card__title" in e.classes)
    return heading.text() if heading else anchor.text()


def _inside_results(element) -> bool:
    while element is not None:
        if element.attrs.get("id") == "search-results":
            return True
        element = element.parent
    return False


@F.pandas_udf(_ANCHOR)
def _result_links(pages: pd.Series) -> pd.Series:
    def is_result(e) -> bool:
        styled = any(c in ("section3__search-results-a", "sr-job-item__link") for c in e.classes)
        return link(e) and (styled or ("data-job-id" in e.attrs and _inside_results(e.parent)))

    def links(markup: str) -> list[dict]:
        found = []
        for a in parse(markup).select(is_result):
            info = _labelled(a) or _card_info(a)
            found.append({
                "href": a.attrs["href"], "job_id": a.attrs.get("data-job-id") or None, "title": _anchor_title(a),
                "locations": info.get("Location", []) + info.get("Additional Locations", []),
                "teams": info.get("Team", []),
            })
        return found

    return pages.map(links, na_action="ignore")


@F.pandas_udf(T.StringType())
def posting_schema(pages: pd.Series) -> pd.Series:
    """The JobPosting object of a detail page, as JSON text."""
    def schema(markup: str) -> str | None:
        scripts = parse(markup).select(lambda e: e.tag == "script" and e.attrs.get("type") == "application/ld+json")
        for script in scripts:
            try:
                found = json.loads("".join(c for c in script.children if isinstance(c, str)))
            except ValueError:
                continue
            if isinstance(found, dict) and found.get("@type") == "JobPosting":
                return json.dumps(found)
        return None

    return pages.map(schema, na_action="ignore")


def _last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def map_talentbrew(boards: DataFrame, as_of: Column, details: DataFrame | None = None) -> DataFrame:
    """PAY18.  ``details``: source_url, detail_key (job URL), payload (page)."""
    carry = ["source_url", "board_token", "page_ord"]
    found = boards.select(*carry, F.posexplode(_result_links(F.col("payload"))).alias("pos", "_a"))
    a = F.col("_a")
    facts = found.select(
        *carry, "pos", present(a.title).alias("_title"), join_url(F.col("source_url"), a.href).alias("_url"),
        a.job_id.alias("_given"), clean_list(a.locations).alias("_location"), clean_list(a.teams).alias("_departments"),
        F.concat_ws(" | ", present(a.title), *[
            F.nullif(F.array_join(values, ", "), F.lit("")) for values in (a.locations, a.teams)
        ]).alias("_summary"),
    )
    facts = facts.withColumn("_number", F.coalesce(present(F.col("_given")), _last_segment(F.col("_url"))))
    first = best_per_key(facts.filter("_number <> ''"), ["source_url", "_number"], [F.col("page_ord"), F.col("pos")])
    if details is not None:
        schema = details.select(
            "source_url", F.col("detail_key").alias("_url"), posting_schema(F.col("payload")).alias("_schema")
        )
        first = first.join(schema, ["source_url", "_url"], "left")
    else:
        first = first.withColumn("_schema", F.lit(None).cast("string"))
    overlaid = host(F.col("source_url")).isin(*names.TALENTBREW_DETAIL_HOSTS)
    schema = F.when(overlaid, F.col("_schema"))
    body = present(F.get_json_object(schema, "$.description"))
    flat = first.withColumns(
        {
            "_company": company_of(names.TALENTBREW_HOSTS, host(F.col("source_url")), token_name(F.col("board_token"))),
            "_markup": F.coalesce(F.when(body.isNotNull(), F.get_json_object(schema, "$.description")), F.col("_summary")),
            "_date": dates.listing_timestamp(F.get_json_object(schema, "$.datePosted")),
        }
    )
    return _listing(flat, "talentbrew", as_of, carry)


_ROW = T.ArrayType(fact_schema("href string, title string, place string"))


@F.pandas_udf(_ROW)
def _table_rows(pages: pd.Series) -> pd.Series:
    def rows(markup: str) -> list[dict]:
        found = []
        for row in parse(markup).select(lambda e: e.tag == "tr" and "data-row" in e.classes):
            anchor = row.first(lambda e: link(e) and "jobTitle-link" in e.classes)
            if anchor is None:
                continue
            place = row.first(by_class("jobLocation"))
            found.append({
                "href": anchor.attrs["href"], "title": anchor.text(), "place": place.text() if place else "Unspecified",
            })
        return found

    return pages.map(rows, na_action="ignore")


_DETAIL = fact_schema("description string, posted string, department string")


@F.pandas_udf(_DETAIL)
def _detail_facts(pages: pd.Series) -> pd.DataFrame:
    def facts(markup) -> tuple:
        if not isinstance(markup, str):
            return None, None, None
        root = parse(markup)
        body = root.first(by_class("jobdescription", "job", "jobDisplay"))
        posted = root.first(lambda e: e.tag == "meta" and e.attrs.get("itemprop") == "datePosted")
        team = root.first(lambda e: e.attrs.get("data-careersite-propertyid") == "department")
        return (
            outer_html(body) if body else None,
            (posted.attrs.get("content") or None) if posted else None,
            team.text() if team else None,
        )

    return pd.DataFrame([facts(m) for m in pages], columns=["description", "posted", "department"])


def map_successfactors(boards: DataFrame, as_of: Column, details: DataFrame | None = None) -> DataFrame:
    """PAY19.  ``details``: source_url, detail_key (job URL), payload (page)."""
    carry = ["source_url", "board_token", "page_ord"]
    found = boards.select(*carry, F.posexplode(_table_rows(F.col("payload"))).alias("pos", "_r"))
    r = F.col("_r")
    rows = found.select(
        *carry, "pos", present(r.title).alias("_title"),
        join_url(F.lit("https://jobs.sap.com"), r.href).alias("_url"), present(r.place).alias("_place"),
    )
    first = best_per_key(rows, ["source_url", "_url"], [F.col("page_ord"), F.col("pos")])
    if details is not None:
        facts = details.select("source_url", F.col("detail_key").alias("_url"), _detail_facts(F.col("payload")).alias("_d"))
        first = first.join(facts, ["source_url", "_url"], "left")
    else:
        first = first.withColumn("_d", F.lit(None).cast(_DETAIL))
    d = F.col("_d")
    flat = first.withColumns(
        {
            "_company": F.lit("SAP"),
            "_number": _last_segment(F.col("_url")),
            "_location": F.array_compact(F.array("_place")),
            "_markup": F.coalesce(F.nullif(d.description, F.lit("")), F.col("_title")),
            "_departments": bound(present(d.department), lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(no_strings())),
            "_date": dates.listing_timestamp(d.posted),
        }
    )
    flat = flat.withColumn("_html", F.when(F.col("_markup").contains("<"), F.col("_markup")))
    return _listing(flat, "successfactors", as_of, carry)
