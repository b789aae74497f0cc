"""One parse per page, and the precedence of feeds and extractors."""

import json

import pytest
from pyspark.sql import functions as F

from hiretide.operators import event_pages

PAGE = (
    "page_id int, url string, content_type string, body string, firm_name string, firm_kind string, "
    "source_provider string, source_scope string, firm_aliases array<string>"
)

def as_of():
    return F.lit("2026-06-01 00:00:00").cast("timestamp")



def ld(name, day=1):
    item = {"@type": "Event", "name": name, "startDate": f"2026-09-{day:02d}T10:00:00Z", "url": f"https://e.org/{name}"}
    return f'<script type="application/ld+json">{json.dumps(item)}</script>'


def card(name, day=2):
    return (f'<article class="event"><h3>{name} workshop with Amazon</h3><time datetime="2026-09-{day:02d}T10:00:00Z"></time>'
            f'<a href="/{name}">x</a></article>')


def agency(name):
    return (f'<a class="hds-event-item" href="/a/{name}" event-id="{name}"><p class="hds-event-title">{name}</p>'
            '<p data-event-start-date="2026-09-03">day</p></a>')


STATE = {"eventData": {"name": "state event", "plannedEventEncId": "id9", "startTimestamp": 1790000000}}
EMBEDDED = json.dumps({"title": "embedded event", "startDate": "2026-09-05"})
CALENDAR = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:c1\nSUMMARY:Calendar fair\nDTSTART:20260910T080000Z\nEND:VEVENT\nEND:VCALENDAR\n"
FEED = json.dumps([{"title": "feed event", "startDate": "2026-09-07"}])

BODIES = [
    # body, provider, url
    (ld("one") + card("two") + agency("three") + f"<script>{EMBEDDED}</script>", "company_events", "https://a.org/1"),
    (FEED, "nvidia_university_events", "https://a.org/2"),
    (ld("nofeed") + card("c4"), "nvidia_university_events", "https://a.org/3"),
    (f"<script>var s = {json.dumps(STATE)};</script>", "company_events", "https://jobs.a.org/4"),
    (ld("fallback"), "eightfold_events", "https://a.org/5"),
    (CALENDAR, "company_events", "https://a.org/6.ics"),
    (card("amz") + ld("Amazon day"), "amazon_hiring_events", "https://hiring.amazon.com/7"),
    (None, "company_events", "https://a.org/8"),
    ("", "company_events", "https://a.org/9"),
    (json.dumps({"events": [{"event_name": "jp", "date_start": "2026-09-09", "start_time": "10:00 AM"}]}), "company_events",
     "https://jobs.jpmorganchase.com/10"),
    (card("x") + card("x"), "company_events", "https://a.org/11"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, url, "text/html", body, "Firm", "other", provider, "university_calendar", []) for i, (body, provider, url) in enumerate(BODIES)]
    return spark.createDataFrame(rows, PAGE).repartition(3)


def by_extractors(pages):
    """The same precedence, from every extractor run on its own over all pages."""
    feeds = {**event_pages.JSON_FEEDS, **event_pages.PAGE_FEEDS}
    generic = (
        event_pages.calendar_events, event_pages.json_ld_events, event_pages.embedded_events, event_pages.site_card_events,
        event_pages.recruiting_card_events, event_pages.html_card_events,
    )
    found = {name: extract(pages, as_of()).collect() for name, extract in [*feeds.items(), *enumerate(generic, start=1)]}
    out = []
    for row in event_pages.asked_feeds(pages).collect():
        def mine(name):
            return [r for r in found[name] if r["page_id"] == row["page_id"]]

        served = next((mine(feed) for feed in row["_asks"] if mine(feed)), None)
        orders = [1] if row["url"].endswith(".ics") else range(2, 7)
        every = [(0, r) for r in served] if served else [(order, r) for order in orders for r in mine(order)]
        first = {}
        for order, r in sorted(every, key=lambda e: (e[0], e[1]["pos"])):
            first.setdefault(r["content_hash"], (order, r))
        out += [(row["page_id"], order, r["event_title"], r["firm_name"], r["content_hash"]) for order, r in first.values()]
    return sorted(out)


def test_page_events_equal_the_extractors_one_by_one(pages):
    found = event_pages.page_events(pages, as_of())
    got = sorted((r["page_id"], r["extractor_ord"], r["event_title"], r["firm_name"], r["content_hash"]) for r in found.collect())
    assert got == by_extractors(pages)
    assert {o for _, o, *_ in got} >= {0, 1, 2, 3, 4, 5}
    titles = {t for _, _, t, *_ in got}
    assert {"feed event", "state event", "jp", "Calendar fair", "nofeed", "fallback"} - titles == set()


def _python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return plan.count("ArrowEvalPython") + plan.count("InArrow") + plan.count("InPandas") + plan.count("BatchEvalPython")


def test_one_python_step_for_all_parts(pages):
    assert _python_nodes(event_pages.page_parts(pages)) == 1
    # what follows reads the written parts
    assert _python_nodes(event_pages.page_events(pages, as_of())) == 0


def test_parts_are_those_of_separate_parses(pages):
    key = ["page_id", "part", "pos"]
    together = sorted(map(str, event_pages.page_parts(pages).orderBy(*key).collect()))
    apart = []
    for kind in (event_pages.SCRIPT, event_pages.CARD, event_pages.SITE):
        apart += map(str, event_pages.page_parts(pages, (kind,)).collect())
    assert together == sorted(apart)


def test_feeds_asked(spark, pages):
    asks = {r["page_id"]: r["_asks"] for r in event_pages.asked_feeds(pages).collect()}
    assert asks[0] == [] and asks[1] == ["nvidia"] and asks[4] == ["eightfold"] and asks[9] == ["eightfold", "jpmorgan"]
