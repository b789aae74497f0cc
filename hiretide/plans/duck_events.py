"""Event columns and source matching restated in DuckDB SQL, for checks only."""

from __future__ import annotations

from hiretide import rules
from hiretide.plans.dialect import quoted
from hiretide.plans.duck_rules import any_term, first_label, label_list
from hiretide.plans.standin import duck_views

KIND = (
    f"CASE WHEN {any_term('t', rules.VIRTUAL_TERMS)} AND {any_term('t', rules.IN_PERSON_TERMS)} THEN 'hybrid' "
    f"WHEN {any_term('t', rules.VIRTUAL_TERMS)} THEN 'virtual' "
    f"WHEN {any_term('t', rules.IN_PERSON_TERMS)} THEN 'in_person' ELSE 'unknown' END"
)
TYPE = first_label({k: any_term("t", v) for k, v in rules.EVENT_TYPE_TERMS.items()}, "recruiting")
TAGS = f"list_sort({label_list({k: any_term('t', v) for k, v in rules.AUDIENCE_TERMS.items()})})"
PLACES = label_list(
    {
        "Virtual": any_term("t", rules.LOCATION_TEXT_TERMS["Virtual"]),
        "In person": f"NOT {any_term('t', rules.LOCATION_TEXT_TERMS['Virtual'])} AND "
                     + any_term("t", rules.LOCATION_TEXT_TERMS["In person"]),
    }
)


def firm(column: str) -> str:
    arms = []
    for name, (kind, words) in rules.FIRM_ALIASES.items():
        pattern = quoted("(^|[^a-z0-9])(" + "|".join(words) + ")($|[^a-z0-9])")
        arms.append(f"WHEN regexp_matches({column}, {pattern}) THEN {quoted(name)}")
    return f"CASE {' '.join(arms)} END"


EVENTS = f"""
ev0 AS (SELECT e.*, lower(event_title || ' ' || description) AS t FROM recruiting_events e),
ev1 AS (
  SELECT e.*, {KIND} AS location_type, {TYPE} AS event_type, {TAGS} AS audience_tags, {PLACES} AS places FROM ev0 e
),
ev AS (
  SELECT e.*, CASE WHEN len(places) > 0 THEN places WHEN location_type = 'virtual' THEN ['Virtual']
    ELSE ['Unspecified'] END AS location FROM ev1 e
),
src AS (
  SELECT s.*, regexp_extract(source_url, '^https?://([^/]+)', 1) AS host FROM event_sources s
),
pairs AS (
  SELECT e.event_id, s.source_url, s.source_ord,
    CASE WHEN s.source_url = e.event_url OR s.source_url = coalesce(e.registration_url, '') THEN 1
         WHEN s.host = 'events.example.com' AND s.firm_name = e.firm_name AND s.firm_kind = e.firm_kind THEN 2
         ELSE 3 END AS tier
  FROM ev e JOIN src s ON s.source_url = e.event_url OR s.source_url = e.registration_url
    OR (s.firm_name = e.firm_name AND s.firm_kind = e.firm_kind)
),
best AS (
  SELECT event_id, source_url, tier FROM pairs
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier, source_ord) = 1
),
event_table AS (
  SELECT e.*, content_hash AS id, b.source_url, b.tier, TIMESTAMP '2024-01-15 00:00:00' AS last_seen_at,
    coalesce(ends_at, starts_at) >= TIMESTAMP '2024-01-15 00:00:00' AS is_active
  FROM ev e LEFT JOIN best b ON b.event_id = e.event_id
)"""


def with_events(select: str, *views: str, extra: str = "") -> str:
    more = f",\n{extra}" if extra else ""
    return f"WITH {duck_views('recruiting_events', 'event_sources', *views)},{EVENTS}{more}\n{select}"
