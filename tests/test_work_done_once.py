"""Rows, cards, objects and rules are worked on once, and only where somebody reads them."""

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from hiretide.functions import variant
from hiretide.functions.expr import SPACE_CHARS, strip
from hiretide.llm import toxicity
from hiretide.operators import event_pages, events, state
from hiretide.plans import checks, registry, tables
from hiretide.sources import artifacts

AS_OF = "2026-06-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def pages(spark, *bodies):
    return spark.createDataFrame(
        [(i, "https://x.org/e", "text/html", b, "F", "other", "company_events", "company_page", []) for i, b in enumerate(bodies)],
        "page_id int, url string, content_type string, body string, firm_name string, firm_kind string, source_provider string,"
        " source_scope string, firm_aliases array<string>",
    )


CARD = '<article class="event"><h3>Campus workshop</h3><time datetime="2026-09-02T10:00:00Z"></time><a href="/a">Register here</a></article>'
LD = '<script type="application/ld+json">{"@type": "Event", "name": "Fair", "startDate": "2026-09-01T10:00:00Z", "url": "https://e.org/1"}</script>'


def test_cards_of_several_selectors_are_one_part_of_page_events(spark):
    parts = event_pages.page_parts(pages(spark, CARD), (event_pages.CARD,)).orderBy("pos").collect()
    assert [(r.selector, r.again) for r in parts] == [(0, False), (2, True)]
    assert parts[0].text == parts[1].text and parts[0].cells == parts[1].cells == []
    found = event_pages.page_events(pages(spark, CARD), as_of()).collect()
    assert [(r.event_title, r.extractor_ord) for r in found] == [("Campus workshop", 6)]


def test_objects_of_two_extractors_are_mapped_once(spark):
    parts = event_pages.page_parts(pages(spark, LD))
    assert event_pages.json_ld_events(None, as_of(), parts).count() == event_pages.embedded_events(None, as_of(), parts).count() == 1
    once = event_pages.script_events(as_of(), parts, 2, 3)
    assert [(r.event_title, r.extractor_ord) for r in once.collect()] == [("Fair", 2)]


def test_pages_are_dealt_over_more_tasks_than_cores(spark):
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert event_pages.page_parts(pages(spark, CARD).coalesce(1)).rdd.getNumPartitions() == tasks


def test_served_pages_reach_the_extractors_and_the_feed_is_mapped_once(spark):
    mapped = spark.sparkContext.accumulator(0)

    def seen(page):
        mapped.add(1)
        return page

    feed = spark.createDataFrame([(1, "f")], "page_id long, e string").withColumn("e", F.udf(seen)("e"))
    ld = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "page_id long, e string")
    asked = []

    def generic(served):
        asked.extend(r.page_id for r in served.collect())
        return ld.join(served, "page_id", "left_anti")

    rows = events.with_precedence(feed, [generic, ld], "page_id").collect()
    assert sorted((r.e, r.extractor_ord) for r in rows) == [("f", 0), ("y", 1), ("y", 2), ("z", 1), ("z", 2)]
    assert asked == [1] and mapped.value == 1


def test_rule_columns_nobody_reads_are_not_computed(spark):
    checks.load()
    sf_dir = "/root/testdata/sf0.001"
    read = tables.jobs(spark, sf_dir, ("is_active",))
    assert "aggregate(" not in optimized(read) and "aggregate(" in optimized(tables.jobs(spark, sf_dir))
    for name in ("q13_featured", "r4_relevance_sweep", "r4_sweep_summary"):
        assert "taken" not in optimized(registry.QUERIES[name](spark, sf_dir)), name


def test_ties_are_told_apart_by_the_named_columns(spark):
    schema = "content_hash string, id string, first_seen_at int, job_title string, extracted_at int, made string"
    old = spark.createDataFrame([("a", "1", 1, "t", 1, "m")], schema)
    new = spark.createDataFrame([("a", "2", 2, "u", 5, "n"), ("a", "3", 3, "v", 4, "o"), ("b", "4", 4, "w", 1, "p"), (None, "5", 5, "x", 1, "q")], schema)
    new = new.withColumn("made", F.upper("made"))
    for told_by in (None, ("job_title",)):
        rows = state.upsert_jobs(old, new, told_by)
        assert sorted((r.content_hash, r.id, r.first_seen_at, r.job_title, r.made) for r in rows.collect()) == [
            ("a", "1", 1, "u", "N"), ("b", "4", 4, "w", "P"),
        ]
    assert "upper(" not in optimized(state.upsert_jobs(old, new, ("job_title",)).select("job_title"))


def test_written_records_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(status):
        made.add(1)
        return status

    rows = spark.createDataFrame([Row(i=i, s="COMPLETE" if i else "NEEDS_REVIEW") for i in range(3)])
    records = rows.withColumn("s", F.udf(seen)("s")).select(F.struct(F.col("s").alias("normalization_status")).alias("normalization"))
    artifacts.write_normalized(records, rows, f"{tmp_path}/a", as_of())
    summary = spark.read.json(f"{tmp_path}/a/summary").first()
    assert (summary.source_job_count, summary.normalized_job_count, summary.status_counts.asDict()) == (
        3, 3, {"COMPLETE": 2, "NEEDS_REVIEW": 1}
    )
    assert made.value == 3
    artifacts.write_normalized(records.limit(0), rows.limit(0), f"{tmp_path}/b", as_of())
    assert spark.read.json(f"{tmp_path}/b/summary").first().normalized_job_count == 0


def test_texts_without_blanks_at_an_end_are_not_trimmed_and_equal(spark):
    samples = ["a", " a", "a　", "", " ", "a b", "\U0001f600 ", "\x85x", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = df.select(strip(F.col("t")).alias("a"), F.btrim("t", F.lit(SPACE_CHARS)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_first_filled_value(spark):
    docs = ['{"a": null, "b": "", "c": 7}', '{"a": {"x": 1}, "b": "t"}', '{"b": [], "c": ""}', '{}', '[1]', None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").withColumn("v", F.try_parse_json("d"))
    got = df.orderBy("i").select(F.to_json(variant.first_value(F.col("v"), "a", "b", "c")).alias("j")).collect()
    assert [r.j for r in got] == ["7", '{"x":1}', "[]", None, None, None]


def test_machine_is_the_same_in_small_blocks(monkeypatch):
    positive, negative = [f"grum{i}fel" for i in range(30)], [f"calm{i}word" for i in range(60)]
    whole = toxicity.train(positive, np.ones(30), negative)
    monkeypatch.setattr(toxicity, "ROW_BLOCK", 7)
    blocks = toxicity.train(positive, np.ones(30), negative)
    assert np.allclose(whole.table, blocks.table, atol=1e-5) and abs(whole.bias - blocks.bias) < 1e-6
