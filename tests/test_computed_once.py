"""Texts, pages and JSON are read once however many labels, terms or fields are asked for."""

import re

from pyspark.sql import functions as F

from hiretide.functions import text as tx
from hiretide.functions.expr import contains_any, present
from hiretide.functions.terms import label_scan
from hiretide.operators import classify, event_pages

TABLE = {"a": ("alpha", "alp"), "b": ("beta",), "c": ("gamma",)}


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    return spark.createDataFrame([(1, "Alpha and BETA"), (2, None), (3, "")], "id int, t string")


def test_scan_is_not_repeated_for_every_label(spark):
    df = texts(spark).select("id", label_scan(F.lower("t"), TABLE).alias("found"))
    assert {r.id: r.found for r in df.collect()} == {1: ["a", "b"], 2: [], 3: []}
    assert re.findall(r"arrays_overlap\((\w+)", optimized(df)) == ["lambda"]


def test_skills_are_scanned_once(spark):
    rows = spark.createDataFrame([("python and go",)], "t string")
    df = rows.select(classify.required_skills(F.col("t")).alias("s"))
    assert df.first().s == ["go", "python"]
    assert re.findall(r"arrays_overlap\((\w+)", optimized(df)) == ["lambda"]


def test_terms_are_looked_for_in_one_text(spark):
    df = texts(spark).withColumn("low", F.lower("t")).select("id", contains_any(F.col("low"), ("beta", "x")).alias("y"))
    assert {r.id: r.y for r in df.collect()} == {1: True, 2: None, 3: False}
    assert "Contains(lower" not in optimized(df)


def test_empty_texts_are_null_and_computed_once(spark):
    df = spark.createDataFrame([(" a ",), (" ",), (None,)], "t string").select(
        F.transform(F.array("t"), present)[0].alias("p")
    )
    assert [r.p for r in df.collect()] == ["a", None, None]
    assert optimized(df).count("trim(") == 1


def test_lines_are_tidied_only_where_they_need_it(spark):
    samples = ["a b\nc", "a  b", "a\tb", "a \nb", "a\n b", "a\n\nb", "a\n\n\n\nb \t\n\n c", " a\x0b\fb\r", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    plain = F.regexp_replace(F.regexp_replace("t", tx.BLANK_RUN, " "), tx.BREAK_RUN, "\n")
    wanted = tx.strip(F.regexp_replace(plain, r"\n{3,}", "\n\n"))
    got = df.select(tx._tidy_lines(F.col("t")).alias("a"), wanted.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def page(spark, body, provider="company_events"):
    return spark.createDataFrame(
        [(1, "https://x.org/e", "text/html", body, "F", "other", provider, "company_page", [])],
        "page_id int, url string, content_type string, body string, firm_name string, firm_kind string, source_provider string,"
        " source_scope string, firm_aliases array<string>",
    )


def test_script_objects_are_parsed_once(spark):
    body = (
        '<script>window.d = {"eventData": {"name": "Talk", "plannedEventEncId": "", "id": 7, "startTimestamp": 1700000000,'
        ' "url": {"url": "https://x.org/1"}}};</script>'
    )
    found = event_pages.eightfold_events(page(spark, body), F.lit("2024-01-01").cast("timestamp"))
    row = found.first()
    assert (row.event_title, row.source_event_id, row.event_url) == ("Talk", "7", "https://x.org/1")
    assert optimized(found).lower().replace("_", "").count("parsejson") == 1


def test_page_batches_are_bounded_by_bytes(spark):
    from hiretide.session import configure

    limit = configure(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert limit == "2m"
