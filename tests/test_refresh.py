"""A refresh keeps texts in the landed files and in the table only, whatever it moves
between tasks goes when it is written, and portions of a table are renewed one by one."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from hiretide import session
from hiretide.operators import classify, state, validate
from hiretide.operators.state import replace_rows
from hiretide.streaming import refresh
from hiretide.streaming.refresh import KeyedTable

LISTING = (
    "doc_id bigint, company_name string, job_title string, job_url string, ats_provider string, ats_job_id string, location array<string>,"
    " raw_description string, description_html string, employment_type string, departments array<string>, date_posted timestamp,"
    " content_hash string, extracted_at timestamp"
)
COMPANY = (
    "id string, name string, ats_provider string, career_page_url string, ats_board_token string, is_active boolean,"
    " last_scraped_at timestamp, created_at timestamp"
)


def as_of():
    return F.lit("2026-06-01 00:00:00").cast("timestamp")


def hashed(name):
    return hashlib.sha256(str(name).encode()).hexdigest()


def listing(i, company="acme", provider="lever", url="https://x.org/1", name=None, words=5, title="Engineer"):
    text = " ".join(random.Random(i).choices([f"word{n}" for n in range(5000)], k=words))
    return (i, company, title, url, provider, str(i), ["Paris"], text, None, None, [], None, hashed(i if name is None else name), "2026-05-01 00:00:00")


def landed(spark, rows, path):
    stamped = spark.createDataFrame(rows, LISTING.replace("extracted_at timestamp", "extracted_at string"))
    stamped = stamped.withColumn("extracted_at", F.col("extracted_at").cast("timestamp"))
    stamped.write.mode("append").parquet(path)
    return spark.readStream.schema(stamped.schema).parquet(path)


def opened(spark, tmp_path):
    none = spark.createDataFrame([], LISTING)
    jobs = state.job_rows(classify.normalize(none, as_of()), as_of())
    return (
        KeyedTable(str(tmp_path / "jobs"), spark.createDataFrame([], jobs.schema), ("content_hash",)),
        KeyedTable(str(tmp_path / "firms"), spark.createDataFrame([], COMPANY), ("name", "ats_provider")),
    )


def refreshed(spark, tmp_path, rows, **options):
    tables, stream = opened(spark, tmp_path), landed(spark, rows, str(tmp_path / "landed"))
    refresh.refresh_jobs(
        stream, *tables, str(tmp_path / "letters"), as_of(), str(tmp_path / "marks"), ["doc_id"], **options
    ).awaitTermination()
    return tables


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """A shared folder of the test's own."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "shared"))
    return str(tmp_path / "shared")


def shuffled(spark):
    """Bytes of shuffle files."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    total = 0
    for top in dirs:
        for at, _, names in os.walk(str(top)):
            for n in names:
                try:
                    total += os.path.getsize(os.path.join(at, n)) if n.startswith("shuffle_") else 0
                except OSError:  # removed meanwhile
                    pass
    return total


def test_no_copies_of_texts_and_no_shuffle_files_are_left(spark, tmp_path, shared):
    rows = [listing(i, company=f"c{i % 7}", words=4000) for i in range(200)]
    texts, before = sum(len(r[7]) for r in rows), shuffled(spark)
    jobs, firms = refreshed(spark, tmp_path, rows)
    for _ in range(40):
        if shuffled(spark) - before < texts / 10:
            break
        time.sleep(0.5)
    assert shuffled(spark) - before < texts / 10
    written = [spark.read.parquet(f"{shared}/{name}").columns for name in os.listdir(shared)]
    assert written and not any("raw_description" in c or "cleaned_description" in c for c in written)
    assert jobs.read().count() == 200 and firms.read().count() == 7


@pytest.mark.parametrize("hold", [False, True])
def test_refresh_quarantines_dedupes_and_upserts(spark, tmp_path, shared, hold):
    rows = [
        *[listing(i) for i in range(30)],
        listing(30, name=3, title="Later copy"),  # the first listing of a hash counts
        listing(31, company="bad", provider="workday", url="ftp://x"), listing(32, company="bad", provider="workday"),
        listing(33, company="spoiled", url="ftp://x"), listing(34, company="spoiled"),
    ]
    jobs, firms = refreshed(spark, tmp_path, rows, hold=hold)
    got = {r.content_hash: r for r in jobs.read().collect()}
    assert set(got) == {hashed(i) for i in [*range(30), 32]} and got[hashed(3)].job_title == "Engineer"
    assert sorted(r.name for r in firms.read().collect()) == ["acme", "bad"]
    letters = spark.read.schema("failure struct<source_url:string,message:string>").json(str(tmp_path / "letters" / "*" / "*"))
    assert [tuple(r) for r in letters.select("failure.*").collect()] == [("ftp://x", "job_url")] * 2
    # a second batch replaces, adds, and leaves the others
    jobs, _ = refreshed(spark, tmp_path, [listing(35, name=5, title="Analyst"), listing(36)], hold=hold)
    again = {r.content_hash: r for r in jobs.read().collect()}
    assert set(again) == {*got, hashed(36)} and again[hashed(5)].job_title == "Analyst"
    assert all(again[h] == got[h] for h in got if h != hashed(5))


def test_portions_are_renewed_one_by_one(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), spark.createDataFrame([], "k string, v int"), ("k",), 8)
    cleanup, seen = spark.conf.get(refresh._CLEANUP, "false"), []

    def put(rows):
        def change(held, some):
            seen.append((held.count(), some.count(), spark.conf.get(refresh._CLEANUP)))
            return replace_rows(held, some, ["k"], keep=())

        table.update_in_portions(rows.select("k"), rows, change)

    put(spark.createDataFrame([(str(i), i) for i in range(100)], "k string, v int"))
    assert len(seen) == refresh.PORTIONS and sum(n for _, n, _ in seen) == 100 and all(0 < n < 100 for _, n, _ in seen)
    put(spark.createDataFrame([(str(i), -i) for i in range(50, 150)], "k string, v int"))
    assert sum(h for h, _, _ in seen[refresh.PORTIONS:]) == 100 and {c for _, _, c in seen} == {"true"}
    assert sorted(map(tuple, table.read().collect())) == sorted((str(i), i if i < 50 else -i) for i in range(150))
    assert spark.conf.get(refresh._CLEANUP, "false") == cleanup
    one = spark.createDataFrame([("7", 70)], "k string, v int")
    put(one)
    assert len(seen) == 2 * refresh.PORTIONS + 1 and table.read().filter("k = '7'").first().v == 70
    with pytest.raises(ValueError, match="do not name"):
        table.update_in_portions(one, one, lambda held, some: spark.createDataFrame([(str(i), 0) for i in range(40)], "k string, v int"))
    assert table.read().filter("v = 0").count() == 1  # key 0 has been 0 all along


def test_known_spoiled_boards_are_used(spark):
    rows = spark.createDataFrame([listing(1, url="ftp://x"), listing(2), listing(3, company="other")], LISTING.replace("extracted_at timestamp", "extracted_at string"))
    rows, board = rows.withColumn("extracted_at", F.col("extracted_at").cast("timestamp")), ["ats_provider", "company_name"]
    spoiled = validate.spoiled_boards(validate.with_errors(rows, validate.listing_errors()), board)
    assert [tuple(r) for r in spoiled.collect()] == [("lever", "acme")]
    for part, ids in ((rows, [3]), (rows.filter("doc_id > 1"), [3])):
        kept, _ = validate.quarantine(part, validate.listing_errors(), board, spoiled)
        assert [r.doc_id for r in kept.collect()] == ids
