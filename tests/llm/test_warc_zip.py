import hashlib
import io
import zipfile
from collections import Counter

import pytest
from pyspark.sql import types as T

from hiretide.llm import warc_zip as w

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in ("_id", "_digest", "record_type")],
])


def page_rows():
    big, other = "é" * 700, "<p>" * 400
    rows = [(i, f"http://h/{i}\r\nX: y", big if i % 3 == 0 else other if i % 3 == 1 else f"small {i % 4}") for i in range(60)]
    rows += [(70, None, None), (71, "", ""), (72, "u", "a" * 999), (73, "u", "a" * 999), (74, "u", "b" * 1000), (75, "u", "b" * 1000)]
    rows += [rows[57], rows[57], rows[0], (None, "u", big), (None, None, None), (80, "u", "\r\n\r\nWARC/1.1\r\n" * 200_000)]
    return [(*r, "x", "x", "x") for r in rows]


def expected(rows):
    largest = {}
    for page_id, _, html, *_ in rows:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            largest[html] = max(largest.get(html, -1), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        winner = largest.get(html, page_id)
        revisit = page_id is not None and len(data) >= 1000 and winner != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", winner if revisit else None))
    return Counter(out)


def test_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    assert Counter(map(tuple, w.round_trip(pages).collect())) == expected(rows)
    assert w.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_archives_are_bounded_zip_files_read_by_range(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES).coalesce(1)
    table = w.write_archives(pages, f"file://{tmp_path}/a", archive_bytes=2000)
    assert table.count() > 3
    total = 0
    for row in table.collect():
        with zipfile.ZipFile(row["path"]) as z:
            assert [i.compress_type for i in z.infolist()] == [0, 0] and z.testzip() is None
            total += len(z.read(w.INDEX).splitlines())
            with open(row["path"], "rb") as file:
                entries = w.directory(file, len(open(row["path"], "rb").read()))
                start, length = w.stored_member(file, entries, w.DATA)
                assert w.read_range(file, start, length) == z.read(w.DATA)
    assert total == len(page_rows())
    records = w.read_archives(table, f"file://{tmp_path}/a", range_bytes=500)
    payloads = {r.record_id: r.payload for r in records.collect() if r.record_type == "response"}
    assert bytes(payloads["urn:page:72"]) == b"a" * 999


def test_zip64_directory():
    """A directory whose sizes and offsets are only in the ZIP64 fields."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open("a", "w", force_zip64=True) as member:
            member.write(b"hello")
        z.writestr("b", b"world!")
        z.comment = b"PK\x05\x06 in a comment"
    limit, zipfile.ZIP64_LIMIT = zipfile.ZIP64_LIMIT, 3
    try:
        wide = io.BytesIO()
        with zipfile.ZipFile(wide, "w") as z:
            z.writestr("a", b"hello")
            z.writestr("b", b"world!")
    finally:
        zipfile.ZIP64_LIMIT = limit
    for file in (raw, wide):
        entries = w.directory(file, len(file.getvalue()))
        for name, data in (("a", b"hello"), ("b", b"world!")):
            start, length = w.stored_member(file, entries, name)
            assert w.read_range(file, start, length) == data
    with pytest.raises(ValueError, match="not a ZIP"):
        w.directory(io.BytesIO(b"x" * 100), 100)
    with pytest.raises(ValueError, match="stored"):
        w.stored_member(raw, [], "a")


def test_text_ids_forge_no_header(spark):
    big = "x" * 2000
    ids = ["a\r\nWARC-Type: metadata", "b>", "c+d %41", "ä", " e ", "<f"]
    found = {r["page_id"]: r for r in w.round_trip(spark.createDataFrame([(i, "u", big) for i in ids], "page_id string, url string, html string")).collect()}
    assert set(found) == set(ids)
    assert {i for i, r in found.items() if r["record_type"] == "response"} == {max(ids)}
    assert {r["refers_to"] for i, r in found.items() if i != max(ids)} == {max(ids)}
    assert {r["payload_bytes"] for r in found.values()} == {2000}


def test_archives_are_read_once(spark):
    plan = w.round_trip(spark.createDataFrame(page_rows(), PAGES))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
