"""Web archives packaged in ZIP files, written and read with range reads.

Writing: every task appends its records to archives of bounded size in a shared
folder.  An archive is a ZIP file with two stored members, ``archive/data.warc.gz``
(the records, each a gzip member of its own) and ``indexes/index.jsonl`` (per record: id, offset, length), and a
ZIP64 directory.  Names hold the task attempt, and the table of archives is made
of what successful tasks report, so a repeated task leaves no double records.

Reading: for each archive the end record, the ZIP64 records and the central
directory are parsed, the stored members are located, and the index is read; then
records are read by byte range, spread over the cluster by size.  Nothing is
extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.llm.common import whole
from hiretide.session import materialize, scratch_path

LEAST_SHARED = 1000
# An archive is closed after the record that takes it past this.
ARCHIVE_BYTES = 64 << 20
# Records of one archive read by one task.
RANGE_BYTES = 8 << 20
# Tasks that read records, at most; beyond it a task reads several ranges.
MOST_TASKS = 50_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
GZIP_LEVEL = 3

# ---- ZIP directories ----

END, END64, LOCATOR64, ENTRY, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50


def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends within a range of {length} bytes at {start}")
    return data


def directory(file, size: int) -> list[dict]:
    """Entries of the central directory: name, method, offset of the local header,
    stored size.  Sizes and offsets of 2^32-1 are looked up in the ZIP64 fields."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read_range(file, tail_at, size - tail_at)
    at = len(tail) - 22
    while at >= 0 and not (
        tail[at:at + 4] == struct.pack("<I", END) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)
    ):
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if end_at >= 20:
        magic, _, end64_at, _ = struct.unpack("<IIQI", read_range(file, end_at - 20, 20))
        if magic == LOCATOR64:
            record = read_range(file, end64_at, 56)
            if struct.unpack_from("<I", record)[0] != END64:
                raise ValueError("broken ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, entries = read_range(file, start, length), 0, []
    for _ in range(count):
        if struct.unpack_from("<I", raw, at)[0] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        offset = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = raw[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            x += 4 + n
        entries.append({"name": name, "method": method, "offset": offset, "size": packed})
        at += 46 + n_name + n_extra + n_comment
    return entries


def stored_member(file, entries: list[dict], name: str) -> tuple[int, int]:
    """(first byte, length) of a stored member's data."""
    entry = next((e for e in entries if e["name"] == name), None)
    if entry is None or entry["method"] != 0:
        raise ValueError(f"{name} is not a stored member")
    header = read_range(file, entry["offset"], 30)
    if struct.unpack_from("<I", header)[0] != LOCAL:
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return entry["offset"] + 30 + n_name + n_extra, entry["size"]


# ---- WARC records ----


def record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, refers_to: str | None, length: int) -> bytes:
    block = b"" if kind == "revisit" else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: " + "1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[:int(fields["content-length"])]


# ---- files in the shared folder ----


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder URI; a plain path is a file path."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


class Archive:
    """One archive under construction: records stream into the data member."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self.index, self.size = path, [], 0
        self.stream = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, record_id: str, raw: bytes) -> None:
        self.data.write(raw)
        self.index.append(json.dumps({"id": record_id, "offset": self.size, "length": len(raw)}))
        self.size += len(raw)

    def close(self) -> dict:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return {"path": self.path, "records": len(self.index), "bytes": self.size}


def record_name(page_id: str | None) -> str:
    """Name of a page's record; whatever could end a header line or a name is escaped."""
    return "urn:page:" + ("" if page_id is None else quote(page_id, safe=""))


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        task, done, archive = TaskContext.get(), [], None
        label = f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["_html"] or "").encode("utf-8", "surrogatepass")
                kind = "response" if row["_winner"] is None else "revisit"
                record_id = record_name(row["_id"])
                refers = None if row["_winner"] is None else record_name(row["_winner"])
                uri = (row["_url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                raw = record(kind, record_id, uri, row["_digest"], payload, refers, len(payload))
                if archive is None:
                    archive = Archive(store, f"{base}/{label}-{len(done)}.zip")
                archive.add(record_id, gzip.compress(raw, GZIP_LEVEL, mtime=0))
                if archive.size >= most:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per page and returns the table of archives: ``path,
    records, bytes`` (itself written to the folder, so nothing is written twice).

    Of pages with equal payloads of at least 1000 bytes that with the largest id
    is a response (as are repeats of its row), the others revisit it; all others
    are responses.  A NULL html is an empty payload; a page without an id is a
    response, and is revisited by none.  Ids of any type with an order are written as
    text and percent-encoded.
    """
    rows = pages.select(
        F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"),
        F.sha1(whole(html).cast("binary")).alias("_digest"), F.octet_length(whole(html)).alias("_bytes"),
    )
    large = rows.filter(F.col("_bytes") >= LEAST_SHARED)
    winners = large.groupBy("_digest").agg(F.max("_id").alias("_largest"), F.min("_id").alias("_least")).filter("_largest > _least")
    winners = winners.select(F.col("_digest").alias("_equal"), "_largest")
    # large payloads are joined to the few digests that repeat; the rest pass by
    told = rows.join(winners, (rows["_digest"] == winners["_equal"]) & (rows["_bytes"] >= LEAST_SHARED), "left")
    told = told.withColumn("_winner", F.when(F.col("_largest") > F.col("_id"), F.col("_largest")))
    records = told.select(
        F.col("_id").cast("string").alias("_id"), "_url", "_html", "_digest", F.col("_winner").cast("string").alias("_winner")
    )
    spark, table = pages.sparkSession, f"{folder.rstrip('/')}/table"
    records.mapInArrow(_writer(f"{folder.rstrip('/')}/archives", archive_bytes), "path string, records long, bytes long").write.parquet(table)
    return spark.read.schema("path string, records long, bytes long").parquet(table)


def _locate(folder: str, range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = []
                with store.open_input_file(path) as file:
                    entries = directory(file, file.size())
                    data, _ = stored_member(file, entries, DATA)
                    index, length = stored_member(file, entries, INDEX)
                    start = None
                    for line in read_range(file, index, length).splitlines():
                        x = json.loads(line)
                        if start is None or x["offset"] - start >= range_bytes:
                            start = x["offset"]
                        found.append((path, data + start, data + x["offset"], x["length"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*found, strict=True)] if found else [pa.array([], t) for t in (pa.string(), *[pa.int64()] * 3)],
                    names=["path", "range", "offset", "length"],
                )

    return run


def _fetch(folder: str, with_payload: bool):
    names = ["record_id", "record_type", "uri", "digest", "payload_bytes", "refers_to", "actual_digest", "actual_bytes", "payload"]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows(store: fs.FileSystem, batch: pa.RecordBatch) -> Iterator[tuple]:
        file = path = None
        for row in batch.to_pylist():
            if row["path"] != path:
                if file:
                    file.close()
                path = row["path"]
                file = store.open_input_file(path)
            fields, payload = parse_record(gzip.decompress(read_range(file, row["offset"], row["length"])))
            refers = fields.get("warc-refers-to")
            yield (
                fields["warc-record-id"].strip("<>"), fields["warc-type"], fields["warc-target-uri"],
                fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"]),
                refers and refers.strip("<>"), hashlib.sha1(payload).hexdigest(), len(payload), payload if with_payload else None,
            )
        if file:
            file.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = list(rows(store, batch.slice(at, 256)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names
                )

    return run


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record: ``record_id, record_type, uri, digest, payload_bytes,
    refers_to`` from its headers, ``actual_digest, actual_bytes`` of the bytes read,
    and ``payload`` (revisits have none of their own).

    Archives are spread over tasks, then their records by ranges of about
    ``range_bytes``.  An archive without records gives no row; a file that is not
    such an archive is an error.
    """
    wide = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    # rows of the index are tiny and what they name is not: the tasks are counted by the bytes to be read
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = min(max(wide, -(-size // range_bytes)), MOST_TASKS)
    located = archives.select("path").repartition(wide).mapInArrow(
        _locate(folder, range_bytes), "path string, range long, offset long, length long"
    )
    spread = located.repartition(tasks, "path", "range").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(
        _fetch(folder, with_payload),
        "record_id string, record_type string, uri string, digest string, payload_bytes long, refers_to string, "
        "actual_digest string, actual_bytes long, payload binary",
    )


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Pages written to archives and read back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``.  Length and digest are those of the
    bytes read: a revisit takes them from the response it refers to.  A response
    whose bytes do not match its header is an error.  A page with an empty text as
    its id comes back with none.

    The archives are read once: what the headers and digests say is a short row a
    record, written to the shared folder before responses and revisits part.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "archives")
    read = read_archives(write_archives(pages, folder, page_id, url, html), folder, with_payload=False)
    records = materialize(
        read.select("record_id", "record_type", "refers_to", "digest", "actual_digest", "actual_bytes"), "records"
    )
    kind = pages.schema[page_id].dataType

    def key(c: str):
        return F.url_decode(F.expr(f"nullif(substring({c}, 10), '')")).cast(kind)

    sound = F.when(F.col("digest") == F.col("actual_digest"), F.col("actual_digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record "), "record_id"))
    )
    responses = records.filter("record_type = 'response'").select(
        key("record_id").alias(page_id), F.col("actual_bytes").alias("payload_bytes"), sound.alias("payload_digest"),
        "record_type", F.lit(None).cast(kind).alias("refers_to"),
    )
    revisits = records.filter("record_type = 'revisit'").select(key("record_id").alias(page_id), key("refers_to").alias("refers_to"))
    originals = responses.select(F.col(page_id).alias("_original"), "payload_bytes", "payload_digest").dropDuplicates(["_original"])
    resolved = revisits.join(originals, revisits["refers_to"] == originals["_original"]).select(
        page_id, "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"
    )
    return responses.unionByName(resolved)
