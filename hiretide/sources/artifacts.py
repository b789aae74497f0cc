"""Run artifacts: nested documents in, sectioned tables out (SRC1-3, SNK1, 2, 5).

The nested form is one JSON document per run.  Reading explodes it; writing keeps
the same sections as separate directories, because one document per run would put
a whole run into one row of one task.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.operators.runs import source_order
from hiretide.sources.split_json import read_elements

LISTING = (
    "company_name string, job_title string, job_url string, ats_provider string, ats_job_id string, "
    "location array<string>, raw_description string, description_html string, employment_type string, "
    "departments array<string>, date_posted timestamp, content_hash string, extracted_at timestamp"
)
SOURCE = (
    "source_url string, ats_provider string, board_token string, status string, job_count bigint, "
    "error_type string, message string"
)
FAILURE = "source_url string, ats_provider string, board_token string, error_type string, message string"
EVENT = (
    "firm_name string, firm_kind string, event_title string, event_url string, registration_url string, "
    "source_provider string, source_event_id string, event_type string, audience_tags array<string>, "
    "location array<string>, location_type string, starts_at timestamp, ends_at timestamp, timezone string, "
    "description string, raw_payload string, content_hash string, extracted_at timestamp"
)
EVENT_SOURCE = (
    "source_url string, firm_name string, firm_kind string, source_provider string, source_scope string, "
    "status string, event_count bigint, error_type string, message string"
)
EVENT_FAILURE = (
    "source_url string, firm_name string, firm_kind string, source_provider string, error_type string, message string"
)
NORMALIZATION = (
    "program_type string, academic_levels array<string>, degree_requirements array<string>, "
    "required_grad_years array<int>, visa_sponsorship boolean, visa_status string, required_skills array<string>, "
    "nice_to_have_skills array<string>, min_gpa double, clearance_required boolean, remote_type string, "
    "normalization_status string, confidence double, review_reasons array<string>"
)


# Files whose places are sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_FILES = 100_000


def _ddl(fields: str) -> str:
    """DDL fields as struct body: 'a int, b string' -> 'a:int,b:string'."""
    named = (part.split(" ", 1) for part in fields.split(", "))
    return ",".join(f"{name}:{kind}" for name, kind in named)


RECORD = (
    f"job struct<{_ddl(LISTING)}>, cleaned_description string, normalization struct<{_ddl(NORMALIZATION)}>, "
    "normalization_method string, normalized_at timestamp"
)
COUNTERS = (
    "generated_at timestamp, source_count bigint, successful_source_count bigint, failed_source_count bigint, "
)
PULL = (
    COUNTERS + f"job_count bigint, sources array<struct<{_ddl(SOURCE)}>>, jobs array<struct<{_ddl(LISTING)}>>, "
    f"failures array<struct<{_ddl(FAILURE)}>>"
)
EVENT_PULL = (
    COUNTERS + f"event_count bigint, sources array<struct<{_ddl(EVENT_SOURCE)}>>, events array<struct<{_ddl(EVENT)}>>, "
    f"failures array<struct<{_ddl(EVENT_FAILURE)}>>"
)
NORMALIZED = (
    "generated_at timestamp, source_job_count bigint, normalized_job_count bigint, duplicate_job_count bigint, "
    f"status_counts map<string,bigint>, records array<struct<{_ddl(RECORD)}>>"
)


def _qualified(spark: SparkSession, path: str) -> dict[str, str]:
    """What a path or pattern names: paths without scheme and host, and whole URIs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    named = jvm.org.apache.hadoop.fs.Path(path)
    found = named.getFileSystem(conf).globStatus(named) or []
    return {status.getPath().toUri().getPath(): status.getPath().toString() for status in found}


def roots(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files and folders to scan, each once: a file goes when its folder is there.
    A path that names nothing stays, for the reader to complain of."""
    named = [(path, _qualified(spark, path)) for path in dict.fromkeys(paths)]
    every = {name: uri for _, found in named for name, uri in found.items()}
    return [path for path, found in named if not found] + [
        uri for name, uri in every.items() if name.rpartition("/")[0] not in every
    ]


def _places(spark: SparkSession, paths: list[str], files: dict[str, str]) -> DataFrame:
    """(_file, run_ord): the places in ``paths`` of files, by whole path without scheme
    and host -> what to call them."""
    places: dict[str, list[int]] = {}
    for i, path in enumerate(paths):
        for whole in _qualified(spark, path):
            places.setdefault(whole, []).append(i)
    rows = []
    for name, called in files.items():
        parts = name.split("/")
        for end in range(1, len(parts) + 1):
            rows += [(called, i) for i in places.get("/".join(parts[:end]) or "/", ())]
    found = spark.createDataFrame(rows, "_file string, run_ord int")
    # without this the documents would be shuffled to meet a row per file
    return F.broadcast(found) if len(rows) <= BROADCAST_FILES else found


def with_run_order(found: DataFrame, paths: list[str]) -> DataFrame:
    """Adds ``run_ord``, the place in ``paths`` of the file or folder that a row of a
    file scan was read from; a row of a path named twice counts twice.

    The files of the scan are known without reading them; each is looked up among the
    whole paths by its own and its folders' names, and joined by its exact name, so
    neither the plan nor the work of a row grows with the number of paths.
    """
    spark = found.sparkSession
    names = {name: name for name in (unquote(urlsplit(file).path) for file in found.inputFiles())}
    ordered = _places(spark, paths, names)
    # '+' stands for itself in a path
    read = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(read, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return found.withColumn("_name", name).join(ordered, F.col("_name") == F.col("_file")).drop("_name", "_file")


def _documents(spark: SparkSession, schema: str, paths: list[str], multi_line: bool) -> DataFrame:
    """Documents of all paths, with ``run_ord``; one scan."""
    found = spark.read.schema(schema).option("multiLine", multi_line).json(roots(spark, paths))
    return with_run_order(found, paths)


def _split_sections(spark: SparkSession, schemas: dict[str, str], paths: list[str], range_bytes: int) -> list[DataFrame]:
    """Sections of all documents, each read in byte ranges; ``pos`` is the byte of its
    document that a row starts at.  A folder stands for all files below it."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots(spark, paths)).select("path", "length").collect()
    files, sizes = {}, []
    for path, length in sorted(listed):
        scheme, host, name = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?(/.*)", path).groups()
        files[name] = f"{scheme or 'file:'}{host or '//'}{quote(name)}"
        sizes.append((files[name], length))
    found = read_elements(spark, sizes, list(schemas), range_bytes)
    placed = found.join(_places(spark, paths, files), F.col("path") == F.col("_file"))
    return [
        placed.filter(F.col("section") == name).select(
            "run_ord", F.col("at").alias("pos"), F.from_json("text", f"struct<{_ddl(fields)}>").alias("_row")
        ).select("run_ord", "pos", "_row.*")
        for name, fields in schemas.items()
    ]


def _section(documents: DataFrame, name: str) -> DataFrame:
    return documents.select("run_ord", F.posexplode(name).alias("pos", "_row")).select("run_ord", "pos", "_row.*")


def read_pull(spark: SparkSession, paths: list[str], multi_line: bool = True,
              range_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC1: (sources, jobs, failures) of run artifacts, in input order.

    With ``multi_line`` every file is one document; otherwise every line is.  With
    ``range_bytes`` every file is one document that is read in ranges of that size, by
    many tasks; ``pos`` then is a byte offset, in the same order.
    """
    if range_bytes:
        return tuple(_split_sections(spark, {"sources": SOURCE, "jobs": LISTING, "failures": FAILURE}, paths, range_bytes))
    docs = _documents(spark, PULL, paths, multi_line)
    return _section(docs, "sources"), _section(docs, "jobs"), _section(docs, "failures")


def pull_documents(jobs: DataFrame, run: str, listings_per_document: int) -> DataFrame:
    """Nested run documents of a bounded number of listings each."""
    listing = F.struct(*[part.split(" ")[0] for part in LISTING.split(", ")])
    block = F.floor(F.col("pos") / listings_per_document)
    grouped = jobs.groupBy(run, block.alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", listing.alias("job")))).alias("_jobs")
    )
    return grouped.select(
        run,
        F.size("_jobs").cast("bigint").alias("job_count"),
        F.transform("_jobs", lambda j: j.job).alias("jobs"),
    )


def read_normalized(spark: SparkSession, paths: list[str], nested: bool = False, range_bytes: int | None = None) -> DataFrame:
    """SRC2: normalized records, from written artifacts or from nested documents
    (``range_bytes`` as in :func:`read_pull`)."""
    if range_bytes:
        return _split_sections(spark, {"records": RECORD}, paths, range_bytes)[0]
    if nested:
        docs = _documents(spark, NORMALIZED, paths, True)
        return docs.select("run_ord", F.posexplode("records").alias("pos", "_row")).select("run_ord", "pos", "_row.*")
    return _documents(spark, RECORD, [f"{path.rstrip('/')}/records" for path in paths], False)


def read_event_pull(spark: SparkSession, paths: list[str], multi_line: bool = True,
                    range_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC3: (sources, events, failures) of event artifacts; options as in :func:`read_pull`."""
    if range_bytes:
        schemas = {"sources": EVENT_SOURCE, "events": EVENT, "failures": EVENT_FAILURE}
        return tuple(_split_sections(spark, schemas, paths, range_bytes))
    docs = _documents(spark, EVENT_PULL, paths, multi_line)
    return _section(docs, "sources"), _section(docs, "events"), _section(docs, "failures")


def _write_sections(rows: DataFrame, name: str, sources: DataFrame, failures: DataFrame, path: str,
                    generated_at: Column) -> None:
    success = F.coalesce(~F.col("status").isin("failed"), F.lit(False))
    total = rows.agg(F.count(F.lit(1))).scalar()
    counters = sources.agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(success).alias("successful_source_count"),
        F.count_if(~success).alias("failed_source_count"),
    ).withColumns({f"{name[:-1]}_count": total, "generated_at": generated_at})
    counters.write.json(f"{path}/summary")
    sources.orderBy(*source_order()[:2]).write.json(f"{path}/sources")
    rows.write.json(f"{path}/{name}")
    failures.write.json(f"{path}/failures")


def write_pull(jobs: DataFrame, sources: DataFrame, failures: DataFrame, path: str, generated_at: Column) -> None:
    """SNK1: summary, sources by lower-cased URL, jobs and failures."""
    _write_sections(jobs, "jobs", sources, failures, path, generated_at)


def write_event_pull(events: DataFrame, sources: DataFrame, failures: DataFrame, path: str, generated_at: Column) -> None:
    """SNK5."""
    _write_sections(events, "events", sources, failures, path, generated_at)


def write_normalized(records: DataFrame, jobs: DataFrame, path: str, generated_at: Column) -> None:
    """SNK2: summary (counts of the source listings, of the records and of what fell
    out as a duplicate, and records per status) and one record per line.  The records
    are made once: their statuses are counted in what was written."""
    status = F.col("normalization.normalization_status")
    records.write.json(f"{path}/records")
    written = records.sparkSession.read.schema("normalization struct<normalization_status: string>").json(f"{path}/records")
    counted = written.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    summary = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("normalized_job_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"),
    ).withColumns({"generated_at": generated_at, "source_job_count": jobs.agg(F.count(F.lit(1))).scalar()})
    summary.withColumn("duplicate_job_count", F.col("source_job_count") - F.col("normalized_job_count")).write.json(f"{path}/summary")
