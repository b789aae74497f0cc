"""Line-oriented inputs and logs (SRC4, 6-8, SNK6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.functions.expr import strip
from hiretide.operators.skew import best_per_key

EVENT_SOURCE_CONFIG = (
    "firm_name string, firm_kind string, event_page_url string, source_provider string, source_scope string, "
    "firm_aliases array<string>"
)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: one URL per line; blank and comment lines are skipped."""
    url = strip(F.col("value"))
    lines = spark.read.text(path).select(url.alias("source_url"), F.monotonically_increasing_id().alias("pos"))
    return lines.filter((F.col("source_url") != "") & ~F.col("source_url").startswith("#"))


def read_event_sources(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC6: event-source configuration, a JSON array (or lines) of objects."""
    raw = spark.read.schema(EVENT_SOURCE_CONFIG).option("multiLine", multi_line).json(path)
    # array elements of one file arrive in file order
    return raw.withColumn("pos", F.monotonically_increasing_id()).fillna(
        {"firm_kind": "other", "source_provider": "company_events", "source_scope": "company_page"}
    )


def dedupe_sources(sources: DataFrame, order: list[str], column: str = "event_page_url") -> DataFrame:
    """SRC6: first configuration per page URL."""
    clean = sources.withColumn(column, strip(F.col(column))).filter(F.col(column) != "")
    return best_per_key(clean, [column], [F.col(c) for c in order])


def read_company_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: names of the 'N. name' lines; headings are skipped."""
    line = strip(F.col("value"))
    heading = F.col("line").rlike(r"(?i)^\s*(?:top\s+\d+|compiled|includes)\b")
    name = F.regexp_extract("line", r"^\s*\d+\.\s*(.+?)\s*$", 1)
    lines = spark.read.text(path).select(line.alias("line"), F.monotonically_increasing_id().alias("pos"))
    return lines.filter(~heading).select("pos", name.alias("company_name")).filter("company_name <> ''")


def write_dead_letters(letters: DataFrame, path: str) -> None:
    """SRC8: append {recorded_at, failure} lines."""
    letters.select("recorded_at", "failure").write.mode("append").json(path)


def recent_dead_letters(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """SRC8: the newest ``n`` letters."""
    schema = "recorded_at timestamp, failure struct<source_url:string,ats_provider:string,board_token:string," \
             "error_type:string,message:string>"
    letters = spark.read.schema(schema).json(path)
    return letters.orderBy(F.col("recorded_at").desc(), F.col("failure.source_url")).limit(n)


def write_discovery(hits: DataFrame, unmatched: DataFrame, path: str) -> None:
    """SNK6: hits, their source URLs and the unmatched companies, by name."""
    ordered = hits.orderBy(F.lower("company_name"), "company_name")
    ordered.write.json(f"{path}/hits")
    ordered.select("source_url").write.text(f"{path}/sources")
    unmatched.orderBy("company_name").select("company_name").write.text(f"{path}/unmatched")
