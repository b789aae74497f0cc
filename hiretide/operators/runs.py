"""Consolidation of extraction runs.

Rows carry ``run_ord`` (position of the run in the argument list) and ``pos``
(position inside the run); "first" and "last" always mean that order.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.operators.skew import best_per_key, join_null_safe

JOB_KEY = ["_hash", "_provider", "_number", "_url"]
INPUT_ORDER = ["run_ord", "pos"]


def with_job_key(jobs: DataFrame) -> DataFrame:
    """Listing identity: the content hash, else provider, number and URL."""
    known = F.coalesce(F.col("content_hash"), F.lit("")) != ""
    return jobs.withColumns(
        {
            "_hash": F.when(known, F.col("content_hash")),
            "_provider": F.when(~known, F.col("ats_provider")),
            "_number": F.when(~known, F.col("ats_job_id")),
            "_url": F.when(~known, F.col("job_url")),
        }
    )


def _in_order() -> list[Column]:
    return [F.col(c) for c in INPUT_ORDER]


def combine_jobs(jobs: DataFrame) -> DataFrame:
    """First row per listing over all runs."""
    return best_per_key(with_job_key(jobs), JOB_KEY, _in_order()).drop(*JOB_KEY)


def combine_sources(sources: DataFrame) -> DataFrame:
    """Per source the first success, or the last result without one."""
    success = F.col("status") == "success"
    order = [
        F.coalesce(success, F.lit(False)).desc(),
        *[F.when(success, c).asc_nulls_last() for c in _in_order()],
        *[c.desc() for c in _in_order()],
    ]
    keyed = sources.withColumn("source_url", F.coalesce("source_url", F.lit("")))
    return best_per_key(keyed, ["ats_provider", "board_token", "source_url"], order)


def source_order() -> list[Column]:
    return [F.lower("source_url"), F.col("source_url"), F.col("ats_provider"), F.col("board_token")]


def combine_failures(failures: DataFrame, combined: DataFrame) -> DataFrame:
    """Last failure per URL, unless the URL succeeded in the combined sources."""
    keyed = failures.withColumn("source_url", F.coalesce("source_url", F.lit("")))
    last = best_per_key(keyed, ["source_url"], [c.desc() for c in _in_order()])
    recovered = combined.filter("status = 'success'").select("source_url").distinct()
    return last.join(recovered, "source_url", "left_anti")


def run_counters(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """C4: source and job counters of a (combined) run."""
    success = F.coalesce(F.col("status") == "success", F.lit(False))
    total = jobs.agg(F.count(F.lit(1))).scalar()
    return sources.agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(success).alias("successful_source_count"),
        F.count_if(~success).alias("failed_source_count"),
    ).withColumn("job_count", total)


def _replaced(tokens: Iterable[str]) -> Column:
    wanted = [t.lower() for t in tokens]
    return F.lower(F.coalesce(F.col("board_token"), F.lit(""))).isin(*wanted)


def merge_sources(primary: DataFrame, fallback: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """M1: primary sources outside the replaced tokens, then the last successful
    fallback source of every replaced token, by token."""
    tokens = list(tokens)
    kept = primary.filter(~_replaced(tokens)).withColumn("_token", F.lit(""))
    usable = fallback.filter(_replaced(tokens) & (F.col("status") == "success"))
    usable = usable.withColumn("_token", F.lower("board_token"))
    last = best_per_key(usable, ["_token"], [c.desc() for c in _in_order()])
    return kept.unionByName(last).drop("_token")


def merge_failures(primary: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """M2."""
    return primary.filter(~_replaced(tokens))


GRAM = 3  # characters of a token that candidates are looked up by


def _token_tables(like: DataFrame, tokens, companies) -> tuple[DataFrame, DataFrame]:
    """Tokens as (token) and companies as (token, company, at), whatever they came as."""
    spark = like.sparkSession
    if not isinstance(tokens, DataFrame):
        tokens = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    if not isinstance(companies, DataFrame):
        rows = [(t, name.casefold(), at) for at, (t, name) in enumerate(companies.items())]
        companies = spark.createDataFrame(rows, "token string, company_name string, at int")
    named = companies.select("token", F.lower("company_name").alias("_company"), "at")
    broad = tokens.select(F.lower("token").alias("token")).filter("token <> ''").distinct()
    return broad.join(named.select("token"), "token", "left_anti"), named


def _grams(value: str, size) -> Column:
    """Distinct pieces of ``size`` characters, of a text at least as long."""
    starts = F.sequence(F.lit(1), F.length(value) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(value), i, size)))


def tokens_within(texts: DataFrame, tokens: DataFrame, column: str) -> DataFrame:
    """(column, token): every distinct text with the smallest token that is a part of it.

    A q-gram index join: a token is looked up by the one of its grams that the fewest
    texts hold (a token shorter than a gram by itself), and what is found is verified.
    The plan has the same size for any number of tokens."""
    texts = texts.select(column).filter(F.col(column) != "").distinct()
    size = F.least(F.lit(GRAM), F.length("token"))
    keys = tokens.select("token", F.explode(_grams("token", size)).alias("gram"))
    pieces = texts.select(
        column, F.explode(F.array_distinct(F.flatten(F.array(*[
            F.when(F.length(column) >= n, _grams(column, F.lit(n))).otherwise(F.array().cast("array<string>"))
            for n in range(1, GRAM + 1)
        ])))).alias("gram"),
    )
    held = pieces.join(keys.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # a gram that no text holds rules its token out
    counted = keys.join(held, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    probes = best_per_key(counted, ["token"], [F.col("texts"), F.col("gram")]).filter("texts > 0").select("token", "gram")
    found = pieces.join(probes, "gram").filter(F.contains(F.col(column), F.col("token")))
    return found.groupBy(column).agg(F.min("token").alias("token"))


def with_replacement_token(jobs: DataFrame, tokens: Iterable[str] | DataFrame, company_by_token: Mapping[str, str] | DataFrame,
                           name: str = "added_token") -> DataFrame:
    """The jobs that stand in for a token, with it: that of the exact company first, in
    mapping order, then the smallest unmapped token found in the identifying text.

    ``tokens`` may be a table (token), ``company_by_token`` one (token, company_name, at)
    with ``at`` the order.  A blank token is none."""
    broad, named = _token_tables(jobs, tokens, company_by_token)
    company = F.lower(F.coalesce(F.col("company_name"), F.lit("")))
    parts = ("company_name", "job_url", "ats_provider", "ats_job_id")
    hay = F.lower(F.array_join(F.array(*[F.coalesce(F.col(p), F.lit("")) for p in parts]), " "))
    read = jobs.withColumns({"_company": company, "_hay": hay})
    exact = best_per_key(named, ["_company"], [F.col("at")]).select("_company", F.col("token").alias("_exact"))
    within = tokens_within(read, broad, "_hay").withColumnRenamed("token", "_within")
    return (
        read.join(exact, "_company", "left").join(within, "_hay", "left")
        .withColumn(name, F.coalesce("_exact", "_within")).filter(F.col(name).isNotNull())
        .select(*jobs.columns, name)
    )


def merge_jobs(primary: DataFrame, fallback: DataFrame, tokens: Iterable[str] | DataFrame,
               company_by_token: Mapping[str, str] | DataFrame) -> DataFrame:
    """M3: every primary row, plus unseen fallback listings of replaced tokens.

    ``added_token`` is NULL for primary rows.
    """
    matched = with_job_key(with_replacement_token(fallback, tokens, company_by_token))
    first = best_per_key(matched, JOB_KEY, _in_order())
    seen = with_job_key(primary).select(*JOB_KEY).distinct()
    unseen = join_null_safe(first, seen, JOB_KEY, "left_anti").drop(*JOB_KEY)
    return primary.withColumn("added_token", F.lit(None).cast("string")).unionByName(unseen)


def added_by_token(merged: DataFrame) -> DataFrame:
    """M3 counter."""
    added = merged.filter(F.col("added_token").isNotNull())
    return added.groupBy("added_token").agg(F.count(F.lit(1)).alias("jobs"))


def extraction_summary(sources: DataFrame, jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Per requested source its status and listing count, zero included."""
    counts = jobs.groupBy("source_url").agg(F.count(F.lit(1)).alias("job_count"))
    errors = best_per_key(failures, ["source_url"], [F.col("error_type")])
    errors = errors.select("source_url", "error_type", F.lit(True).alias("_failed"))
    joined = sources.join(counts, "source_url", "left").join(errors, "source_url", "left")
    return joined.select(
        *sources.columns,
        F.when(F.col("_failed"), "failed").otherwise("success").alias("status"),
        F.when(F.col("_failed"), 0).otherwise(F.coalesce("job_count", F.lit(0))).alias("job_count"),
        "error_type",
    ).orderBy(F.lower("source_url"), "source_url")
