"""URL routing, queue choice and source discovery (RT1-RT7, SRC5)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions.expr import bound, mapped, strings, strip
from hiretide.functions.terms import Table, first_label_scan
from hiretide.operators.skew import best_per_key


def host(url: Column) -> Column:
    """Lower-cased host name, '' when there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")
    return F.lower(bare)


def path_parts(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def query_values(url: Column, key: str) -> Column:
    """All non-blank values of a query parameter, decoded, in order."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.startswith(key + "=") & (F.length(p) > len(key) + 1))
    return F.transform(pairs, lambda p: F.try_url_decode(p.substr(F.lit(len(key) + 2), F.length(p))))


def part_after(parts: Column, marker: str) -> Column:
    """RT2: the segment after a marker, when it looks like a token."""
    at = F.array_position(parts, marker)
    following = F.when(at > 0, F.get(parts, at.cast("int")))
    return F.when(following.rlike(r"\A[A-Za-z0-9._-]+\z"), following)


def _board_token(h: Column, parts: Column, api_host: str, marker: str, domain: str,
                 reserved: tuple[str, ...], query: Column | None = None) -> Column:
    sub = F.when(h.endswith(domain), F.substring_index(h, domain, 1)).otherwise(h)
    usable = F.when(~sub.isin("", *reserved), sub)
    candidates = [F.when(h == api_host, part_after(parts, marker)), F.get(parts, F.lit(0))]
    return F.coalesce(*candidates, *([query] if query is not None else []), usable)


def route(url: Column, h: Column, parts: Column) -> tuple[Column, Column]:
    """RT1: provider and board token of a career URL; the first rule decides.

    ``h`` and ``parts`` are the URL's :func:`host` and :func:`path_parts`, computed
    beforehand.  A NULL provider means no rule matched; a NULL token with a
    provider means the token could not be found.
    """

    def has(segment: str) -> Column:
        return F.array_contains(parts, segment)

    first = F.get(parts, F.lit(0))
    label = F.substring_index(h, ".", 1)
    lever_query = F.coalesce(*[F.get(query_values(url, k), F.lit(0)) for k in ("company", "team", "token")])
    upper = lambda key: F.transform(query_values(url, key), F.upper)
    nasa = (
        (h == "nasa.usajobs.gov")
        | F.array_contains(upper("d"), "NN")
        | F.array_contains(upper("a"), "NN00")
    )
    eightfold = {
        "explore.jobs.netflix.net": ("netflix", has("careers")),
        "careers.qualcomm.com": ("qualcomm", has("careers") & has("search")),
        "apply.careers.microsoft.com": ("microsoft", has("careers")),
        "searchcareers.caci.com": ("caci", F.lit(True)),
    }
    eightfold_rule, eightfold_token = F.lit(False), F.lit(None).cast("string")
    for name, (token, condition) in eightfold.items():
        eightfold_rule = eightfold_rule | ((h == name) & condition)
        eightfold_token = F.when(h == name, token).otherwise(eightfold_token)

    # (provider, condition, token), in order of precedence
    table = [
        ("greenhouse", h.endswith(".greenhouse.io"),
         _board_token(h, parts, "boards-api.greenhouse.io", "boards", ".greenhouse.io",
                      ("boards", "boards-api", "job-boards"))),
        ("lever", h.endswith(".lever.co"),
         _board_token(h, parts, "api.lever.co", "postings", ".lever.co", ("jobs", "api"), lever_query)),
        ("ashby", h.endswith(".ashbyhq.com"),
         _board_token(h, parts, "api.ashbyhq.com", "job-board", ".ashbyhq.com", ("jobs", "api"))),
        ("workday", h.endswith(".myworkdayjobs.com"), F.nullif(label, F.lit(""))),
        ("amazon", h.isin("www.amazon.jobs", "amazon.jobs"), F.lit("amazon")),
        ("google", h.isin("www.google.com", "careers.google.com") & has("careers"), F.lit("google")),
        ("meta", (h == "www.metacareers.com") & (has("jobsearch") | has("jobs")), F.lit("meta")),
        ("apple", (h == "jobs.apple.com") & has("search"), F.lit("apple")),
        ("walmart", (h == "careers.walmart.com") & has("results"), F.lit("walmart")),
        ("mcloud", (h == "careers.homedepot.com") & has("job-search-results"), F.lit("homedepot")),
        ("verizon", (h == "mycareer.verizon.com") & has("jobs"), F.lit("verizon")),
        ("eightfold", eightfold_rule, eightfold_token),
        ("smartrecruiters",
         h.isin("jobs.smartrecruiters.com", "api.smartrecruiters.com") & first.isNotNull(),
         F.coalesce(F.when(h == "api.smartrecruiters.com", part_after(parts, "companies")), first)),
        ("successfactors", (h == "jobs.sap.com") & has("search"), F.lit("sap")),
        ("talentbrew",
         h.isin("careers.arm.com", "careers.blackrock.com", "careers.unitedhealthgroup.com",
                "jobs.citi.com", "jobs.intuit.com") & has("search-jobs"), label),
        ("avature", (h == "careers.twosigma.com") & has("careers"), label),
        ("usajobs",
         h.isin("www.usajobs.gov", "nasa.usajobs.gov") & has("Search") & has("Results"),
         F.when(nasa, "nasa")),
        ("oracle", first.isNotNull() & (h.contains("careers") | h.endswith(".oraclecloud.com")),
         F.coalesce(part_after(parts, "sites"), label)),
    ]
    provider, token = F, F
    for name, condition, value in table:
        provider = provider.when(condition, F.lit(name))
        token = token.when(condition, value)
    return provider, token


def route_urls(urls: DataFrame, column: str = "source_url") -> DataFrame:
    """RT1 over a table: ats_provider, board_token, error_type."""
    url = F.col(column)
    split = urls.withColumn("_host", host(url)).withColumn("_parts", path_parts(url))
    provider, token = route(url, F.col("_host"), F.col("_parts"))
    routed = split.withColumns({"_provider": provider, "_token": token})
    ok = F.col("_provider").isNotNull() & F.col("_token").isNotNull()
    return routed.withColumns(
        {
            "ats_provider": F.when(ok, F.col("_provider")),
            "board_token": F.when(ok, F.col("_token")),
            "error_type": F.when(~ok, "UnsupportedAtsError"),
        }
    ).drop("_host", "_parts", "_provider", "_token")


QUEUE_MARKERS = {"high": rules.HIGH_PRIORITY_MARKERS, "slow": rules.SLOW_MARKERS}


def choose_queue(url: Column, table: Table = QUEUE_MARKERS, default: str = "standard") -> Column:
    """RT3: the first queue, in table order, with a marker in the URL; all markers are
    looked for in one scan."""
    return bound(F.lower(url), lambda u: first_label_scan(u, table, default))


def urls_for_queue(
    urls: DataFrame, queue: str | None, column: str = "source_url", table: Table = QUEUE_MARKERS, default: str = "standard",
) -> DataFrame:
    """RT4."""
    return urls if queue is None else urls.filter(choose_queue(F.col(column), table, default) == queue)


def enqueue_plan(
    urls: DataFrame, forced: str | None = None, column: str = "source_url", table: Table = QUEUE_MARKERS,
    default: str = "standard", reasons: Mapping[str, str] = rules.QUEUE_REASONS,
) -> DataFrame:
    """RT5: queue and reason of every URL, without enqueuing."""
    queue = F.lit(forced) if forced else choose_queue(F.col(column), table, default)
    reason = F.lit("forced queue") if forced else mapped(F.col("queue"), reasons)
    return urls.select(F.col(column), queue.alias("queue")).withColumn("reason", reason)


def dedupe_urls(urls: DataFrame, order: list[str], column: str = "source_url") -> DataFrame:
    """SRC5: stripped URLs without blanks, comments and repeats; first wins."""
    clean = F.regexp_replace(strip(F.col(column)), "^\\uFEFF+", "")
    kept = urls.withColumn(column, clean).filter((F.col(column) != "") & ~F.col(column).startswith("#"))
    return best_per_key(kept, [column], [F.col(c) for c in order])


def candidate_tokens(
    company: Column, suffixes: Iterable[str] = rules.COMPANY_SUFFIXES,
    known_aliases: Mapping[str, Iterable[str]] = rules.KNOWN_TOKEN_ALIASES,
) -> Column:
    """RT6: board-token guesses for a company name, best first."""
    plain = F.replace(F.regexp_replace(company, r"\([^)]*\)", ""), F.lit("&"), F.lit(" and "))
    words = F.filter(
        F.split(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "), " "),
        lambda w: (w != "") & (w != "the"),
    )
    core = F.filter(words, lambda w: ~w.isin(*suffixes))
    first_two = F.when(F.size(words) >= 2, F.slice(words, 1, 2))
    guesses = [F.array_join(w, s) for w in (words, core) for s in ("", "-")]
    guesses += [F.get(words, F.lit(0)), F.array_join(first_two, ""), F.array_join(first_two, "-")]
    known = F.lit(None).cast("array<string>")
    for name, aliases in known_aliases.items():
        known = F.when(company == name, strings(aliases)).otherwise(known)
    tokens = F.concat(F.coalesce(known, F.array().cast("array<string>")), F.array_compact(F.array(*guesses)))
    tidy = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "^-+|-+$", "")))
    return F.array_distinct(F.filter(tidy, lambda t: t != ""))


# Companies that guess one token, per part of the join.
COMPANIES_PER_PART = 100_000


def _salted(guesses: DataFrame, known: DataFrame, per_part: int) -> DataFrame:
    """Guesses joined with known boards by token.  Tokens that more companies guess
    than ``per_part`` (counted) are cut into parts by company, and their few boards
    repeated for each part.  The broadcast list has at most a row per ``per_part`` guesses."""
    hot = guesses.groupBy("board_token").count().filter(F.col("count") > per_part)
    hot = F.broadcast(hot.select(F.col("board_token").alias("_hot"), F.ceil(F.col("count") / per_part).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1)).cast("bigint")

    def dealt(side: DataFrame, salt: Column) -> DataFrame:
        marked = side.join(hot, F.col("board_token") == F.col("_hot"), "left").withColumn("_parts", parts)
        return marked.withColumn("_salt", salt).drop("_hot", "_parts")

    left = dealt(guesses, F.pmod(F.xxhash64("company_name"), F.col("_parts")))
    right = dealt(known, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    return left.join(right, ["board_token", "_salt"]).drop("_salt")


def discover(companies: DataFrame, boards: DataFrame, per_part: int = COMPANIES_PER_PART) -> tuple[DataFrame, DataFrame]:
    """RT7: (hits, unmatched) of companies against a landed board directory.

    ``boards``: provider, board_token, job_count.  Tokens are tried in order, and
    for each token the providers in order.
    """
    guesses = companies.select("company_name").distinct().select(
        "company_name", F.posexplode(candidate_tokens(F.col("company_name"))).alias("_at", "board_token")
    )
    preference = F.array_position(strings(rules.DISCOVERY_PROVIDER_ORDER), F.col("ats_provider"))
    known = boards.filter(F.col("ats_provider").isin(*rules.DISCOVERY_PROVIDER_ORDER))
    found = _salted(guesses, known, per_part).withColumn("_provider_at", preference)
    hits = best_per_key(found, ["company_name"], [F.col("_at"), F.col("_provider_at")]).select(
        "company_name", "ats_provider", "board_token",
        F.concat(mapped(F.col("ats_provider"), rules.DISCOVERY_URL_PREFIX), F.col("board_token")).alias("source_url"),
        "job_count",
    )
    unmatched = companies.select("company_name").distinct().join(hits, "company_name", "left_anti")
    return hits, unmatched
