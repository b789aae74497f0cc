"""Registered queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.llm import (
    contamination, fill_middle, fingerprint, language, lexical, mixing, ngram_join, pii, quality, secret_scan, sharding,
    toxicity, warc_zip,
)
from hiretide.llm.common import fold
from hiretide.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data, plain and disguised."""
    return pii.personal_data(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets."""
    return secret_scan.secrets(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language; learned from the documents whose fold is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold("doc_id", 3) != 1))
    rows = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    return language.predict(rows, model, ["doc_id", "held_out"])


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to ZIP-packaged archives and read back by ranges."""
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words("text").alias("size"))
    rows = materialize(rows, "sizes")  # words are counted once
    taken = mixing.systematic_copies(rows, "size")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document under the law of equal counts."""
    size, crc = sharding.sizes("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    placed = sharding.sharded(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is labelled toxic; learned from the labels whose
    fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("_of", 5) != 0)
    scored = toxicity.scores(docs.select("doc_id", "text"), machine)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of each document."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and the verdict of the rule table, of each document."""
    good = F.size("base_broken") == 0
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "metrics.n_words", "metrics.word_chars", "metrics.n_symbols", "metrics.n_dup_lines",
        "metrics.n_repeat_words", (~good).alias("base_failed"), (good & (F.size("broken") == 0)).alias("kept"),
        F.array_join("broken", ",").alias("broken"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's fill-in-the-middle output and of its restored text."""
    return fill_middle.round_trip(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that rank highest for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_pii, op2_secrets, op3_language, op4_warc_zip, op5_decontamination, op6_mixing, op7_sharding, op8_toxicity,
        op9_ngram_join, op10_fingerprints, op11_quality, op12_fill_middle,
        op13_lexical_search,
    )
}

ORACLE_SQL = {
    "op6_mixing": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
        ),
        sources AS (
            SELECT source, sum(size)::DOUBLE AS source_size,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
            FROM docs GROUP BY source
        ),
        -- targets of all sources; the excess over three sizes is handed on by weight until none is above
        rounds AS (
            SELECT 0 AS n, source, source_size, weight, false AS full_up,
                   sum(source_size) OVER () * weight / sum(weight) OVER () AS target
            FROM sources
            UNION ALL
            SELECT n + 1, source, source_size, weight, full_now,
                   CASE WHEN full_now THEN 3 * source_size
                        ELSE target + sum(greatest(target - 3 * source_size, 0)) OVER () * weight
                             / sum(CASE WHEN full_now THEN 0 ELSE weight END) OVER () END
            FROM (SELECT *, target >= 3 * source_size AS full_now,
                         max(target - 3 * source_size) OVER () > 1e-9 AS again FROM rounds)
            WHERE again
        ),
        targets AS (SELECT source, source_size, target FROM rounds WHERE n = (SELECT max(n) FROM rounds)),
        placed AS (
            SELECT d.doc_id, d.size, t.source_size, t.target,
                   row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) - 1 AS p,
                   CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3) ELSE 0 END AS rate,
                   ('0x' || substr(md5(concat_ws('|', 'mix-1', d.source)), 1, 10))::BIGINT / 1099511627776 AS shift
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
               ((floor((p + 1) * rate + shift) - floor(p * rate + shift)) * size)::BIGINT AS taken
        FROM placed
    """,
    "op11_quality": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        parts AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM docs
        ),
        windows AS (
            SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
            FROM parts, unnest(range(1, len(words) - 1)) u(i)
        ),
        repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
        covered AS (SELECT r, count(DISTINCT p) AS n FROM repeated, unnest([i, i + 1, i + 2]) u(p) GROUP BY r),
        counts AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                   len(regexp_extract_all(text, '!')) AS bangs, len(regexp_extract_all(text, '\p{Lu}')) AS capitals,
                   len(list_filter(words, lambda x: list_contains(string_split('STOP_WORDS', ' '), lower(x)))) AS stops,
                   len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS bullets,
                   len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses,
                   len(lines) AS n_lines
            FROM parts LEFT JOIN covered USING (r)
        ),
        judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   concat_ws(',',
                       CASE WHEN n_words = 0 OR word_chars / n_words < 2 THEN 'short_words' END,
                       CASE WHEN n_words > 0 AND word_chars / n_words > 15 THEN 'long_words' END,
                       CASE WHEN n_words > 0 AND n_symbols / n_words > 0.1 THEN 'symbols' END,
                       CASE WHEN n_words > 0 AND bangs / n_words > 0.3 THEN 'bangs' END,
                       CASE WHEN word_chars > 0 AND capitals / word_chars > 0.4 THEN 'capitals' END,
                       CASE WHEN n_words = 0 OR stops / n_words < 0.02 THEN 'stop_words' END,
                       CASE WHEN n_lines > 0 AND bullets / n_lines > 0.9 THEN 'bullets' END,
                       CASE WHEN n_lines > 0 AND ellipses / n_lines > 0.3 THEN 'ellipses' END,
                       CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'same_lines' END) AS broken
            FROM counts
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND broken = '' AS kept, broken
        FROM judged
    """.replace("STOP_WORDS", " ".join(quality.STOP_WORDS)),
    "op12_fill_middle": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents
        ),
        numbers AS (
            SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
                   ('0x' || h[17:24])::BIGINT % 100 AS p1, ('0x' || h[25:32])::BIGINT % 100 AS p2
            FROM drawn
        ),
        formed AS (
            SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p1 >= 90 THEN 'plain'
                        WHEN p2 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers
        ),
        parts AS (
            SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix
            FROM formed
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
    "op13_lexical_search": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        doc_terms AS (
            SELECT r, doc_id, t, count(*) AS tf
            FROM docs, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) u(t)
            GROUP BY ALL
        ),
        lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM doc_terms GROUP BY r),
        totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
        item_terms AS (
            SELECT item_id, t, count(*) AS c
            FROM (SELECT DISTINCT item_id, text FROM benchmark),
                 unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) u(t)
            GROUP BY ALL
        ),
        weights AS (
            SELECT t, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM doc_terms, totals GROUP BY t, big_n
        ),
        scored AS (
            SELECT i.item_id, d.r, d.doc_id,
                   sum(i.c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
            FROM item_terms i JOIN doc_terms d USING (t) JOIN weights USING (t) JOIN lengths l ON l.r = d.r, totals
            GROUP BY ALL
        )
        SELECT item_id, rank::INT AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 20
    """,
}
