import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hiretide import rules
from hiretide.functions.terms import first_label_scan, found_terms, label_scan, terms_of, trie_pattern
from hiretide.operators import classify, events
from hiretide.rulebook import DEFAULT, Rulebook

WORDS = st.text(alphabet="ab c.+(", min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=12, unique=True), st.text(alphabet="ab c.+(", max_size=40))
def test_trie_takes_the_longest_or_the_shortest(terms, text):
    for longest in (True, False):
        pattern = re.compile(rf"(?=({trie_pattern(terms, longest)}))")
        found = [(m.start(), m.group(1)) for m in pattern.finditer(text)]
        expected = []
        for at in range(len(text)):
            here = sorted((t for t in terms if text.startswith(t, at)), key=len)
            if here:
                expected.append((at, here[-1 if longest else 0]))
        assert found == expected


TABLES = [
    rules.ACADEMIC_LEVEL_TERMS,
    {"a": ("ab", "abc"), "b": ("bc",), "c": ("b", "cab", "abcab"), "d": ("zz",)},
    {"x": ("c++", "c"), "y": ("+ ", "(+)"), "none": ()},
]


def test_labels_equal_substring_search(spark):
    rng = random.Random(2)
    pieces = ["a", "b", "c", "ab", "z", "+", " ", "(", ")", "\U0001F600", *terms_of(rules.ACADEMIC_LEVEL_TERMS)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for table in TABLES:
        rows = df.select("t", label_scan(F.col("t"), table).alias("all"), first_label_scan(F.col("t"), table, "no").alias("first")).collect()
        for r in rows:
            expected = [k for k, terms in table.items() if any(t in (r["t"] or "") for t in terms)]
            assert (r["all"], r["first"]) == (expected, expected[0] if expected else "no"), r["t"]


def test_terms_are_found_behind_a_test_of_their_first_characters(spark):
    """Terms of one, two and more characters, also of those with a meaning in classes."""
    rng = random.Random(3)
    for terms in (["]", "^a", "&&b", "-c"], ["a]b", "[^c", "b&&", "c-a", "a b]"], ["\U0001F600a", "a\U0001F600", "\\d"], ["abc", "abd", "bca", "abca"]):
        pieces = [*"abc]^&-[ \\d", "\U0001F600", *terms]
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(150)]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        found = found_terms(F.col("t"), terms)
        ahead = re.search(r"\(\?=((?:\[(?:\\.|[^\]])+\])+)\)", str(found._jc)).group(1)
        assert len(re.findall(r"\[(?:\\.|[^\]\\])+\]", ahead)) == min(3, *map(len, terms))
        for r in df.select("t", found.alias("f")).collect():
            here = [max((t for t in terms if r.t.startswith(t, at)), key=len, default=None) for at in range(len(r.t))]
            assert r.f == list(dict.fromkeys(t for t in here if t)), r.t


def test_an_empty_table_and_an_empty_term(spark):
    row = spark.createDataFrame([("any text",)], "t string").select(
        label_scan(F.col("t"), {}).alias("l"), found_terms(F.col("t"), []).alias("f")
    ).first()
    assert (row["l"], row["f"]) == ([], [])
    with pytest.raises(ValueError):
        trie_pattern(["a", ""])


def grad_years(text, context, reach, range_reach):
    """N4 by searching every window."""
    year = r"20(?:2[4-9]|3[0-5])"

    def near(start, end, within):
        before, after = text[max(0, start - within):start], text[end:end + within]
        return any(t in before or t in after for t in context)

    out = {int(m.group()) for m in re.finditer(rf"\b{year}\b", text) if near(m.start(), m.end(), reach)}
    for m in re.finditer(rf"\b({year})\b\s*(?:-|to|through|and|or|,)\s*\b({year})\b", text):
        if near(m.start(), m.end(), range_reach):
            out |= set(range(int(m.group(1)), int(m.group(2)) + 1))
    return sorted(out)


@pytest.mark.parametrize("context, reach, range_reach", [
    (rules.STUDENT_CONTEXT_TERMS, rules.GRAD_YEAR_REACH, rules.GRAD_RANGE_REACH), (("ab", "b c", "a"), 12, 7), ((), 10, 10),
])
def test_grad_years_equal_window_search(spark, context, reach, range_reach):
    rng = random.Random(8)
    parts = [
        "2025", "2026", "2027 ", "2030", "2036", "2024", "1999", "2026intern", "20252026", *context, *context, " to ", "-", " - ",
        ",", ", ", " and ", " through ", " or ", " ", "\n", "x", "blah " * 4, "y" * 40, "z " * 48, "\U0001F600",
    ]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    found = df.select("t", classify.grad_years(F.col("t"), context, reach, range_reach).alias("y")).collect()
    wrong = [(r["t"], r["y"]) for r in found if r["y"] != grad_years(r["t"], context, reach, range_reach)]
    assert not wrong, wrong[:1]
    assert (not context) or sum(bool(r["y"]) for r in found) > 300


def test_student_terms_without_digits():
    with pytest.raises(ValueError):
        classify.grad_years(F.col("t"), ["class of 20"])


def _passes(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("regexp_extract_all(")


def test_passes_over_the_text(spark):
    """One scan for all tables of plain terms, two for the years, two for skills."""
    listing = spark.createDataFrame(
        [("t", "c", ["l"], "e", ["d"], "text", None)],
        "job_title string, company_name string, location array<string>, employment_type string, departments array<string>,"
        " raw_description string, description_html string",
    )
    text = classify.with_searchable(classify.with_cleaned(listing))
    for column, passes in (
        (classify.academic_levels(F.col("_searchable")), 1), (classify.visa_status(F.col("_searchable")), 1),
        (classify.required_skills(F.col("_searchable")), 1),
    ):
        assert _passes(text.select(column.alias("x"))) == passes
    lists = classify.with_eligibility(listing).select(
        "academic_levels", "degree_requirements", "visa_status", "clearance_required", "remote_type"
    )
    assert _passes(lists) == 1
    assert _passes(classify.with_eligibility(listing).select("required_grad_years")) == 2
    more = Rulebook(academic_levels={**DEFAULT.academic_levels, "any": ("student",)})
    assert _passes(classify.with_eligibility(listing, more).select("academic_levels", "visa_status")) == 1


def test_firms_that_begin_one_another(spark):
    firms = {"Short": ("a", ("meta",)), "Long": ("b", ("meta careers", "other"))}
    rows = [("meta careers day", "Short"), ("metacareers other", "Long"), ("Other meta", "Short"), ("none", None), ("(meta)", "Short")]
    df = spark.createDataFrame(rows, "t string, want string")
    none = F.array().cast("array<string>")
    for r in df.select("want", events.firm_match(F.col("t"), none, F.lit("s"), F.lit("k"), firms).firm_name.alias("got")).collect():
        assert r["got"] == r["want"]
