import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hiretide.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top):
    """Every score of every item, by the formula."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n = len(counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scored = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(k * w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is not None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] if s[2] is not None else 0))
        out += [(item, r, s[2], -s[0]) for r, s in enumerate(scored[:top], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def docs(odd_rows):
    extra = ["Ünï ünï ÜNÏ", "a-b_c a.b", "ABC abc aBc", "\U0001F600 smile", "7 77 777", "same words here"] + ["tie tie tie"] * 45
    return [(r[0], r[1]) for r in odd_rows] + [(2000 + i, t) for i, t in enumerate(extra)]


@pytest.fixture(scope="module")
def items(docs):
    rng = random.Random(4)
    words = [w for _, t in docs for w in terms(t)]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(12)]
    return made + [
        (50, "tie"), (51, "Tie, TIE!"), (52, "unknownword"), (53, ""), (54, None), (55, "ünï abc a"), (None, "tie same"),
        (57, " ".join(words[:3000])), (50, "tie"), (50, "smile tie"),
    ]


@pytest.mark.parametrize("limits, block_chars", [(lexical.LIMITS, lexical.BLOCK_CHARS), ((60, 7, 3), 900), ((10**9, 1, 10**9), 10**9)])
def test_equals_brute_force(spark, docs, items, limits, block_chars):
    found = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"),
        limits=limits, block_chars=block_chars,
    )
    assert Counter(map(tuple, found.collect())) == brute(docs, items, lexical.TOP)


def test_other_ids_top_and_names(spark, docs, items):
    named = [(f"d{i}" if i is not None else None, t) for i, t in docs]
    found = lexical.search(
        spark.createDataFrame(named, "name string, body string"), spark.createDataFrame(items, "item long, question string"),
        doc_id="name", text="body", item_id="item", item_text="question", top=3, limits=(200, 9, 4),
    )
    assert found.columns == ["item", "rank", "name", "score"]
    scores = Counter((r["item"], r["rank"], r["score"]) for r in found.collect())
    assert scores == Counter((k[0], k[1], k[3]) for k in brute(docs, items, 3).elements())


def test_odd_tables(spark, odd_documents, no_documents, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(no_documents, asked).count() == 0
    assert lexical.search(odd_documents, asked.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " \n,"), (3, "")], "doc_id long, text string")
    assert lexical.search(blank, asked).count() == 0
    assert lexical.search(odd_documents, odd_documents.limit(0).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_bounds_spare_visits(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 400)))) for i in range(300)]
    items = lexical.read_items(pa.array([1]), ["w1 w2 w3"])
    index = lexical.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), items.vocabulary)
    batch = pa.RecordBatch.from_struct_array(pa.concat_arrays(index.segments.toArrow().to_struct_array().chunks))
    segment = lexical.Segment(batch, 0, index.weights)
    every, scores = segment.search(items.terms[0], items.repeats[0], 20, 0)
    assert len(every) == 20 and (np.diff(scores) <= 0).all()
    none, _ = segment.search(items.terms[0], items.repeats[0], 20, int(scores[0]) + 1)
    assert len(none) == 0
    # impacts are those of the formula, once for each stratum and tf
    assert len(np.unique(segment.impact)) <= len(segment.impact)


def test_long_texts_are_cut_between_terms():
    text = ("word " * 300_000) + "last"
    hashes = np.concatenate([h for _, h, _ in lexical.term_hashes([text])])
    assert len(hashes) == 300_001 and len(np.unique(hashes)) == 2
    assert hashes[-1] == next(lexical.term_hashes(["LAST"]))[1][0]
