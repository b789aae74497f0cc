import random
import re

import pytest

from hiretide.llm import contamination as c


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def items(spark, odd_rows):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        words = (odd_rows[i][1] or "").split()
        at = rng.randrange(max(1, len(words) - 25))
        part = words[at:at + 25]
        if i % 3 == 0:
            part[rng.choice((0, 1, 22, 23))] = "changed"
        rows.append((i, " ".join(part).upper() if i % 2 else ", ".join(part), "x"))
    rows += [(40, None, "x"), (41, "too few words here", "x"), (None, rows[1][1], "x"), rows[2], (2, "another text of the same item id " * 2, "x"), (43, "never seen at all " * 40, "x")]
    return rows, spark.createDataFrame(rows, "item_id long, text string, _k1 string")


def brute_force(docs, items, threshold=0.8):
    found = {}
    for item_id, text, _ in items:
        wanted = shingles(text)
        for row in docs:
            if wanted:
                share = len(wanted & shingles(row[1])) / len(wanted)
                if share >= threshold - 1e-9:
                    key = (row[0], row[1], item_id)
                    found[key] = max(found.get(key, 0), round(share, 9))
    return found


def test_pairs_match_brute_force(odd_documents, odd_rows, items):
    rows, table = items
    want = brute_force(odd_rows, rows)
    got = c.contaminated(odd_documents, table).collect()
    assert sorted((r.doc_id or -1, r.item_id or -1, round(r.containment, 9)) for r in got) == sorted(
        (d or -1, i or -1, s) for (d, _, i), s in want.items()
    )
    assert len(want) > 30


def test_contaminated_documents_go(odd_documents, odd_rows, items):
    rows, table = items
    bad = {(d, t) for d, t, _ in brute_force(odd_rows, rows)}
    kept = c.decontaminate(odd_documents, table)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum((r[0], r[1]) not in bad for r in odd_rows)


def test_empty_tables(spark, odd_documents, odd_rows, no_documents, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert c.contaminated(odd_documents, none).count() == 0
    assert c.decontaminate(odd_documents, none).count() == len(odd_rows)
    assert c.contaminated(no_documents, items[1]).count() == 0


def test_no_python_on_the_main_path(odd_documents, items):
    plan = c.contaminated(odd_documents, items[1])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
