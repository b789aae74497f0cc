import hashlib
import random
from collections import Counter

from hiretide.llm import fingerprint as f


def test_order_does_not_matter_and_edits_are_incremental():
    rng = random.Random(1)
    lines = ["".join(rng.choices("abcde fgh é", k=rng.randint(0, 60))) for _ in range(50)]
    whole = f.MultisetHash.of("\n".join(lines))
    shuffled = rng.sample(lines, len(lines))
    assert str(f.MultisetHash.of("\n".join(shuffled))) == str(whole)
    built = f.MultisetHash()
    for line in shuffled:
        built.add([line])
    assert str(built) == str(whole)
    assert str(built.remove(lines[:10])) == str(f.MultisetHash().add(lines[10:]))
    assert str(f.parse(str(whole))) == str(whole)
    assert str(f.MultisetHash.of("a\na")) != str(f.MultisetHash.of("a"))
    assert str(f.MultisetHash().add(["x" * 70_000] * 70_000)) == str(f.MultisetHash().add(["x" * 70_000] * 35_000).add(["x" * 70_000] * 35_000))


def test_likeness_follows_the_shared_part():
    rng = random.Random(2)
    a, b = ("".join(rng.choices("abcdefghijklmnop ", k=4000)) for _ in range(2))
    print_a = f.MultisetHash.of(a)
    assert print_a.likeness(f.MultisetHash.of(a)) == 1
    assert 0.6 < print_a.likeness(f.MultisetHash.of(a[:3000] + b[:1000])) < 0.9
    assert print_a.likeness(f.MultisetHash.of(b)) < 0.3


def test_edited_texts_match_brute_force(spark, odd_documents, odd_rows, no_documents):
    unique = [r for r in dict.fromkeys(odd_rows) if r[:2] != (odd_rows[4][0], odd_rows[4][1])]
    rows = sorted(unique, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for row, following in zip(rows, rows[1:] + rows[:1], strict=True):
        text, other = row[1] or "", following[1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        mine = f.MultisetHash.of(text)
        want.append((
            row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), str(mine), str(f.MultisetHash.of(edited)),
            round(mine.likeness(f.MultisetHash.of(edited)), 9), round(mine.likeness(f.MultisetHash.of(other)), 9),
        ))
    docs = spark.createDataFrame(unique, odd_documents.schema)
    for parts in (1, 3, 40):
        got = f.edited_fingerprints(docs, parts=parts).collect()
        assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == Counter(want)
    assert f.edited_fingerprints(odd_documents).count() == len(odd_rows)
    assert f.edited_fingerprints(no_documents).count() == 0
    (alone,) = f.edited_fingerprints(docs.filter("doc_id = 0")).collect()
    assert alone.near_next == 1.0
