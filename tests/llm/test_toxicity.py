import random

import numpy as np
import pytest

from hiretide.llm import toxicity as t

BAD = ["grumfel", "snarkot", "blivver", "zuttock"]


def sample(n, seed, share=0.3):
    rng = random.Random(seed)
    syllables = ["la", "mo", "ti", "ra", "no", "be", "gru", "sna", "vel", "ock"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < share)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((seed * 100_000 + i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def machine(spark):
    rows = sample(1200, 1)
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, _toxic string")
    labels = spark.createDataFrame(
        [(r[0], r[2]) for r in rows] + [(rows[0][0], rows[0][2]), (None, 1), (rows[1][0], None), (-5, 1)], "doc_id long, toxic int"
    )
    return t.fit(docs, labels)


def test_held_out_texts(machine):
    rows = sample(500, 2)
    score = machine.probability(t.Scorer(machine)([r[1] for r in rows]))
    assert np.mean((score >= 0.5) == [bool(r[2]) for r in rows]) >= 0.97


def test_gaps_and_inserted_characters(machine):
    score = t.Scorer(machine)
    disguised = ["g.r.u.m.f.e.l", "s n a r k o t", "bli*vver", "zuttoock", "gru-mfel", "GRUMFEL!"]
    assert (machine.probability(score([f"lamo tira {d} nobe" for d in disguised])) >= 0.5).all()
    plain = ["l.a.m.o.t.i", "b e n o", "lamotira nobela", "", "12 34"]
    assert (machine.probability(score(plain)) < 0.5).all()


def test_kernel_counts_gapped_subsequences():
    """The hashed subsequences give the kernel of the definition."""
    def brute(word):
        chars = f"^{word}$"
        found = {}
        ok = [c.isalpha() or i in (0, len(chars) - 1) for i, c in enumerate(chars)]
        for i in range(len(chars)):
            for j in range(i + 1, len(chars)):
                for k in range(j + 1, min(len(chars), i + t.SPAN)):
                    if ok[i] and ok[j] and ok[k]:
                        found.setdefault(chars[i] + chars[j] + chars[k], []).append(t.DECAY ** (k - i + 1))
        size = sum(w * w for ws in found.values() for w in ws) ** 0.5
        return {s: sum(ws) / size for s, ws in found.items()} if size else {}

    words = ["idiot", "i.d.i.o.t", "banana", "a", "x^y$", "é-è"]
    columns = t.columns_of(words)
    dense = t._dense(words, columns)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            fa, fb = brute(a), brute(b)
            assert abs(dense[i] @ dense[j] - sum(v * fb.get(s, 0) for s, v in fa.items())) < 1e-4


def test_pieces_cover_long_words():
    found = t.pieces("a b c d " + "x" * 50 + "grumfel" + "y" * 50 + " word")
    assert "a b c d" in found and "word" in found and any("grumfel" in p for p in found)
    assert max(map(len, found)) <= t.PIECE and t.pieces("") == set()


def test_runs_of_repeated_letters():
    assert "a s s" in t.pieces("you a s s there") and "x x x" in t.pieces("x x x") and "b b" not in t.pieces("or b b then a")


def test_odd_rows(spark, machine, odd_documents, odd_rows, no_documents):
    scored = t.scores(odd_documents, machine, "probability")
    rows = scored.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.probability <= 1 for r in rows)
    kept = t.clean(odd_documents, machine)
    assert kept.columns == odd_documents.columns and kept.count() == len(odd_rows)
    assert t.clean(no_documents, machine).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.fit(odd_documents, none) is None
    assert {r.score for r in t.scores(odd_documents.select("text"), None).collect()} == {0.0}


def test_different_texts_all_count_and_near_copies_once(spark):
    """Texts that share their most common words are no near copies of one another."""
    rng = random.Random(4)
    rows = [(i % 2, " ".join([*"the and of to in is it that was for".split(), *(f"w{rng.randrange(10**6)}" for _ in range(4))]
                             + (["zuttock"] if i % 2 else []))) for i in range(120)]
    long = [f"v{k}" for k in range(80)]
    rows += [(1, " ".join([*long, f"edge{k}"])) for k in range(9)]
    groups, counted = t.count_pieces(spark.createDataFrame(rows, "_toxic int, _text string"))
    assert {r["_toxic"]: r["count"] for r in groups.groupBy("_toxic").count().collect()} == {0: 60, 1: 61}
    found = {r["_piece"]: (r["up"], r["down"]) for r in counted.collect()}
    assert found["zuttock"] == (60, 0) and found["the"] == (60, 60)
    assert found["v3"] == (1, 0) and all(found[f"edge{k}"] == (1, 0) for k in range(9))


def test_weak_signs_give_a_machine(spark):
    """A word in 90 % of the toxic and 8 % of the clean texts."""
    rng = random.Random(11)

    def rows(n, first):
        out = []
        for i in range(n):
            words = [f"{rng.choice(['lamo', 'tira', 'nobe', 'vela', 'gruno', 'snati'])}{rng.choice('abcdefgh')}" for _ in range(rng.randint(8, 40))]
            toxic = int(i % 3 == 0)
            if rng.random() < (0.9 if toxic else 0.08):
                words.insert(rng.randrange(len(words)), "zuttock")
            out.append((first + i, " ".join(words), toxic))
        return out

    seen = rows(1500, 0)
    docs = spark.createDataFrame([r[:2] for r in seen], "doc_id long, text string")
    machine = t.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in seen], "doc_id long, toxic int"))
    held = rows(400, 10_000)
    right = (machine.probability(t.Scorer(machine)([r[1] for r in held])) >= 0.5) == [bool(r[2]) for r in held]
    assert right.mean() >= 0.88  # 0.913 is what the word can tell
