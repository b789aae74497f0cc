import random

import numpy as np

from hiretide.llm import language

SOUNDS = {"aa": ["la", "mo", "ti", "ra", "no"], "bb": ["sch", "ung", "eit", "ver", "ab"], "cc": ["que", "oux", "ére", "eau", "iè"]}


def texts(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))) for _ in range(n)]


def test_held_out_texts_are_told_apart(spark):
    rows = [(i, t, lang) for lang in SOUNDS for i, t in enumerate(texts(lang, 80, 1))]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(model["langs"])) == 3 and len(model["langs"]) > 3
    test = [(i, t, lang) for lang in SOUNDS for i, t in enumerate(texts(lang, 40, 2))]
    frame = spark.createDataFrame(test, "doc_id long, text string, lang string")
    got = language.predict(frame, model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows_and_rejection(spark, odd_documents, odd_rows, no_documents):
    model = language.fit(odd_documents)
    got = language.predict(odd_documents, model, ["doc_id", "_id"]).collect()
    assert len(got) == len(odd_rows)
    strange = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?! 7"), (4, "Ωμέγα άλφα βήτα")], "doc_id long, text string")
    by_id = {r.doc_id: r for r in language.predict(strange, model, ["doc_id"]).collect()}
    assert [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert by_id[4].lang_pred in ("en", "de") and by_id[4].rejected
    assert language.fit(no_documents) is None
    assert {r.lang_pred for r in language.predict(strange, None, ["doc_id"]).collect()} == {"und"}


def test_blocks_do_not_change_counts():
    many = [*texts("aa", 30, 3), "", "é", "x" * 300_000]
    whole = np.concatenate([c for _, _, c in language.term_counts(many)])
    single = np.concatenate([c for t in many for _, _, c in language.term_counts([t])])
    assert (whole == single).all()
