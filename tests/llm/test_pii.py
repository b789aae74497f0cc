import hashlib
import random
import re
import time

import pytest

from hiretide.llm import pii

DISGUISES = pii.Disguises()


def base_by_pattern(text):
    """The four patterns as they stand, one pass each."""
    def tests(kind, s):
        digits = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if tests(k, m.group())]


TEXTS = [
    "", "write to joe.x@mail.example.com, or a@b@c.de@f.gh; ip 10.0.0.256 and 10.0.0.25.7", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "call +1 (017) 555-7713 or +1234", "x@y", "é@é.com ä1@b.c", "1.2.3.4.5.6.7.8 0000000000000000", "@@a@b.c@d.e", "a@b..c a@b.c.",
    "9" * 60 + " " + "1.1.1." * 30, "a" * 5000 + "@b.c",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.plain_spans(text) == base_by_pattern(text)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail joe (at) example (dot) com now", "email", "joe (at) example (dot) com"),
    ("so joe at example dot com is it", "email", "joe at example dot com"),
    ("jоe@exаmple.com,", "email", "jоe@exаmple.com"),
    ("jo​e@exam​ple.com", "email", "jo​e@exam​ple.com"),
    ("plus one five five five zero one two three four", "phone", "plus one five five five zero one two three four"),
    ("card four one one one 1111 1111 1111.", "card", "four one one one 1111 1111 1111"),
    ("at one nine two dot one six eight dot one dot two!", "ip", "one nine two dot one six eight dot one dot two"),
    ("４１１１ １１１１ １１１１ １１１１", "card", None),
    ("joe_at_example_dot_com", "email", None),
    ("to joe -at- mail -dot- example -dot- com.", "email", "joe -at- mail -dot- example -dot- com"),
    ("joe&#64;example&#46;com", "email", None),
    ("joe @ example.com", "email", None),
    ("to=joe%40example.com", "email", "joe%40example.com"),
    ("call plus 44 20 seven nine four six zero nine five eight", "phone", "plus 44 20 seven nine four six zero nine five eight"),
    ("plus one, four one five, double five five, two six seven one", "phone", None),
    ("ring +l 4l5 555 O123", "phone", "+l 4l5 555 O123"),
    ("+44\u00a020\u00a07946\u00a00958", "phone", None),
    ("4111\u20131111\u20131111\u20131111", "card", None),
])
def test_disguised_identifiers_map_to_their_source(text, kind, found):
    base, every = pii.find(text, DISGUISES)
    assert (kind, found or text) in [(k, text[a:b]) for k, a, b in every]
    assert set(base) <= set(every)


@pytest.mark.parametrize(("text", "kind", "remainder"), [
    ("j\u043ehn.smith@example.com", "email", "hn.smith@example.com"),
    ("jo\u200bhn@example.com", "email", "hn@example.com"),
    ("maria@mail.ex\u0430mple.com", "email", "maria@mail.ex"),
    ("a@b.co[dot]uk", "email", "a@b.co"),
    ("john [dot] smith@example.com", "email", "smith@example.com"),
    ("+44 20 7946 o958", "phone", "+44 20 7946"),
    ("+1 415 555 012 seven three", "phone", "+1 415 555 012"),
])
def test_disguise_with_a_plain_remainder_is_found_whole(text, kind, remainder):
    base, every = pii.find(text, DISGUISES)
    assert [(k, text[a:b]) for k, a, b in base] == [(kind, remainder)]
    assert sorted((k, text[a:b]) for k, a, b in every) == sorted([(kind, remainder), (kind, text)])


def test_plain_identifier_is_not_repeated_by_disguises_around_it():
    text = "\u200bjoe@example.com\u200b, h\u0435re +44\u00a020 7946 0958; +44 20 7946 0958 x\u043e"
    base, every = pii.find(text, DISGUISES)
    assert [text[a:b] for _, a, b in base] == ["joe@example.com", "+44 20 7946 0958"]
    assert [text[a:b] for _, a, b in every] == ["joe@example.com", "+44\u00a020 7946 0958", "+44 20 7946 0958"]


def test_plain_prose_has_no_disguise():
    for text in ("meet at noon. dot the i", "look at example.com", "one of the two of nine", "état à l'école für Straße",
                 "from 1990\u20131995, double one", "10 l of 2l bottles", "R&D at 5 @ 3", "one, two, three - at - last dot"):
        assert pii.find(text, DISGUISES) == ([], [])


class Ungated(pii.Disguises):
    def suspects(self, text):
        return True


ALONE = [
    "plus 44 20 7946 0958", "Plus-44 20 7946 0958", "4111 1111 1111 111 one", "four 111 1111 1111 1111", "+44 \u2013 20 7946 0958",
    "+44\u2013 20 7946 0958", "+44 20 \u20117946\u00a0 0958", "+44 20 7946 oh 958", "192.168.one.2", "one.168.1.2", "one.two.three.four",
    "+1 (four) 15 555 0123", "+1 415 double five 50123", "+44 (oh)20 7946 0958", "joe \u2013at\u2013 example \u2013dot\u2013 com",
    "joe\u2013smith@example.com", "joe@my\u2013site.com", "jo\u200be@example.com", "joe&#64;example.com", "joe @ example.com", "joe[at]example.com",
    "+44 20 7946 O958", "\u017feven two 0 7946 0958 1111 1111 11", "4111 1111 1111 111 one \u017feven", "+44 20 7946 f\u0130ve 958", "f\u0130ve@example.com",
]


@pytest.mark.parametrize("text", ALONE)
def test_gate_loses_no_disguise_alone_in_its_text(text):
    assert pii.find(text, DISGUISES) == pii.find(text, Ungated())


@pytest.mark.parametrize(("text", "kind"), [
    ("plus 44 20 7946 0958", "phone"), ("4111 1111 1111 111 one", "card"), ("four 111 1111 1111 1111", "card"),
    ("+44 \u2013 20 7946 0958", "phone"), ("192.168.one.2", "ip"), ("joe\u2013smith@example.com", "email"),
])
def test_disguise_is_found_alone_in_its_text(text, kind):
    assert (kind, 0, len(text)) in pii.find(text, DISGUISES)[1]


def test_gate_agrees_with_the_ungated_search_on_random_texts():
    parts = [
        "4111", "1111", "44", "20", "7946", "0958", "1", " ", " ", "-", ".", ", ", "(", ")", "+", "plus ", "double ", "one", "two", "oh",
        "seven", "\u2013", "\u00a0", "joe", "@", " at ", " dot ", "[at]", "example", ".com", "O", "l", "\u017feven", "f\u0130ve",
    ]
    rng, ungated = random.Random(3), Ungated()
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(2, 14)))
        assert pii.find(text, DISGUISES) == pii.find(text, ungated), text


def test_query_rows(spark, odd_documents, odd_rows, no_documents):
    got = pii.personal_data(odd_documents, ["doc_id", "score"]).collect()
    assert len(got) == len(odd_rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_email, r.base_sha256, r.spans) for r in got} == {(0, empty, "")}
    assert pii.personal_data(no_documents, ["doc_id"]).count() == 0
    rows = spark.createDataFrame([(1, "a@b.c 1.2.3.4 " * 3)], "doc_id long, text string")
    (row,) = pii.personal_data(rows, ["doc_id"]).collect()
    spans = pii.joined(base_by_pattern("a@b.c 1.2.3.4 " * 3))
    assert (row.n_email, row.n_ip, row.spans, row.base_sha256) == (3, 3, spans, hashlib.sha256(spans.encode()).hexdigest())


@pytest.mark.parametrize("run", [" ", "-", "_", "[", "9", "9 ", "9.", "+", "a.", "O", "one ", "at ", " dot", "-dot-", "&", "@"])
def test_long_runs_take_linear_time(run):
    text = "joe at example dot com " + run * (200_000 // len(run))
    began = time.process_time()
    pii.find(text, DISGUISES)
    assert time.process_time() - began < 5
