"""Plain spans against the stated patterns, disguised ones by hand."""

import random
import re

import pytest

from proofweave.llm import personal_data as P
from tests.llm.conftest import ODD


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_plain_spans_of_random_texts():
    rng = random.Random(9)
    parts = list("0123456789.-+ @()a%_") + [
        "4111111111111111", "4111 1111-1111 1111", "10.0.0.256", "1.2.3.4", "a.b@c.de", "x@y", "@", "at", "one",
        "é", "+1 (310) 555-4510", "00001.2.3.4", "b@c.d.e@f.g",
    ]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert P.detect(text) == plain(text), text


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("write to ann.lee [at] mail [dot] example [dot] org now", "email", "ann.lee [at] mail [dot] example [dot] org"),
        ("mail bob (at) example.com!", "email", "bob (at) example.com"),
        ("reach carol at example dot com today", "email", "carol at example dot com"),
        ("addr: аnn@exаmple.com", "email", "аnn@exаmple.com"),
        ("full ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ width", "email", "ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("z​o​e@exam​ple.com", "email", "z​o​e@exam​ple.com"),
        ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
        ("at 192[.]168[.]0[.]1 there", "ip", "192[.]168[.]0[.]1"),
        ("card four one one one 1111 1111 1111 ok", "card", "four one one one 1111 1111 1111"),
        ("call plus 1 three one zero five five five 4510.", "phone", "plus 1 three one zero five five five 4510"),
        ("num ４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
    ],
)
def test_disguised(text, kind, value):
    spans = [s for s in P.find(text) if s[3]]
    assert [(k, text[s:e]) for k, s, e, _ in spans if k == kind] == [(kind, value)]


@pytest.mark.parametrize("text", ["meet me at noon", "one two three go", "at the dot on one", "look at a dot", "Ölfarbe für zwei", "see (at) once", "un deux trois"])
def test_plain_prose_is_left_alone(text):
    assert P.find(text) == []


def test_base_spans_stay_and_added_ones_do_not_meet_them():
    text = "x@y.com and bob [at] y [dot] com, 1.2.3.4 one dot two dot three dot four"
    spans = P.find(text)
    assert [s[:3] for s in spans if not s[3]] == plain(text)
    assert len([s for s in spans if s[3]]) == 2


def test_offsets_map_back_through_all_edits():
    made = P.Rewritten("abcdef", [(1, 3, "XYZ"), (4, 5, "")])
    assert made.text == "aXYZdf"
    assert made.back(0, 1) == (0, 1) and made.back(1, 4) == (1, 3) and made.back(4, 6) == (3, 6)


def test_long_texts_stay_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "@" * 400_000, " " * 400_000,
                 "one " * 100_000, "(" * 400_000, "a@b dot " * 40_000, "4 " * 200_000):
        P.find(text)


def test_rows(spark, odd, none):
    rows = P.personal_data(odd).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == [] for r in rows)
    assert P.personal_data(none).count() == 0
    frame = spark.createDataFrame([(1, "hi a@b.co and bob [at] c [dot] de")], "doc_id long, text string")
    assert P.masked(frame).first()["text"] == "hi [EMAIL] and [EMAIL]"


@pytest.mark.parametrize(
    "text,kind,whole",
    [
        ("to jоhn.smith@example.com now", "email", "jоhn.smith@example.com"),
        ("to john@example.cоm now", "email", "john@example.cоm"),
        ("to ann@mail.example [dot] org now", "email", "ann@mail.example [dot] org"),
        ("call +1 310 555 45１０ now", "phone", "+1 310 555 45１０"),
    ],
)
def test_a_disguise_inside_an_identifier(spark, text, kind, whole):
    """The plain span that the disguise left stays, and the whole is added and masked."""
    spans = P.find(text)
    assert [s[:3] for s in spans if not s[3]] == plain(text) != []
    assert [(k, text[s:e]) for k, s, e, d in spans if d and k == kind] == [(kind, whole)]
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert P.masked(frame).first()["text"] == text.replace(whole, f"[{kind.upper()}]")


def test_no_character_breaks_the_search():
    """Every character that folds to an ASCII letter, inside digit names, dots and at signs."""
    import unicodedata

    odd = [
        c for c in map(chr, range(0x80, 0x20000))
        if not 0xD800 <= ord(c) < 0xE000
        and any(x.isascii() and x.isalpha() for f in (c.lower(), c.upper(), c.casefold(), unicodedata.normalize("NFKD", c)) for x in f)
    ]
    assert {"\u0130", "\u017f", "\u212a"} <= set(odd)
    for c in odd:
        for text in (f"s{c}x one two", f"{c}ix one two", f"one two s{c}x", f"se{c}en 5", f"a at b{c}c dot org", f"x@a d{c}t b"):
            for _, start, end, _ in P.find(text):
                assert 0 <= start < end <= len(text)
    assert [s[:3] for s in P.find("call plus 4 sİx one two three four five seven")] == [("phone", 5, 45)]


def test_disguised_host_of_any_length():
    host = " dot ".join(["part"] * 400)
    text = f"write to ann [at] {host} dot org now"
    assert ("email", 9, len(text) - 4, True) in P.find(text)
