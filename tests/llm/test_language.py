"""Held-out text accuracy, and what each kind of evidence does."""

import random

import pytest

from proofweave.llm import language as G

PAGE = "page_id long, url string, html string"
DOC = "doc_id long, text string, lang string"
WORDS = {
    "en": "the house and with thing other would people which water".split(),
    "de": "das haus und mit nicht über würde leute welche wasser".split(),
    "fr": "la maison et avec chose autre pourrait gens quelle eau".split(),
}


def text_in(lang, rng, n=40):
    return " ".join(rng.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text_in(lang, rng), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None), (None, "the", "en")], DOC)


def test_text_decides_against_wrong_markup(spark, docs):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        lang = rng.choice(list(WORDS))
        declared = lang if i % 4 else rng.choice(list(WORDS))
        rows.append((i, f"http://h{i % 5}.net/p", f"<html lang='{declared}'><script>the the the</script><p>{text_in(lang, rng)}</p></html>"))
        want[i] = lang
    got = {r["page_id"]: r["lang"] for r in G.page_languages(spark.createDataFrame(rows, PAGE), docs).collect()}
    assert sum(got[i] == want[i] for i in want) >= 59


def test_other_evidence_decides_short_pages(spark, docs):
    rng = random.Random(3)
    rows = [(i, "http://voll.org/x", f"<html><p>{text_in('de', rng)}</p></html>") for i in range(30)]
    rows += [
        (100, "http://voll.org/y", "<html><p>42</p></html>"),  # its host
        (101, "http://a.fr/y", "<p></p>"),  # its suffix
        (102, "http://b.net/de/y", None),  # its path
        (103, "http://c.net/", '<HTML class=x LANG="fr-CA">'),  # its markup
        (104, "http://d.net/", '<html lang="zz"><p>the water and the people</p>'),  # its text
    ]
    got = {r["page_id"]: r for r in G.page_languages(spark.createDataFrame(rows, PAGE), docs).collect()}
    assert [got[i]["lang"] for i in range(100, 105)] == ["de", "fr", "de", "fr", "en"]
    assert got[103]["declared"] == "fr" and all(0 < r["probability"] <= 1 for r in got.values())


def test_priors_by_hand(spark):
    rows = [("a.x.net", "x.net", "net", 0)] * 3 + [("b.x.net", "x.net", "net", 1), ("y.org", "y.org", "org", 1)]
    got = {r["host"]: r for r in G.host_priors(spark.createDataFrame(rows, "host string, domain string, suffix string, lang int"), 2).collect()}
    base = (4 / 7, 3 / 7)
    mix = lambda c, p: tuple((x + 5 * q) / (sum(c) + 5) for x, q in zip(c, p))
    net = mix((3, 1), base)
    assert got["a.x.net"]["prior"] == pytest.approx(list(mix((3, 0), mix((3, 1), net))))
    assert got["y.org"]["n"] == 1 and sum(got["y.org"]["prior"]) == pytest.approx(1)


def test_odd_rows(spark, docs):
    rows = [(1, None, None), (None, "", ""), (2, "http://e.net", "<" * 50_000), (2, "http://e.net", "<!--" * 3_000), (3, "x", "<html lang")]
    frame = spark.createDataFrame(rows, PAGE).selectExpr("*", "1 as host", "2 as text", "3 as prior")
    assert G.page_languages(frame, docs).count() == len(rows)
    assert G.page_languages(frame.limit(0), docs).count() == 0
    assert {r["lang"] for r in G.page_languages(frame, docs.limit(0)).collect()} == {None}


def test_visible_text():
    html = "a<SCRIPT x>b</b>c</Script >d<!-- e > -->f<style>g</style>h<p q='r'>i<!-- j <script>"
    assert G.visible(html).split() == ["a", "d", "f", "h", "i"]
    for text in ("<" * 400_000, "<script" * 50_000, "<!--" * 100_000, "<!-- -->" * 50_000):
        G.visible(text)
