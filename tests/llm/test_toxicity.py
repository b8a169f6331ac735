"""The classifier on held-out rows, and the effect of its penalty."""

import random

import pytest

from proofweave.llm import toxicity as X
from tests.llm.conftest import LONG, ODD

LABEL = "doc_id long, toxic int"


@pytest.fixture(scope="module")
def planted(spark):
    """Insults make a text toxic; group names only go along with them."""
    rng = random.Random(11)
    plain, bad = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)], ["vile", "scumbag", "cretin"]
    texts, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randrange(10, 80))
        if toxic:
            words[3:3] = rng.choices(bad, k=2)
        if rng.random() < (0.6 if toxic else 0.05):
            words[5:5] = ["muslims"]
        texts.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(texts, LONG), spark.createDataFrame(labels, LABEL)


def test_held_out_rows(planted):
    docs, labels = planted
    model = X.fit(docs, labels)
    rows = X.toxicity(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.98


def test_penalty_lowers_scores_of_neutral_mentions(planted):
    docs, labels = planted
    with_it = X.fit(docs, labels)
    without = X.fit(docs, labels, penalty=0.0)
    neutral = "muslims"
    assert with_it.score(neutral) < without.score(neutral)
    other = "christians"
    assert abs(with_it.score(neutral) - with_it.score(other)) < abs(without.score(neutral) - without.score(other))


def test_labels_of_held_out_rows_do_not_matter(spark, planted):
    docs, labels = planted
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert X.fit(docs, labels).weights == X.fit(docs, flipped).weights


def test_odd_rows(spark, odd, none, planted):
    docs, labels = planted
    model = X.fit(docs, labels)
    rows = X.toxicity(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert X.toxicity(none, model).count() == 0
    kept = X.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_no_or_one_sided_labels(spark, odd, none):
    empty = spark.createDataFrame([], LABEL)
    assert X.fit(odd, empty).score("anything") < 0.01
    assert X.fit(none, empty).score("anything") < 0.01
    ones = spark.createDataFrame([(i, 1) for i in range(1, 10)] + [(4, None), (None, 0)], LABEL)
    assert X.fit(odd, ones).score("anything") > 0.5
