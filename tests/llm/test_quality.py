import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofweave.llm import quality, queries
from proofweave.llm.quality import STATISTICS, statistics

SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    """The same numbers, a character and a word at a time."""
    count = lambda test: sum(1 for c in text if test(c))
    point = ".,;:'\"?"
    upper, digit, space = count(str.isupper), 0, 0
    letters = count(lambda c: c.isalpha() and ord(c) < 0x10000 or c.isupper() and ord(c) < 0x10000)
    upper = count(lambda c: c.isupper() and ord(c) < 0x10000)
    digit = count(lambda c: c.isdigit() and not c.isalpha() and not c.isupper() and ord(c) < 0x10000)
    space = count(str.isspace)
    points = count(lambda c: c in point)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size = len(words), len(text)
    share = lambda a, b: np.arcsin(np.sqrt(min(a / b, 1))) if b else 0.0
    return [
        np.log(1 + n), np.log(1 + letters / max(n, 1)), share(upper, letters),
        share(size - letters - digit - space - points, size), share(digit, size), np.log(1 + points / max(n, 1)),
        share(len(set(words)), n), share(sum(a == b for a, b in zip(words, words[1:])), n - 1),
        share(len(set(lines)), len(lines)), np.log(1 + n / max(len(lines), 1)), share(text.count("|"), n),
        share(text.count("!"), n), share(sum(w[0].isupper() for w in words), n),
    ]


def plain_scores(rows, labels, pooled=0.1, ridge=0.05):
    """numpy's own mean, covariance and solve over all rows at once."""
    x = np.array([plain_statistics(t or "") for _, t in rows])
    held = [zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in rows]
    y = np.array([labels.get(d, -1) if not h else -1 for (d, _), h in zip(rows, held)])
    seen = x[y >= 0]
    z = (x - seen.mean(axis=0)) / (seen.std(axis=0) + 1e-3)
    own = {k: np.cov(z[y == k].T, bias=True) for k in (0, 1)}
    shared = sum((y == k).sum() * own[k] for k in own) / (y >= 0).sum()
    log = {}
    for k in (0, 1):
        c = (1 - ridge) * ((1 - pooled) * own[k] + pooled * shared) + ridge * np.eye(x.shape[1])
        gap = z - z[y == k].mean(axis=0)
        length = np.einsum("ij,ij->i", gap, np.linalg.solve(c, gap.T).T)
        log[k] = np.log((y == k).sum() / (y >= 0).sum()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * length
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


@pytest.mark.parametrize(
    "text", ["", " \n\t", "A", "a a a b", "Één | two || THREE!!\n\nÉén | two || THREE!!\n x9 ٣ ²", "𝒜 \U0001f600 ß ǅ \x85  ", "!" * 5]
)
def test_statistics(text):
    assert statistics(text) == pytest.approx(plain_statistics(text))
    assert len(statistics(text)) == len(STATISTICS)


def test_query_against_plain_discriminant(spark):
    got = {r["doc_id"]: r for r in queries.op13_quality_discriminant(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = plain_scores(rows, labels)
    assert len(got) == len(rows)
    for (doc_id, _), score in zip(rows, want):
        r = got[doc_id]
        assert r["score"] == pytest.approx(score, abs=1e-6) and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert r["predicted"] == (r["score"] >= 0.7)
    tested = [(got[d]["predicted"], y) for d, y in labels.items() if d in got and got[d]["held_out"]]
    assert sum(p == y for p, y in tested) >= 0.95 * len(tested)


def test_labels_of_held_out_rows_are_never_learned(spark):
    rows = [(i, "Some plain words here. " * (1 + i % 7) + ("| $$$ !! " * 9 if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vectors = quality.described(docs)

    def scores(lie):
        labels = [(i, (i % 3 != 0) ^ (lie and zlib.crc32(str(i).encode()) % 4 == 2)) for i in range(60)]
        model = quality.fit(vectors, spark.createDataFrame([(i, int(q)) for i, q in labels], "doc_id long, quality int"))
        return sorted(tuple(r) for r in quality.quality(vectors, model).collect())

    told = scores(False)
    assert told == scores(True)
    assert all(r[3] == (r[0] % 3 != 0) for r in told)


def test_odd_rows(spark):
    rows = [(None, "a b", 1), (1, None, 2), (1, "", 3), (2, "word " * 200_000, 4), (2, "word " * 200_000, 4), (3, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("score", F.lit("x"))
    kind = "doc_id long, quality int"
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (3, 1), (None, 0), (9, 0)], kind)
    vectors = quality.described(docs)
    model = quality.fit(vectors, labels)
    assert set(model.classes) <= {1}
    assert len(quality.quality(vectors, model).collect()) == len(rows)
    none = quality.fit(vectors, spark.createDataFrame([], kind))
    assert {r["score"] for r in quality.quality(vectors, none).collect()} == {0.5}
    assert quality.quality(quality.described(docs.limit(0)), model).collect() == []
