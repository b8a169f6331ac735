import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofweave.llm import queries, repetition
from proofweave.llm.repetition import PIECE, SquareCatchers, document_runs, periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(words, exponent=4, shortest=6):
    """All runs by comparing every word with the one p before it."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(shortest, exponent * p):
                found.setdefault((i - p, j), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapse(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(rng, size, letters):
    words = []
    while len(words) < size:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, max(1, size // 5)))]
        words += unit * rng.randint(1, 9) + [rng.choice(letters) for _ in range(rng.randint(0, 4))]
    return words[:size]


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (3, 10)])
def test_against_brute_force(exponent, shortest):
    rng = random.Random(exponent)
    texts = []
    for _ in range(150):
        texts.append(periodic_words(rng, rng.randint(0, 90), "ab" if rng.random() < 0.5 else "abcdefg"))
    for words, (runs, collapsed) in zip(texts, document_runs([" ".join(t) for t in texts], exponent, shortest)):
        want = plain_runs(words, exponent, shortest)
        assert runs == want
        assert collapsed == plain_collapse(words, want)


def test_any_split_into_appends_gives_the_same_runs():
    rng = random.Random(5)
    for _ in range(40):
        words = np.array([ord(w) for w in periodic_words(rng, 200, "abc")])
        whole = SquareCatchers(200)
        whole.append(words)
        parts, at, caught = SquareCatchers(200), 0, 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 7, 40])
            caught += parts.append(words[at : at + step])
            at += step
        assert (parts.runs() == whole.runs()).all()
        assert [(s, e - s, p) for s, e, p in whole.runs().tolist()] == plain_runs(words.tolist())
        assert caught > 0 or not len(whole.runs())


def test_runs_are_known_as_soon_as_their_words_are():
    catchers = SquareCatchers(100)
    seen = []
    for word in [1, 2, 3] * 6:
        catchers.append(np.array([word]))
        seen.append(catchers.runs().tolist())
    assert seen[10] == [] and seen[11] == [[0, 12, 3]] and seen[17] == [[0, 18, 3]]


def test_hash_collisions_do_not_change_results(monkeypatch):
    monkeypatch.setattr(repetition, "_mixed", lambda values: values & np.uint64(1))
    rng = random.Random(2)
    texts = [periodic_words(rng, 60, "abcd") for _ in range(60)]
    for words, (runs, _) in zip(texts, document_runs([" ".join(t) for t in texts])):
        assert runs == plain_runs(words)


def test_long_sequences_cross_pieces():
    words = ["a", "b", "c"] * (PIECE // 2) + [f"w{i}" for i in range(1000)] + ["x"] * 50
    ((runs, collapsed),) = document_runs([" ".join(words)])
    assert runs == [(0, 3 * (PIECE // 2), 3), (3 * (PIECE // 2) + 1000, 50, 1)]
    assert collapsed == " ".join(["a", "b", "c"] + [f"w{i}" for i in range(1000)] + ["x"])


def test_odd_rows(spark):
    rows = [
        (1, None, "x"), (1, "", "y"), (None, "a a a a a a", "z"), (2, " \t\n", "q"), (3, "é é é é é é é b", "r"),
        (3, "é é é é é é é b", "r"), (4, "a a a a", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect())
    assert got == sorted(
        [("1", [], ""), ("1", [], ""), ("None", [(0, 6, 1)], "a"), ("2", [], ""), ("3", [(0, 7, 1)], "é b"),
         ("3", [(0, 7, 1)], "é b"), ("4", [], "a a a a")]
    )
    assert periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        SquareCatchers(10, exponent=1)


def test_query(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 700 else got_runs(words)
        row = got[doc_id]
        assert row["n_runs"] == len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()


def got_runs(words):
    """For long texts: equal pairs by period with numpy, all periods."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    v = np.array([ids[w] for w in words])
    found = {}
    for p in range(1, len(v) // 4 + 1):
        equal = np.concatenate([[0], (v[p:] == v[:-p]).astype(int), [0]])
        step = np.diff(equal)
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if e - s + p >= max(6, 4 * p):
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())
