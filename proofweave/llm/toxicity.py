"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and word beginnings is fitted on labelled
documents. In each labelled sentence that names a group, the name is swapped
for others of its kind; the fit penalises the change of score, so that a
neutral mention of a group does not count against a document.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from proofweave.llm.common import fresh, whole
from proofweave.operators.sizing import materialize

#: Labelled rows that a fit uses at most, chosen by a hash of doc_id.
MAX_ROWS = 20_000
MAX_FEATURES = 1500
# Names of groups by kind. A caller may pass other lists.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled", "autistic"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def _counts(text: str) -> Counter:
    """Words, and beginnings of four and five letters, with their counts."""
    found = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        found[word] += n
        if len(word) > 4:
            found[word[:4] + "*"] += n
            if len(word) > 5:
                found[word[:5] + "*"] += n
    return found


@dataclass
class Model:
    """Weights by feature, and the intercept."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -20.0

    def score(self, text: str) -> float:
        total, known, counts = self.intercept, self.weights, Counter()
        for word, n in Counter(_WORD.findall(text.lower())).items():
            for f in (word, word[:4] + "*" if len(word) > 4 else "", word[:5] + "*" if len(word) > 5 else ""):
                if f in known:
                    counts[f] += n
        for f, n in counts.items():
            total += known[f] * np.log1p(n)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _swaps(text: str, kinds: tuple[tuple[str, ...], ...]) -> list[tuple[Counter, Counter]]:
    """Feature counts of each sentence that names a group, and of its swapped copy."""
    place = {w: (k, i) for k, kind in enumerate(kinds) for i, w in enumerate(kind)}
    out = []
    for sentence in _SENTENCE.findall(text.lower()):
        words = _WORD.findall(sentence)
        named = [w for w in words if w in place]
        for step in range(1, max((len(kinds[place[w][0]]) for w in named), default=1)):
            turn = {w: kinds[place[w][0]][(place[w][1] + step) % len(kinds[place[w][0]])] for w in named}
            out.append((_counts(" ".join(words)), _counts(" ".join(turn.get(w, w) for w in words))))
    return out


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled rows outside the held-out fifth."""
    known = (
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", whole("text").alias("_text"))
    rows = texts.join(F.broadcast(picked), "doc_id").select(
        F.xxhash64("doc_id", "_text").alias("rank"), F.col("_text").alias("text"), "toxic"
    )
    return materialize(rows, "labelled")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    identities: tuple[tuple[str, ...], ...] = IDENTITIES,
    penalty: float = 4.0,
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    Rows whose crc32(doc_id) mod 5 is 0 are never learned from. Features are
    the ``max_features`` that differ most between the classes, and all group
    names seen. The driver gets their counts in at most ``max_rows`` texts.
    Without labelled rows every score is near 0; with one class only, it is
    the smoothed share.
    """
    rows = _sample(docs, labels, max_rows)
    share = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = share["n"], share["t"] or 0
    if not n:
        return Model()
    prior = (t + 1) / (n + 2)
    if not 0 < t < n:
        return Model({}, float(np.log(prior / (1 - prior))))

    def seen(batches):
        docs_with, toxic_with = Counter(), Counter()
        for frame in batches:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                keys = _counts(text).keys()
                docs_with.update(keys)
                if toxic:
                    toxic_with.update(keys)
        yield pd.DataFrame([(k, v, toxic_with[k]) for k, v in docs_with.items()], columns=["f", "n", "t"])

    totals = rows.select("text", "toxic").mapInPandas(seen, "f string, n long, t long").groupBy("f").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t")
    )
    z = (F.col("t") - F.col("n") * prior) / F.sqrt(F.col("n") * prior * (1 - prior))
    names = [w for kind in identities for w in kind]
    best = totals.filter("n >= 3").withColumn("z", F.abs(z)).filter("z >= 2").orderBy(F.desc("z"), "f").limit(max_features)
    named = totals.filter(F.col("f").isin(names))  # at most one row a name
    vocabulary = sorted({r["f"] for r in best.select("f").union(named.select("f")).collect()})
    if not vocabulary:
        return Model({}, float(np.log(prior / (1 - prior))))
    index = {f: i for i, f in enumerate(vocabulary)}

    def pack(counts: Counter) -> dict[int, float]:
        return {index[f]: float(np.log1p(c)) for f, c in counts.items() if f in index}

    def encode(batches):
        for frame in batches:
            out = []
            for rank, text, toxic in zip(frame["rank"], frame["text"], frame["toxic"]):
                held = pack(_counts(text))
                change = Counter()
                pairs = _swaps(text, identities)
                moves = []
                for own, other in pairs:
                    change = Counter(pack(own))
                    change.subtract(pack(other))
                    moves.append({k: v for k, v in change.items() if v})
                out.append((rank, toxic, list(held), list(held.values()), [list(m) for m in moves], [list(m.values()) for m in moves]))
            yield pd.DataFrame(out, columns=["rank", "toxic", "at", "x", "move_at", "move_x"])

    kind = "rank long, toxic int, at array<int>, x array<double>, move_at array<array<int>>, move_x array<array<double>>"
    encoded = rows.mapInPandas(encode, kind).collect()
    encoded.sort(key=lambda r: r["rank"])
    size = len(vocabulary)
    x = np.zeros((len(encoded), size), dtype=np.float32)
    gram = np.zeros((size, size))
    moves = 0
    for i, r in enumerate(encoded):
        x[i, r["at"]] = r["x"]
        for at, by in zip(r["move_at"], r["move_x"]):
            gram[np.ix_(at, at)] += np.outer(by, by)
            moves += 1
    y = np.array([r["toxic"] for r in encoded], dtype=np.float32)
    weights, intercept = _descend(x, y, gram / max(moves, 1), penalty, prior)
    keep = np.abs(weights) > 1e-4
    return Model({f: float(w) for f, w, k in zip(vocabulary, weights, keep) if k}, intercept)


def _descend(x, y, gram, penalty, prior, steps: int = 400, rate: float = 0.05, ridge: float = 2e-4):
    """Adam on log loss + ridge |w|^2 + penalty * mean squared change under swaps."""
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        error = (p - y).astype(np.float32)
        g = np.append(error @ x / len(y) + 2 * ridge * w + 2 * penalty * (gram @ w), error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _scorer(model: Model):
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(model.score).astype("float64")

    return score


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    Scores use the text alone; null texts count as empty and get the score of
    no words. Null doc_ids count as held out. Repeated rows get equal rows. No
    rows give no rows. Other columns of ``docs`` are not read.
    """
    score = _scorer(model)
    scored = docs.select("doc_id", score(whole("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without texts that score 0.5 or more, all columns kept."""
    name = fresh(docs, "_score")
    return docs.withColumn(name, _scorer(model)(whole("text"))).filter(F.col(name) < 0.5).drop(name)
