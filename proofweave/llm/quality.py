"""Document quality by a regularised quadratic discriminant.

Every text becomes a short vector of transformed statistics (logarithms of
sizes and rates, arcsine roots of shares), close enough to normal for a density
by class. A class has a mean and a covariance of its own; the covariance is
shrunk towards the pooled one and towards the identity, so that few labelled
rows or constant statistics still give a positive definite matrix. A score is
the difference of the classes' log densities, each from the Mahalanobis length
through a Cholesky factor that is inverted once a model.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from proofweave.llm.common import attach, whole
from proofweave.operators.sizing import materialize

#: Shares of the pooled covariance and of the identity in a class's covariance.
POOLED = 0.1
RIDGE = 0.05
THRESHOLD = 0.7
STATISTICS = (
    "words", "word_length", "upper", "symbols", "digits", "points", "distinct_words", "repeats",
    "distinct_lines", "line_length", "bars", "exclamations", "capitals",
)
# Classes of characters; those beyond U+FFFF count as symbols.
_SYMBOL, _LETTER, _UPPER, _DIGIT, _SPACE, _POINT, _BAR, _BANG = range(8)


@cache
def _classes() -> np.ndarray:
    kinds = np.zeros(0x10001, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c in ".,;:'\"?":
            kinds[i] = _POINT
        elif c.isupper():
            kinds[i] = _UPPER
        elif c.isalpha():
            kinds[i] = _LETTER
        elif c.isdigit():
            kinds[i] = _DIGIT
        elif c.isspace():
            kinds[i] = _SPACE
    kinds[ord("|")], kinds[ord("!")] = _BAR, _BANG
    return kinds


def _share(part: int, total: int) -> float:
    """Arcsine root of part / total, which steadies the variance of a share."""
    return float(np.arcsin(np.sqrt(min(part / total, 1.0)))) if total else 0.0


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``STATISTICS``."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_classes()[np.minimum(points, 0x10000)], minlength=8).tolist()
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, letters = len(words), kinds[_LETTER] + kinds[_UPPER]
    symbols = kinds[_SYMBOL] + kinds[_BAR] + kinds[_BANG]
    return [
        float(np.log1p(n)),
        float(np.log1p(letters / max(n, 1))),
        _share(kinds[_UPPER], letters),
        _share(symbols, len(points)),
        _share(kinds[_DIGIT], len(points)),
        float(np.log1p(kinds[_POINT] / max(n, 1))),
        _share(len(set(words)), n),
        _share(sum(map(str.__eq__, words, words[1:])), n - 1),
        _share(len(set(lines)), len(lines)),
        float(np.log1p(n / max(len(lines), 1))),
        _share(kinds[_BAR], n),
        _share(kinds[_BANG], n),
        _share(sum(w[0].isupper() for w in words), n),
    ]


@dataclass
class Model:
    """Scaling of the statistics, and by class: log share, mean and inverse Cholesky factor."""

    centre: np.ndarray
    scale: np.ndarray
    classes: dict[int, tuple[float, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def density(self, label: int, x: np.ndarray) -> np.ndarray:
        """Log share plus log density (without the constant that classes share) of rows ``x``."""
        share, mean, factor = self.classes[label]
        z = ((x - self.centre) / self.scale - mean) @ factor.T
        return share + np.log(np.diag(factor)).sum() - 0.5 * (z**2).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of rows ``x``; one class alone is certain, none is even."""
        if len(self.classes) < 2:
            return np.full(len(x), {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(self.classes)])
        difference = np.clip(self.density(1, x) - self.density(0, x), -500, 500)
        return np.round(1 / (1 + np.exp(-difference)), 9)


def solve(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """A model from each class's count, sums and sums of products."""
    size = len(STATISTICS)
    total = sum(n for n, _, _ in moments.values())
    if not total:
        return Model(np.zeros(size), np.ones(size))
    centre = sum(s for _, s, _ in moments.values()) / total
    spread = sum(np.diag(q) for _, _, q in moments.values()) / total - centre**2
    scale = np.sqrt(np.maximum(spread, 0)) + 1e-3
    means, within = {}, {}
    for label, (n, sums, products) in moments.items():
        mean = sums / n
        means[label] = (mean - centre) / scale
        within[label] = (products / n - np.outer(mean, mean)) / np.outer(scale, scale)
    shared = sum(moments[k][0] * within[k] for k in within) / total
    model = Model(centre, scale)
    for label, own in within.items():
        covariance = (1 - ridge) * ((1 - pooled) * own + pooled * shared) + ridge * np.eye(size)
        factor = np.linalg.inv(np.linalg.cholesky((covariance + covariance.T) / 2))
        model.classes[label] = (float(np.log(moments[label][0] / total)), means[label], factor)
    return model


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row's whole text, as a written table."""

    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return text.map(statistics)

    return materialize(docs.select("doc_id", vector(whole("text")).alias("x")), "statistics")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def fit(vectors: DataFrame, labels: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """Fit on all ``vectors`` (doc_id, x) that ``labels`` (doc_id, quality) marks 0 or 1.

    Rows whose crc32(doc_id) mod 4 is 2 are never learned from, nor are
    doc_ids whose labels disagree; null ids and labels are left out. Repeated
    rows count as often as they occur. The driver gets one sum for each class
    and pair of statistics.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
        .filter(F.col("quality") == F.col("most")).drop("most")
    )
    learned = vectors.filter(~_held_out())
    counts = learned.groupBy("doc_id").agg(F.count("*").alias("rows"))
    facts = materialize(counts.join(known, "doc_id"), "labelled")
    size = len(STATISTICS)

    def add(batches):
        sums = {}
        for frame in batches:
            for label, part in frame.groupby("quality"):
                x = np.array(part["x"].tolist(), np.float64)
                x = np.column_stack([np.ones(len(x)), x])
                sums[label] = sums.get(label, 0) + x.T @ x
        for label, matrix in sums.items():
            at, to = np.triu_indices(size + 1)
            yield pd.DataFrame({"quality": label, "a": at, "b": to, "value": matrix[at, to]})

    rows = attach(learned, facts, "doc_id", "rows").filter("quality is not null").select("x", "quality")
    cells = rows.mapInPandas(add, "quality int, a int, b int, value double").groupBy("quality", "a", "b")
    moments = {}
    for r in cells.agg(F.sum("value").alias("value")).collect():
        matrix = moments.setdefault(r["quality"], np.zeros((size + 1, size + 1)))
        matrix[r["a"], r["b"]] = matrix[r["b"], r["a"]] = r["value"]
    return solve({k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in sorted(moments.items())}, pooled, ridge)


def quality(vectors: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``vectors`` (doc_id, x).

    Scores come from the text's statistics alone; null texts count as empty and
    are scored like others. Null doc_ids count as held out. Repeated rows get
    equal rows, no rows give none, and other columns of the documents are not read.
    """

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), np.float64).reshape(len(x), -1)))

    return vectors.select("doc_id", _held_out().alias("held_out"), scored("x").alias("score")).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
