"""Hard negatives: other-label vectors that score just below a positive.

Each vector is cut into segments, at three levels of ever shorter ones. A
segment is summarised by its mean and its deviation (the length of what the
mean leaves over). For two segments of w components the inner product is
w * mean * mean, plus or minus at most deviation * deviation; summed over the
segments of a level this bounds the score. Pairs that cannot reach an asked
interval are dropped level by level, and only the others are scored exactly.

Anchors meet all rows in blocks: a task takes a block of anchors and a block of
rows and returns a bounded list an anchor. Lists merge exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from proofweave.operators.sizing import materialize

#: Segments at each level.
SEGMENTS = (1, 4, 16)
#: Most anchors and rows of a task, and the rows that it scores at a time.
ANCHOR_BLOCK = 8192
ROW_BLOCK = 8192
CHUNK = 512
#: Squared lengths from here on could overflow a long product.
LONGEST = 2.0**62


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, units), one row per vec_id; units are floor(scale * component).

    Rows with a null vec_id, label, vector or component, with a component that
    is not finite, or whose units' squares sum to 2^62 or more are left out. Of
    rows with one vec_id the one with the least (label, units) stays.
    """
    embedding = F.col("embedding")
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    units = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & embedding.isNotNull() & ~bad)
    # Checked before floor: a larger product would not fit a long.
    length = F.aggregate(embedding, F.lit(0.0), lambda a, x: a + (x.cast("double") * scale) * (x.cast("double") * scale))
    kept = whole.filter(length < LONGEST).select("vec_id", "label", units.alias("units"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "units")).alias("held")).select("vec_id", "held.*")


def summaries(units: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means times root of width, deviations) of the segments of each level, by row."""
    out = []
    for parts in SEGMENTS:
        width = max(-(-units.shape[1] // parts), 1)
        padded = np.zeros((len(units), parts * width))
        padded[:, : units.shape[1]] = units
        cut = padded.reshape(len(units), parts, width)
        mean = cut.mean(axis=2)
        deviation = np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2))
        out.append((mean * np.sqrt(width), deviation))
    return out


class Vectors:
    """A block of vectors with the summaries of their segments."""

    def __init__(self, frame: pd.DataFrame, width: int):
        self.ids = frame["vec_id"].to_numpy(np.int64)
        self.raw = frame["label"].to_numpy()
        self.units = np.zeros((len(frame), width), np.int64)
        for i, row in enumerate(frame["units"]):
            self.units[i, : len(row)] = row
        self.floats = self.units.astype(np.float64)
        self.levels = []
        for level in range(len(SEGMENTS)):
            mean = np.array(frame[f"mean{level}"].tolist(), np.float64).reshape(len(frame), SEGMENTS[level])
            deviation = np.array(frame[f"deviation{level}"].tolist(), np.float64).reshape(len(frame), SEGMENTS[level])
            self.levels.append((mean, deviation))
        self.length = float(np.sqrt((self.floats**2).sum(axis=1)).max(initial=0))


def alike(anchors: Vectors, rows: Vectors, at: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray):
    """Pairs (anchor, row, exact score) of ``allowed`` whose score may lie in [low, high] of the anchor.

    ``at`` picks the rows, ``allowed`` is a matrix of anchors by picked rows.
    Levels of summaries drop pairs first; a pair whose score is in the interval
    is never dropped, as the bounds carry a margin for rounding.
    """
    slack = 1e-9 * (anchors.length * rows.length + 1)
    left, right = np.nonzero(allowed)
    dense = len(left) * 8 > allowed.size
    for (mean_a, dev_a), (mean_r, dev_r) in zip(anchors.levels, rows.levels):
        if dense:
            centre = mean_a @ mean_r[at].T
            spread = dev_a @ dev_r[at].T + slack
            allowed = allowed & (centre + spread >= low[:, None]) & (centre - spread <= high[:, None])
            left, right = np.nonzero(allowed)
            dense = len(left) * 8 > allowed.size
        elif len(left):
            centre = np.einsum("ij,ij->i", mean_a[left], mean_r[at[right]])
            spread = np.einsum("ij,ij->i", dev_a[left], dev_r[at[right]]) + slack
            keep = (centre + spread >= low[left]) & (centre - spread <= high[left])
            left, right = left[keep], right[keep]
    if anchors.length * rows.length < 2.0**52:  # every partial sum is a whole number that a double holds
        if dense:
            scores = (anchors.floats @ rows.floats[at].T)[left, right]
        else:
            scores = np.einsum("ij,ij->i", anchors.floats[left], rows.floats[at[right]])
        scores = np.rint(scores).astype(np.int64)
    else:
        scores = np.zeros(len(left), np.int64)
        for s in range(0, len(left), 65_536):
            t = slice(s, s + 65_536)
            scores[t] = (anchors.units[left[t]] * rows.units[at[right[t]]]).sum(axis=1)
    inside = (scores >= low[left]) & (scores <= high[left])
    return left[inside], right[inside], scores[inside]


class Best:
    """The first ``most`` (score descending, id ascending) of each key seen so far."""

    def __init__(self, keys: int, most: int):
        self.most = most
        self.least = np.full(keys, -np.inf)  # score that a new entry must reach
        self.key = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        take = score >= self.least[key]
        if not take.any():
            return
        key = np.concatenate([self.key, key[take]])
        score = np.concatenate([self.score, score[take]])
        ident = np.concatenate([self.id, ident[take]])
        order = np.lexsort((ident, -score, key))
        key, score, ident = key[order], score[order], ident[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.most
        full = place == self.most - 1
        self.least[key[full]] = score[full]
        self.key, self.score, self.id = key[keep], score[keep], ident[keep]


def _first_positives(anchors: Vectors, rows: Vectors, most: int) -> Best:
    best = Best(len(anchors.ids), most)
    high = np.full(len(anchors.ids), np.inf)
    by_label = pd.Series(np.arange(len(rows.ids))).groupby(rows.raw).indices
    for label, mine in pd.Series(np.arange(len(anchors.ids))).groupby(anchors.raw).indices.items():
        held = by_label.get(label, np.zeros(0, np.int64))
        part = _picked(anchors, mine)
        for s in range(0, len(held), CHUNK):
            at = held[s : s + CHUNK]
            other = part.ids[:, None] != rows.ids[at][None, :]
            left, right, score = alike(part, rows, at, best.least[mine], high[mine], other)
            best.add(mine[left], score, rows.ids[at[right]])
    return best


def _first_negatives(
    anchors: Vectors, scores: np.ndarray, known: np.ndarray, rows: Vectors, most: int, low: int, high: int
) -> Best:
    """``scores`` of positives by anchor; ``known`` marks the places that are filled."""
    width = scores.shape[1]
    best = Best(len(anchors.ids) * width, most)
    # The interval to search, with a margin for rounding; _within decides.
    margin = 1e-9 * np.abs(scores.astype(np.float64)) + 1e-6
    bottom, top = scores * (low / 100) - margin, scores * (high / 100) + margin
    _, codes = np.unique(np.concatenate([anchors.raw, rows.raw]), return_inverse=True)
    mine, theirs = codes[: len(anchors.raw)], codes[len(anchors.raw) :]
    live = known & (bottom <= top)
    ceiling = np.where(live, top, -np.inf).max(axis=1, initial=-np.inf)
    slots = np.arange(len(anchors.ids) * width).reshape(-1, width)
    for s in range(0, len(rows.ids), CHUNK):
        at = np.arange(s, min(s + CHUNK, len(rows.ids)))
        needed = np.where(live, np.maximum(bottom, best.least[slots]), np.inf)
        floor = needed.min(axis=1, initial=np.inf)
        left, right, score = alike(anchors, rows, at, floor, ceiling, mine[:, None] != theirs[at][None, :])
        for j in range(width):
            positive = scores[left, j]
            fits = live[left, j]
            fits[fits] = _within(positive[fits], score[fits], low, high)
            best.add(slots[left[fits], j], score[fits], rows.ids[at[right[fits]]])
    return best


def _within(positive: np.ndarray, score: np.ndarray, low: int, high: int) -> np.ndarray:
    """low * positive <= 100 * score <= high * positive, without overflow of a long."""
    if max(np.abs(positive).max(initial=0), np.abs(score).max(initial=0)) < 2**55:
        return (low * positive <= 100 * score) & (100 * score <= high * positive)
    return np.array([low * p <= 100 * s <= high * p for p, s in zip(positive.tolist(), score.tolist())], bool)


def _picked(vectors: Vectors, at: np.ndarray) -> Vectors:
    out = object.__new__(Vectors)
    out.ids, out.raw = vectors.ids[at], vectors.raw[at]
    out.units, out.floats, out.length = vectors.units[at], vectors.floats[at], vectors.length
    out.levels = [(m[at], d[at]) for m, d in vectors.levels]
    return out


def _width(*frames: pd.DataFrame) -> int:
    return max((len(u) for f in frames for u in f["units"]), default=0)


_ENTRY = "anchor_id long, positive int, id long, score long"


def _blocks(best: Best, ids: np.ndarray, width: int) -> pd.DataFrame:
    return pd.DataFrame(
        {"anchor_id": ids[best.key // width], "positive": best.key % width, "id": best.id, "score": best.score}
    )


def _merged(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are ``usable`` ones (vec_id, label, units); anchors are those that
    ``anchor`` holds for. Scores are exact inner products of units; shorter
    vectors count as filled up with zeros. An anchor's positives are its first
    ``positives`` other rows of the same label, by score, then least vec_id; for
    each, the first ``negatives`` rows of other labels are returned that have
    low * positive_score <= 100 * negative_score <= high * positive_score. A
    positive without such rows gives none. No rows or no anchors give none.
    """
    if min(positives, negatives) < 1 or not 0 <= low <= high:
        raise ValueError("positives and negatives must be 1 or more, and 0 <= low <= high")
    spark = rows.sparkSession

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            width = _width(frame)
            units = np.zeros((len(frame), width))
            for i, row in enumerate(frame["units"]):
                units[i, : len(row)] = row
            for level, (mean, deviation) in enumerate(summaries(units)):
                frame[f"mean{level}"] = list(mean)
                frame[f"deviation{level}"] = list(deviation)
            yield frame

    widest = rows.agg(F.max(F.size("units")), F.count("*")).first()
    width, total = max(widest[0] or 0, 1), widest[1]
    padded = F.concat("units", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("units")))
    kind = rows.schema["label"].dataType.simpleString()
    extra = ", ".join(f"mean{i} array<double>, deviation{i} array<double>" for i in range(len(SEGMENTS)))
    told = rows.select("vec_id", "label", padded.alias("units"), anchor.alias("asks")).mapInPandas(
        describe, f"vec_id long, label {kind}, units array<long>, asks boolean, {extra}"
    )
    told = materialize(told, "summaries")
    # Columns of their own, as both sides of a cogroup come from one table.
    anchors = told.filter("asks").drop("asks").toDF(*told.drop("asks").columns)
    n_anchors = anchors.count()
    cores = spark.sparkContext.defaultParallelism
    row_blocks = max(-(-total // ROW_BLOCK), min(2 * cores, -(-total // CHUNK)), 1)
    anchor_blocks = max(-(-n_anchors // ANCHOR_BLOCK), 1)

    def dealt(frame: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
        return frame.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    keys = ("row_block", "anchor_block")
    nothing = pd.DataFrame({"anchor_id": [], "positive": [], "id": [], "score": []}).astype("int64")
    spread_rows = dealt(told.drop("asks"), "row_block", row_blocks, "anchor_block", anchor_blocks)

    def asked(frame: DataFrame) -> DataFrame:
        return dealt(frame, "anchor_block", anchor_blocks, "row_block", row_blocks).groupBy(*keys)

    def seek_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return nothing
        a = Vectors(left, width)
        return _blocks(_first_positives(a, Vectors(right, width), positives), a.ids, 1)

    found = asked(anchors).cogroup(spread_rows.groupBy(*keys)).applyInPandas(seek_positives, _ENTRY)
    firsts = materialize(_merged(found, positives).select("anchor_id", "rank", "id", "score"), "positives")
    listed = firsts.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("held"))
    with_scores = (
        anchors.join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
        .withColumn("scores", F.transform("held", lambda x: x["score"])).drop("held")
    )

    def seek_negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return nothing
        a = Vectors(left, width)
        scores, known = np.zeros((len(left), positives), np.int64), np.zeros((len(left), positives), bool)
        for i, row in enumerate(left["scores"]):
            scores[i, : len(row)], known[i, : len(row)] = row, True
        best = _first_negatives(a, scores, known, Vectors(right, width), negatives, low, high)
        return _blocks(best, a.ids, positives)

    mined = asked(with_scores).cogroup(spread_rows.groupBy(*keys)).applyInPandas(seek_negatives, _ENTRY)
    ranked = _merged(mined, negatives).withColumn("place", F.col("positive") + 1)
    chosen = firsts.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(chosen, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
