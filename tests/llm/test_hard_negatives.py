import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every, positives=5, negatives=3, low=50, high=95, scale=256):
    """All pairs, in whole numbers."""
    usable = {}
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if sum((x * scale) * (x * scale) for x in vector) >= 2**62:
            continue
        entry = (label, [math.floor(x * scale) for x in vector])
        usable[vec_id] = min(usable.get(vec_id, entry), entry)
    out = []
    for a, (label, u) in usable.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(u, v)), b, own == label) for b, (own, v) in usable.items() if b != a]
        for p, pid in sorted((s, b) for s, b, same in scored if same)[:positives]:
            fits = sorted((s, b) for s, b, same in scored if not same and low * -p <= 100 * -s <= high * -p)
            out += [(a, pid, i + 1, b, -p, -s) for i, (s, b) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, every, **more):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(hn.usable(frame), F.col("vec_id") % every == 0, **more).collect())


def vectors(seed, n, width, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    kind = rng.integers(labels, size=n)
    points = centres[kind] + rng.normal(size=(n, width))
    points[n // 2 : n // 2 + n // 8] = points[n // 2]  # ties
    return [(i, [float(x) for x in p], int(k)) for i, (p, k) in enumerate(zip(points, kind))]


@pytest.mark.parametrize("width,labels", [(1, 2), (7, 3), (64, 4)])
def test_against_all_pairs(spark, width, labels):
    rows = vectors(width, 400, width, labels)
    want = plain(rows, 10)
    assert want and mined(spark, rows, 10) == want


def test_blocks_do_not_change_results(spark, monkeypatch):
    rows = vectors(3, 300, 16, 3)
    monkeypatch.setattr(hn, "ROW_BLOCK", 40)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 25)
    monkeypatch.setattr(hn, "CHUNK", 16)
    assert mined(spark, rows, 3, positives=4, negatives=2, low=10, high=80) == plain(rows, 3, 4, 2, 10, 80)


def test_bounds_hold_and_drop_pairs():
    rng = np.random.default_rng(0)
    # Vectors with long constant stretches: summaries say almost everything.
    units = np.repeat(rng.integers(-200, 200, size=(300, 16)), 4, axis=1) + rng.integers(-2, 3, size=(300, 64))
    frame = pd.DataFrame({"vec_id": np.arange(300), "label": 0, "units": list(units)})
    for i, (mean, deviation) in enumerate(hn.summaries(units)):
        frame[f"mean{i}"], frame[f"deviation{i}"] = list(mean), list(deviation)
    v = hn.Vectors(frame, 64)
    exact = units @ units.T
    for mean, deviation in v.levels:
        centre, spread = mean @ mean.T, deviation @ deviation.T + 1e-3
        assert (exact <= centre + spread).all() and (exact >= centre - spread).all()
    widths = [float((d @ d.T).mean()) for _, d in v.levels]
    assert widths[2] < widths[1] < widths[0] and widths[2] < 0.01 * widths[0]
    low, high = np.full(300, 200_000.0), np.full(300, 500_000.0)
    left, right, score = hn.alike(v, v, np.arange(300), low, high, np.ones((300, 300), bool))
    want = np.nonzero((exact >= 200_000) & (exact <= 500_000))
    assert (left == want[0]).all() and (right == want[1]).all() and (score == exact[want]).all()


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], i % 2) for i in range(40)]
    rows += [
        (100, None, 1), (102, [0.5] * 6, None), (104, [0.5, None, 0.1, 0.1, 0.1, 0.1], 0), (106, [float("nan")] * 6, 0),
        (108, [float("inf")] * 6, 0), (110, [], 1), (112, [0.9], 0), (114, [1e200] * 6, 0), (None, [0.3] * 6, 0),
        (116, [3e6] * 6, 0), (118, [3e6] * 5 + [1e6], 1), (118, [3e6] * 5 + [1e6], 1), (3, [0.1] * 6, 0),
    ]
    assert mined(spark, rows, 2) == plain(rows, 2)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("units", F.lit("x")).withColumn("rank", F.lit(1))
    assert len(hn.hard_negatives(hn.usable(frame), F.col("vec_id") % 2 == 0).collect()) == len(plain(rows, 2))
    assert mined(spark, rows[:0], 2) == [] and mined(spark, rows[1:2], 2) == []
    with pytest.raises(ValueError):
        hn.hard_negatives(hn.usable(frame), F.lit(True), negatives=0)
