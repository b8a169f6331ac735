"""Exact duplicates against grouping in plain Python."""

import re

from pyspark.sql import functions as F

from proofweave.llm import exact_dedup
from tests.llm.conftest import LONG, ODD


def plain(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((key, len(text or "")))
    out = []
    for members in groups.values():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(key, best, len(members), key == best) for key, _ in members]
    return sorted(out, key=str)


def decided(frame):
    return sorted(((r[0], r[1], r[2], r[3]) for r in frame.collect()), key=str)


def test_groups_of_odd_rows(spark, odd, none):
    assert decided(exact_dedup.duplicate_groups(odd)) == plain(ODD)
    assert exact_dedup.duplicate_groups(none).count() == 0


def test_equal_digests_never_merge_texts(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)]
    frame = spark.createDataFrame(rows, LONG)
    weak = exact_dedup.duplicate_groups(frame, 4, lambda t: F.substring(t, 1, 2))
    assert decided(weak) == plain(rows)


def test_hot_group_beside_single_texts(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    assert decided(exact_dedup.duplicate_groups(spark.createDataFrame(rows, LONG))) == plain(rows)


def test_drop_keeps_one_row_a_group(spark, odd):
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 5 is the longer text of its group; its repeated row is one.
    assert sorted(i for i in ids if i is not None) == [3, 5, 7, 8, 9] and ids.count(None) == 1
