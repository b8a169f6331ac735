"""Benchmark passages against every window of every document."""

import random
import re
from collections import Counter

from proofweave.llm import decontaminate
from tests.llm.conftest import LONG, ODD

ITEM = "item_id long, text string"


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words, k):
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def plain(docs, items):
    out = {}
    for doc_id, text in docs:
        words = words_of(text)
        for item_id, item in items:
            theirs = words_of(item)
            k = min(5, len(theirs))
            if not theirs or len(words) < k:
                continue
            want = shingles(theirs, k)
            for start in range(max(0, len(words) - len(theirs)) + 1):
                have = shingles(words[start : start + len(theirs)], k)
                sim = sum((want & have).values()) / max(1, sum((want | have).values()))
                if sim >= 0.8 and sim > out.get((doc_id, item_id), (0, 0))[0]:
                    out[doc_id, item_id] = (sim, start)
    return sorted(((d, i, s, round(v, 9)) for (d, i), (v, s) in out.items()), key=str)


def found(docs, items):
    rows = decontaminate.contaminated(docs, items).collect()
    return sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in rows), key=str)


def test_edited_passages(spark):
    rng = random.Random(2)
    names = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(names, k=rng.randrange(15, 70)))) for i in range(12)]
    items += [(50, "short one here"), (51, ""), (52, None), (53, items[0][1]), (54, "a b a b a b a b a b a b")]
    docs = list(ODD) + [(70, items[3][1]), (71, "A, b a! b a b\na b a b a b"), (72, "this short ONE here")]
    for i in range(100, 220):
        passage = words_of(items[rng.randrange(12)][1])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(passage))
            passage = rng.choice([passage[:at] + passage[at + 1 :], passage[:at] + ["new"] + passage[at:], passage])
        around = rng.choices(names, k=rng.randrange(90))
        cut = rng.randrange(len(around) + 1)
        docs.append((i, " ".join(around[:cut] + passage + around[cut:]).upper()))
    want = plain(docs, items)
    got = found(spark.createDataFrame(docs, LONG), spark.createDataFrame(items, ITEM))
    assert len(want) > 60 and got == want


def test_neighbours_within_the_radius(spark):
    rng = random.Random(4)
    items = [(i, rng.getrandbits(63)) for i in range(20)]
    fps = set()
    for _, fp in items:
        for flips in (0, 5, 15, 19, 19, 19, 20, 25):
            fps.add(fp ^ sum(1 << b for b in rng.sample(range(63), flips)))
    got = decontaminate._within_radius(
        spark.createDataFrame([(f,) for f in fps], "fp long"),
        spark.createDataFrame(items, "item long, fp long"),
    ).collect()
    want = {(f, i, (f ^ x).bit_count()) for f in fps for i, x in items if (f ^ x).bit_count() <= 19}
    assert {tuple(r) for r in got} == want


def test_no_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six seven")], ITEM)
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_drop_keeps_columns_and_clean_rows(spark, odd):
    items = spark.createDataFrame([(1, "same words here now"), (2, "alone here with no id at all")], ITEM)
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 7, 8, 9] and ids.count(None) == 2


def test_earliest_of_equal_windows(spark):
    item = [f"i{n}" for n in range(30)]
    docs = [(1, " ".join(["x1", "x2", *item[:29], "y1", "y2", "y3"]))]
    docs.append((2, " ".join([f"z{n}" for n in range(90)] + item + [f"v{n}" for n in range(90)] + item[:28] + ["u", "u"])))
    docs.append((3, " ".join(["q"] * 7 + item[:28] + item[29:])))
    items = [(7, " ".join(item))]
    want = plain(docs, items)
    assert want[0][:3] == (1, 7, 1)
    assert found(spark.createDataFrame(docs, LONG), spark.createDataFrame(items, ITEM)) == want


def test_no_radius_loses_short_passages(spark):
    """Items of 13 words, 9 shingles, one of them lost: similarity 0.8, the least that passes."""
    rng = random.Random(12)
    items = [(i, [f"w{rng.randrange(10**6)}" for _ in range(13)]) for i in range(1500)]
    docs = [(i, " ".join(words[:12] + ["other"])) for i, words in items]
    items = [(i, " ".join(words)) for i, words in items]
    got = found(spark.createDataFrame(docs, LONG), spark.createDataFrame(items, ITEM))
    assert sorted(r[0] for r in got) == list(range(1500))
