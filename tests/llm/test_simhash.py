"""Fingerprints and links against plain definitions."""

import random

import numpy as np
import pytest
import xxhash

from proofweave.llm import simhash
from tests.llm.conftest import LONG, ODD


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(fps, radius):
    """Least reachable index by checking all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_hash_of_slices_of_all_lengths():
    data = random.Random(3).randbytes(400)
    start = np.array([0, 5, 9, 0] + list(range(120)))
    end = np.array([0, 6, 200, 400] + [2 * i for i in range(120)])
    got = simhash.xxh64_slices(data, start, end)
    want = [xxhash.xxh64_intdigest(data[s:e], seed=42) for s, e in zip(start, end)]
    assert got.tolist() == want


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_fingerprints(block):
    rng = random.Random(1)
    texts = [t for _, t in ODD] + [
        " ".join(rng.choice(["Ab", "cd", "efgh", "longerwordhere" * 3, "É"]) for _ in range(rng.randrange(60)))
        for _ in range(40)
    ]
    got = simhash.fingerprints_of([(t or "").encode() for t in texts], block=block)
    assert [int(x) & (1 << 64) - 1 for x in got] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("parts,bucket", [(2, 48), (3, 48), (4, 4), (3, 1)])
def test_links_have_the_components_of_all_pairs(spark, parts, bucket):
    rng = random.Random(parts)
    fps = {0}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.add(base)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                base ^= 1 << b
    dense = rng.getrandbits(64)  # a crowd that shares most bits
    fps |= {dense ^ rng.getrandbits(9) << 3 for _ in range(60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.near_links(frame, len(fps), 2, parts, bucket).collect()
    at = {s: i for i, s in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        i, j = sorted((find(at[a]), find(at[b])))
        root[j] = i
    assert [find(i) for i in range(len(fps))] == plain_roots(fps, 2)


def test_thresholds_spend_the_whole_budget(spark):
    rng = random.Random(5)
    fps = np.array([rng.getrandbits(63) for _ in range(200)], dtype=np.int64)
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    for parts in (2, 3, 4):
        groups = simhash.bit_groups(frame, len(fps), parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        model = simhash.Estimator(groups, len(fps), 2).fit(frame)
        chosen = model.thresholds(fps)
        assert (chosen >= -1).all() and (chosen.sum(axis=1) == 2 - parts + 1).all()


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    fps = [plain_fingerprint(t) for _, t in ODD]
    roots = plain_roots(fps, 2)
    ids = {}
    for (key, _), r in zip(ODD, roots):
        if key is not None:
            ids[r] = min(key, ids.get(r, key))
    want = sorted(((k, f"{f:016x}", ids.get(r)) for (k, _), f, r in zip(ODD, fps, roots)), key=str)
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=str) == want
    assert simhash.near_duplicates(none).count() == 0


def test_majority_is_the_fingerprint_of_the_hashes():
    rng = random.Random(8)
    for n in (0, 1, 2, 9, 64):
        hashes = [rng.getrandbits(64) for _ in range(n)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
        assert simhash.majority(np.array(hashes, np.uint64)) % (1 << 64) == want


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:200] + [f"extra{i}"] + base[200:])) for i in range(300)]
    rows += [(1000 + i, " ".join(random.Random(i).choices(base, k=80))) for i in range(50)]
    got = {r[0]: r[2] for r in simhash.near_duplicates(spark.createDataFrame(rows, LONG)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_roots(fps, 2)
    assert got == {k: rows[r][0] for (k, _), r in zip(rows, roots)}
