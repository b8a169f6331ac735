"""Tokens, pieces and packing: exact round trips and bounds."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from proofweave.llm import packing
from proofweave.llm.queries import tokenizer_path
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def plain_tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_cached_words_encode_like_whole_texts(plain_tokenizer):
    texts = [t or "" for _, t in ODD] + [
        "It's  a TEST,\nwith\ttabs and <|endoftext|> marks", "ΣΑΣ İstanbul é ́x",
        "a\x1cb \x85 c d", "$$$ idiot### 123 4.5e6 don't I'LL", " lead and trail \n", "日本語 テスト ﬁ",
    ]
    coder = packing.CachedTokenizer(tokenizer_path())
    got = [ids.tolist() for ids in coder.encode(texts)]
    assert got == [plain_tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_cache_changes_nothing(monkeypatch, plain_tokenizer):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    coder = packing.CachedTokenizer(tokenizer_path())
    for text in ("one two three four", "five six seven one", "one two"):
        assert next(coder.encode([text])).tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_rows(spark, odd, none, plain_tokenizer):
    rows = packing.pieces(odd, tokenizer_path(), with_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        assert r["length"] == len(r["ids"]) <= 4096
        if r["doc_id"] not in (None, 5):
            assert r["start"] == len(got.setdefault(r["doc_id"], []))
            got[r["doc_id"]] += r["ids"]
    for key, text in ODD:
        if key not in (None, 5):
            assert got[key] == plain_tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_bound_holds_and_is_met():
    rng = random.Random(7)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(1, 9))), reverse=True)

        def fewest(left, bins):
            if not left:
                return len(bins)
            best = 99
            for i in range(len(bins) + 1):
                if i == len(bins) or bins[i] + left[0] <= 32:
                    more = bins[:i] + [(bins + [0])[i] + left[0]] + bins[i + 1 :]
                    best = min(best, fewest(left[1:], more))
            return best

        least = fewest(sizes, [])
        bins, offsets, fill = packing.best_fit(np.array(sizes), 32)
        assert packing.lower_bound(np.array(sizes), 32) <= least <= len(fill)
        assert fill.max() <= 32 and fill.sum() == sum(sizes)
    assert packing.lower_bound(np.array([17] * 10), 32) == 10
    assert packing.lower_bound(np.array([11] * 10), 32) == 5


@pytest.mark.parametrize("per_partition", [100_000, 60])
def test_every_piece_is_placed_once_without_gaps(spark, per_partition):
    rng = random.Random(per_partition)
    rows = [(i, 0, 0, rng.choice([4096, rng.randrange(1, 4096), rng.randrange(1, 300)]), i) for i in range(900)]
    rows += [(None, 0, 0, 7, 1), (3, 0, 0, 9, 3)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(cut, per_partition=per_partition).collect()
    assert sorted((r[:5] for r in map(tuple, got)), key=str) == sorted(rows, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    bound = packing.lower_bound(np.array([r[3] for r in rows]))
    assert len(by) <= bound + (3 if per_partition > 900 else 8)


def test_exchange_goes_on_while_it_saves(spark, monkeypatch):
    """Rounds that save one sequence each, up to the sixth."""

    def saving(rows, n, parts, capacity):
        return rows.selectExpr(
            "*", f"({n}L << 48) + greatest(doc_id, {min(n, 6)}) as sequence_id", "0L as offset",
            "true as open", f"doc_id >= {min(n, 6)} as first", "false as certified",
        )

    monkeypatch.setattr(packing, "_pack_round", saving)
    rows = [(i, 0, 0, 5, i) for i in range(40)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(cut, per_partition=10).collect()
    assert sorted(tuple(r)[:5] for r in got) == rows and len({r["sequence_id"] for r in got}) == 34
