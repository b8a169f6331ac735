"""Best chunks of a block of questions by terms, without a row for each pair.

A group holds a block of a tenant's attempts and meets the tenant's chunks as a
stream of tiles. Attempts with the same terms and principals are one ask. In a
tile, the chunks that hold an ask's anchor are its candidates; access is decided
on them, then the other terms are looked up, and only what holds all of them is
scored. The best ``limit`` of each ask so far are all that is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from proofweave.operators.blocks import principal_sets, shared_sets, tiles

CHUNKS_PER_TILE = 2048
# Candidate pairs, or occurrences of their terms, that are looked at together.
PAIRS_PER_SLICE = 500_000
ATTEMPTS_PER_OUTPUT = 1024

SCHEMA = pa.schema(
    [
        ("question_id", pa.string()),
        ("form", pa.string()),
        ("chunk_id", pa.string()),
        ("score", pa.float64()),
        ("lex_rank", pa.int32()),
    ]
)


def _spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` items of every row: its row, and its number in that row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _cuts(counts: np.ndarray, size: int) -> list[slice]:
    """Slices of rows whose ``counts`` add up to about ``size`` each."""
    if not len(counts):
        return []
    part = np.cumsum(counts) // size
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1)]
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], len(part)], strict=True)]


def scaled(scores: np.ndarray, decimals: int) -> np.ndarray:
    """Scores as whole numbers of the last decimal, halves up as Spark's ``round`` has them."""
    units = scores * 10**decimals
    out = np.floor(units + 0.5).astype(np.int64)
    step = Decimal(1).scaleb(-decimals)
    for at in np.flatnonzero(np.abs(units - np.floor(units) - 0.5) < 1e-3):
        exact = Decimal(repr(float(scores[at]))).quantize(step, ROUND_HALF_UP)
        out[at] = int(exact.scaleb(decimals))
    return out


class _Asks:
    """Distinct (terms, principals) among a block's attempts, sorted by anchor."""

    def __init__(self, attempts: pa.Table):
        set_row, self.sets = principal_sets(attempts["principals"])
        texts = attempts["written"].combine_chunks().dictionary_encode()
        pair = texts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(self.sets) + set_row
        distinct, self.of_attempt = np.unique(pair, return_inverse=True)
        lists = pc.split_pattern(texts.dictionary, " ")
        flat = lists.flatten().dictionary_encode()
        self.vocabulary = flat.dictionary
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        text = distinct // len(self.sets)
        order = np.argsort(codes[offsets[text]], kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.of_attempt = place[self.of_attempt]
        text = text[order]
        self.set_row = distinct[order] % len(self.sets)
        self.codes, self.first = codes, offsets[text]
        self.size = offsets[text + 1] - offsets[text]
        anchors = codes[self.first]  # the anchor is written first
        self.with_anchor = np.bincount(anchors, minlength=len(self.vocabulary))
        self.first_with = np.searchsorted(anchors, np.arange(len(self.vocabulary)))


class _Tile:
    """Positions of the asked terms in a tile of chunks, by (chunk, term)."""

    def __init__(self, tile: pa.Table, vocabulary: pa.Array):
        lists = pc.split_pattern(tile["written"].combine_chunks(), " ")
        places = tile["places"].combine_chunks()
        counts = places.value_lengths().to_numpy(zero_copy_only=False)
        # A chunk without terms is written as one empty word.
        full = pa.array(counts > 0)
        flat = lists.filter(full).flatten()
        row = np.repeat(np.arange(len(counts)), counts)
        code = pc.fill_null(pc.index_in(flat, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        position = places.filter(full).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        asked = code >= 0
        self.terms = len(vocabulary)
        key = row[asked] * self.terms + code[asked]
        order = np.argsort(key, kind="stable")
        self.position = position[asked][order]
        self.key, self.start, self.count = np.unique(key[order], return_index=True, return_counts=True)

    def find(self, row: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Place of each (chunk, term), or -1."""
        wanted = row * self.terms + code
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, at, -1)


def _covers(tile: _Tile, asks: _Asks, ask: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Cover density of pairs, as ``lexical.covers`` has it; pairs have most terms first."""
    size = asks.size[ask]
    pair, slot = _spans(size)
    at = tile.find(row[pair], asks.codes[asks.first[ask][pair] + slot])
    entry, number = _spans(tile.count[at])
    pair, slot = pair[entry], slot[entry]
    position = tile.position[tile.start[at][entry] + number]
    order = np.lexsort((position, pair))
    pair, slot, position = pair[order], slot[order], position[order]
    index = np.arange(len(pair))
    begin = np.searchsorted(pair, pair)
    start = index.copy()
    for k in range(int(size.max())):
        held = np.searchsorted(-size, -k, side="left")  # pairs of more than k terms
        upto = np.searchsorted(pair, held)
        last = np.maximum.accumulate(np.where(slot[:upto] == k, index[:upto], -1))
        start[:upto] = np.minimum(start[:upto], last)
    start = np.where(start >= begin, start, -1)
    before = np.append(-1, start[:-1])
    minimal = (start >= 0) & ((start > before) | (index == begin))
    end, first = index[minimal], start[minimal]
    weight = 1.0 / (2.0 + position[end] - position[first] - (end - first + 1))
    return np.bincount(pair[minimal], weights=weight, minlength=len(ask))


def _scores(tile: _Tile, asks: _Asks, pairs: tuple[np.ndarray, ...]) -> np.ndarray:
    ask, row, found, low, high = pairs
    size = asks.size[ask]
    with np.errstate(divide="ignore"):
        score = np.where(size == 1, found, 1.0 / (2.0 + high - low - found))
    open_ = np.flatnonzero((size > 1) & (found != size))
    open_ = open_[np.argsort(-size[open_], kind="stable")]
    for part in _cuts(found[open_] + size[open_], PAIRS_PER_SLICE):
        chosen = open_[part]
        score[chosen] = _covers(tile, asks, ask[chosen], row[chosen])
    return score


def _matches(tile: _Tile, asks: _Asks, shared: np.ndarray, owned: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Slices of the (ask, chunk) that may be seen and hold all terms: also occurrences, first, last."""
    code, chunk = tile.key % tile.terms, tile.key // tile.terms
    anchored = np.flatnonzero(asks.with_anchor[code])
    wide = asks.with_anchor[code[anchored]]
    for part in _cuts(wide, PAIRS_PER_SLICE):
        entry, number = _spans(wide[part])
        at = anchored[part][entry]
        ask, row = asks.first_with[code[at]] + number, chunk[at]
        seen = shared[asks.set_row[ask], owned[row]]
        ask, row, at = ask[seen], row[seen], at[seen]
        found, low = tile.count[at], tile.position[tile.start[at]]
        high = tile.position[tile.start[at] + found - 1]
        whole = []
        k = 1
        while len(ask):
            done = asks.size[ask] == k
            whole.append([v[done] for v in (ask, row, found, low, high)])
            ask, row, found, low, high = (v[~done] for v in (ask, row, found, low, high))
            at = tile.find(row, asks.codes[asks.first[ask] + k])
            held = at >= 0
            ask, row, found, low, high, at = (v[held] for v in (ask, row, found, low, high, at))
            first = tile.start[at]
            low = np.minimum(low, tile.position[first])
            high = np.maximum(high, tile.position[first + tile.count[at] - 1])
            found = found + tile.count[at]
            k += 1
        if whole:
            yield tuple(np.concatenate(v) for v in zip(*whole, strict=True))


class _Best:
    """The best ``limit`` chunks of each ask, as they come in the order of their ids."""

    def __init__(self, asks: int, limit: int):
        self.limit = limit
        self.least = np.full(asks, -1, dtype=np.int64)
        self.ask, self.score, self.number = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, ask: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        # A later chunk of an equal score loses to those that are held.
        better = score > self.least[ask]
        self.waiting.append((ask[better], score[better], number[better]))
        self.count += len(self.waiting[-1][0])
        if self.count >= max(PAIRS_PER_SLICE, len(self.ask) // 2):
            self.settle()

    def settle(self) -> None:
        held = [(self.ask, self.score, self.number), *self.waiting]
        ask, score, number = (np.concatenate(part) for part in zip(*held, strict=True))
        self.waiting, self.count = [], 0
        order = np.lexsort((number, -score, ask))
        ask, score, number = ask[order], score[order], number[order]
        place = np.arange(len(ask)) - np.searchsorted(ask, ask)
        best = place < self.limit
        self.ask, self.score, self.number = ask[best], score[best], number[best]
        last = place[best] == self.limit - 1
        self.least[self.ask[last]] = self.score[last]


def block_lists(limit: int, decimals: int):
    """Arrow function of one group: attempts first, then the chunks by id."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = tiles(batches, CHUNKS_PER_TILE)
        attempts = next(parts, None)
        if attempts is None or attempts.num_rows == 0:
            for _ in parts:  # a block without questions
                pass
            return
        asks = _Asks(attempts)
        best = _Best(len(asks.size), limit)
        names, before = [], 0
        for part in parts:
            owned, sets = principal_sets(part["principals"])
            shared = shared_sets(asks.sets, sets)
            tile = _Tile(part, asks.vocabulary)
            if len(tile.key):
                for found in _matches(tile, asks, shared, owned):
                    score = scaled(_scores(tile, asks, found), decimals)
                    best.add(found[0], score, found[1] + before)
            names.append(part["row_id"].combine_chunks())
            before += part.num_rows
        best.settle()
        if not len(best.ask):
            return
        names = pa.chunked_array(names)
        first = np.searchsorted(best.ask, np.arange(len(asks.size) + 1))
        for at in range(0, len(asks.of_attempt), ATTEMPTS_PER_OUTPUT):
            ask = asks.of_attempt[at : at + ATTEMPTS_PER_OUTPUT]
            row, place = _spans(first[ask + 1] - first[ask])
            chosen = first[ask][row] + place
            asking = pa.array(row + at)
            listed = pa.table(
                {
                    "question_id": attempts["row_id"].take(asking),
                    "form": attempts["form"].take(asking),
                    "chunk_id": names.take(pa.array(best.number[chosen])),
                    "score": pa.array(best.score[chosen] / 10.0**decimals),
                    "lex_rank": pa.array(place + 1, pa.int32()),
                },
                schema=SCHEMA,
            )
            yield from listed.combine_chunks().to_batches()

    return rank
