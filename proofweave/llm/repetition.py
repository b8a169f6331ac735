"""Periodic runs of words, found by catchers over completed blocks.

A sequence of words grows at its end. Whenever a block of 1, 2, 4, ... words is
complete, a catcher waits for the block to come again: a block of B words that
returns p words later, 2 B <= p < 4 B, lies in a square of period p as soon as
the words around both copies agree over p words. Every stretch of at least p
equal pairs holds a complete block, so no square is missed. Each appended word
completes one window of every size, and that window meets the two blocks at
allowed distance: an append costs a comparison or two for each size.

Windows are compared by 64-bit hashes. Hashes only choose where to look: the
words themselves decide where a run starts and ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proofweave.llm.common import whole

EXPONENT = 4
SHORTEST = 6
#: Words taken in one append: bounds the comparison arrays.
PIECE = 1 << 18
#: Bytes of text whose documents share one sequence.
GROUP_BYTES = 2_000_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(values: np.ndarray) -> np.ndarray:
    out = values * _ODD[0]
    out ^= out >> np.uint64(29)
    out *= _ODD[1]
    out ^= out >> np.uint64(32)
    return out


class _Level:
    """Catchers of one block size."""

    def __init__(self, size: int, distances: tuple[int, ...], exponent: int, shortest: int):
        self.size = size
        self.done = 0  # windows hashed so far
        self.blocks = np.zeros(0, np.uint64)
        # (distance in blocks, blocks in a row that a run must match, first open window, matches)
        self.waiting = []
        for d in distances:
            equal = max((exponent - 1) * d * size, shortest - d * size)
            self.waiting.append([d, max((equal - size + 1) // size, 1), 0, np.zeros(0, bool)])
        self.caught: list[np.ndarray] = []

    def advance(self, windows: np.ndarray) -> int:
        """Take the hashes of newly completed windows; returns the chains caught."""
        low, size = self.done, self.size
        self.done += len(windows)
        self.blocks = np.concatenate([self.blocks, windows[(-low) % size :: size]])
        at = np.arange(low, self.done)
        block, found = at // size, 0
        for waiting in self.waiting:
            d, need, first, matched = waiting
            here = block >= d
            equal = np.zeros(len(at), bool)
            equal[here] = windows[here] == self.blocks[block[here] - d]
            matched = np.concatenate([matched, equal])
            rows = len(matched) - (need - 1) * size
            if rows > 0:
                chained = matched[:rows].copy()
                for t in range(1, need):
                    chained &= matched[t * size : t * size + rows]
                found += self._keep(np.flatnonzero(chained) + first, d, need)
                waiting[2], matched = first + rows, matched[rows:]
            waiting[3] = matched
        return found

    def _keep(self, at: np.ndarray, d: int, need: int) -> int:
        """Store the (period, first copy's start, end) of chained block matches."""
        if not len(at):
            return 0
        size, rest = self.size, at % self.size
        order = np.lexsort((at, rest))
        at, rest = at[order], rest[order]
        new = np.flatnonzero((np.diff(at) != size) | (np.diff(rest) != 0)) + 1
        heads, tails = at[np.append(0, new)], at[np.append(new - 1, len(at) - 1)]
        period = heads % size + d * size
        self.caught.append(np.stack([period, heads - period, tails + need * size]))
        return len(heads)


class SquareCatchers:
    """Runs of a growing word sequence of exponent ``exponent`` or more.

    ``longest`` bounds the length of any run (the longest document, when
    several share a sequence); the periods looked for follow from it.
    """

    def __init__(self, longest: int, exponent: int = EXPONENT, shortest: int = SHORTEST):
        if exponent < 2:
            raise ValueError("exponent must be 2 or more: a run holds a square")
        self.exponent, self.shortest = exponent, shortest
        self.words: list[np.ndarray] = []
        self.levels, size = [], 1
        while size == 1 or 2 * size * exponent <= longest:
            self.levels.append(_Level(size, (1, 2, 3) if size == 1 else (2, 3), exponent, shortest))
            size *= 2
        self._held = [np.zeros(0, np.uint64) for _ in self.levels]

    def append(self, words: np.ndarray) -> int:
        """Take more words (64-bit ids); returns how many chains of squares they caught."""
        found = 0
        for at in range(0, len(words), PIECE):
            piece = words[at : at + PIECE]
            self.words.append(piece)
            windows = _mixed(piece.astype(np.int64).view(np.uint64) + np.uint64(1))
            for i, level in enumerate(self.levels):
                found += level.advance(windows)
                # Windows of twice the size, each from two that lie side by side.
                held = np.concatenate([self._held[i], windows])
                rows = max(len(held) - level.size, 0)
                windows = _mixed(held[:rows] * _ODD[1] + held[level.size :][:rows])
                self._held[i] = held[rows:]
        return found

    def runs(self) -> np.ndarray:
        """Rows (start, end, period) of all runs so far, by start, then period."""
        words = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        known = np.zeros((0, 3), np.int64)
        least: dict[tuple[int, int], int] = {}  # smallest period by (start, end): periods ascend
        for level in self.levels:
            if not level.caught:
                continue
            period, start, end = _merged(np.concatenate(level.caught, axis=1))
            if len(known):
                # Inside a run of a smaller period the smallest period is that one.
                known = known[np.lexsort((known[:, 1], known[:, 0]))]
                reach = np.maximum.accumulate(known[:, 1])
                before = np.searchsorted(known[:, 0], start, "right") - 1
                fresh = (before < 0) | (reach[np.maximum(before, 0)] < end)
                period, start, end = period[fresh], start[fresh], end[fresh]
            for p, s, e in zip(period.tolist(), start.tolist(), end.tolist()):
                for bounds in self._around(words, p, s, e, level.size):
                    least.setdefault(bounds, p)
            known = np.array([(*k, p) for k, p in least.items()], np.int64).reshape(-1, 3)
        return known[np.lexsort((known[:, 2], known[:, 0]))]

    def _around(self, words: np.ndarray, p: int, start: int, end: int, size: int) -> Iterator[tuple]:
        """Maximal stretches of period ``p`` about a chain; its ends lie within one block."""
        low, high = max(start - size, 0), min(end + size, len(words))
        equal = np.zeros(high - low - p + 2, np.int8)
        equal[1:-1] = words[low : high - p] == words[low + p : high]
        step = np.diff(equal)
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            length = e - s + p
            if length >= max(self.shortest, self.exponent * p):
                yield low + s, low + s + length


def _merged(caught: np.ndarray) -> np.ndarray:
    """Join chains that an append cut: the next starts where matches overlap."""
    caught = caught[:, np.lexsort((caught[1], caught[0]))]
    period, start, end = caught
    cut = np.flatnonzero((np.diff(period) != 0) | (start[1:] + period[1:] > end[:-1])) + 1
    return np.stack([period[np.append(0, cut)], start[np.append(0, cut)], end[np.append(cut - 1, len(end) - 1)]])


def document_runs(texts: list[str], exponent: int = EXPONENT, shortest: int = SHORTEST) -> Iterator[tuple[list, str]]:
    """For each text its runs (start, length, period) and the text without repeats.

    Texts share one sequence; a word that occurs nowhere else parts them.
    """
    split = [t.encode().split() for t in texts]
    ids: dict[bytes, int] = {}
    number = count()
    parts, offsets, at = [], [], 0
    for i, words in enumerate(split):
        numbered = np.fromiter((ids[w] if w in ids else ids.setdefault(w, next(number)) for w in words), np.int64, len(words))
        parts += [numbered, np.array([-2 - i], np.int64)]
        offsets.append(at)
        at += len(words) + 1
    catchers = SquareCatchers(max(map(len, split), default=0), exponent, shortest)
    catchers.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    runs = catchers.runs()
    owner = np.searchsorted(offsets, runs[:, 0], "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(split) + 1))
    for i, words in enumerate(split):
        own = runs[bounds[i] : bounds[i + 1]]
        if not len(own):
            yield [], b" ".join(words).decode()
            continue
        own = own - np.array([offsets[i], offsets[i], 0])
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, own[:, 0] + own[:, 2], 1)
        np.add.at(gone, own[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
        yield (
            [(s, e - s, p) for s, e, p in own.tolist()],
            b" ".join([words[k] for k in kept.tolist()]).decode(),
        )


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, runs, collapsed), a row per row of ``docs`` (doc_id, text).

    Words are what ASCII white space parts, numbered from 0. ``runs`` holds
    (start, length, period) of each maximal stretch with smallest period
    ``period`` and a length of at least max(``shortest``, ``exponent`` periods),
    by start, then period. ``collapsed`` joins by one blank the words that no
    run contains after its first period. Null and empty texts have no runs and
    collapse to the empty text; null and repeated doc_ids are rows like any
    other; other columns are not read. No rows give no rows. A task holds one
    Arrow batch, and arrays for GROUP_BYTES of text or one longer text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches):
        for batch in batches:
            texts, found, told = batch.column("text").to_pylist(), [], []

            def flush(group):
                for runs, text in document_runs(group, exponent, shortest):
                    found.append(runs)
                    told.append(text)

            group, size = [], 0
            for text in texts:
                group.append(text)
                size += len(text)
                if size > GROUP_BYTES:
                    flush(group)
                    group, size = [], 0
            flush(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _listed(found), pa.array(told, pa.string())], ["doc_id", "runs", "collapsed"]
            )

    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(
        emit, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


def _listed(found: list[list[tuple]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)])
    flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
    inner = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
