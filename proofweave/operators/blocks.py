"""Groups that hold a block of questions and meet their tenant's chunks as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def principal_sets(lists: pa.ChunkedArray) -> tuple[np.ndarray, list[frozenset]]:
    """Each row's number among the distinct principal sets, and those sets."""
    numbers: dict[frozenset, int] = {}
    rows = [
        numbers.setdefault(frozenset(names or ()) - {None}, len(numbers))
        for names in lists.to_pylist()
    ]
    return np.array(rows, dtype=int), list(numbers)


def shared_sets(asked_sets: list[frozenset], owned_sets: list[frozenset]) -> np.ndarray:
    """Boolean matrix: set i of the questions and set j of the chunks have a principal in common.

    Decided through the principals that the questions hold; its size does not
    depend on how many principals there are.
    """
    holders: dict[str, list[int]] = {}
    for number, names in enumerate(asked_sets):
        for name in names:
            holders.setdefault(name, []).append(number)
    shared = np.zeros((len(asked_sets), len(owned_sets)), dtype=bool)
    for number, names in enumerate(owned_sets):
        for name in names & holders.keys():
            shared[holders[name], number] = True
    return shared


def tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows again: first all questions, then chunks in tiles."""
    questions, tile, held = [], [], 0
    for batch in batches:
        chunk = np.asarray(batch["is_chunk"].to_numpy(zero_copy_only=False), dtype=bool)
        asked = len(chunk) - int(chunk.sum())  # questions are sorted before chunks
        if asked:
            questions.append(batch.slice(0, asked))
        for at in range(asked, batch.num_rows, size):
            if questions is not None:
                yield pa.Table.from_batches(questions, batch.schema)
                questions = None
            tile.append(batch.slice(at, size))
            held += tile[-1].num_rows
            if held >= size:
                yield pa.Table.from_batches(tile)
                tile, held = [], 0
    if tile:
        yield pa.Table.from_batches(tile)
