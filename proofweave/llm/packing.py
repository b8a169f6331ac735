"""Best-fit packing of token sequences, certified by lower bounds.

Documents are tokenised and cut where they must be. Pieces are dealt to
partitions of bounded size and packed there by best-fit decreasing. Dual
feasible functions give a lower bound on each partition's sequences. Partitions
above their bound release every sequence with a gap, certified ones only their
emptiest; released pieces are dealt anew and packed again, as long as that
saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from proofweave.llm.common import whole
from proofweave.operators.sizing import materialize

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs; a piece is five numbers.
PER_PARTITION = 100_000
#: Words whose ids a worker keeps: some 120 MB.
CACHED_WORDS = 700_000
#: Bytes of text that are tokenised together.
GROUP_BYTES = 1_000_000


class CachedTokenizer:
    """Ids of a tokenizer that never merges across a space or line feed, ignores
    case, and keeps letters apart from a full stop or comma after them.

    Each distinct word is encoded once per worker, so most of the work is a
    lookup. The cache is emptied when it is full, which only costs time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.number: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.number.clear()
        self.number[b""] = 0
        self.at = np.zeros(1024, dtype=np.int64)
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def _keep(self, words: list[bytes], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        first, total = len(self.number), int(sizes.sum())
        while first + len(ids) > len(self.at):
            self.at, self.sizes = np.append(self.at, self.at), np.append(self.sizes, self.sizes)
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, self.flat)
        self.sizes[first : first + len(ids)] = sizes
        self.at[first : first + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=total)
        self.used += total
        self.number.update(zip(words, range(first, first + len(ids))))

    def _ids(self, word: bytes) -> list[int]:
        n = self.number[word]
        return self.flat[self.at[n] : self.at[n] + self.sizes[n]].tolist()

    def _encode(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            coded = self.encoder.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self._keep(part, [c.ids for c in coded])

    def learn(self, words: set[bytes]) -> None:
        new = {w for w in words if w not in self.number}
        if len(self.number) + 2 * len(new) > CACHED_WORDS:
            self.reset()
            new = words - {b""}
        # A word and a mark after it are coded apart, so that the word serves with any mark.
        marked = [w for w in new if w[-1:] in (b".", b",") and w[:-1].isalpha()]
        plain = new.difference(marked)
        plain.update(w[:-1] for w in marked)
        if marked:
            plain.update((b".", b","))
        self._encode([w for w in plain if w not in self.number])
        if marked:
            mark = {m: self._ids(m) for m in (b".", b",")}
            self._keep(marked, [self._ids(w[:-1]) + mark[w[-1:]] for w in marked])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by END_ID, and how many a text has.

        Arrow lowers, splits and numbers the words; only distinct ones reach Python.
        """
        # In a text with marks of special tokens, case decides what is one.
        special = pc.match_substring(texts, "<|")
        texts = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().cast(pa.binary()).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(set(known))
        number = np.fromiter(map(self.number.__getitem__, known), dtype=np.int64, count=len(known))
        words = pc.list_value_length(split).to_numpy().astype(np.int64)
        ends = np.cumsum(words)
        # The end of a text is a word of its own, the one after the known ones.
        index = np.insert(number[coded.indices.to_numpy()], ends, len(self.number))
        at = np.append(self.at[: len(self.number)], self.used)
        sizes = np.append(self.sizes[: len(self.number)], 1)
        flat = np.append(self.flat[: self.used], np.uint32(END_ID))
        length = sizes[index]
        stop = np.cumsum(length)
        ids = flat[np.repeat(at[index] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
        tokens = np.diff(stop[ends + np.arange(len(ends))], prepend=0)
        return ids.astype("<u4"), tokens

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, without END_ID."""
        ids, tokens = self.encode_all(pa.array(texts, pa.string()))
        for part in np.split(ids, np.cumsum(tokens)[:-1]):
            yield part[:-1]


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str) -> CachedTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A document is its ids and then END_ID; null texts count as empty. Only
    documents longer than ``capacity`` are cut, into full pieces and a last one
    that may be shorter. ``tokenizer`` is a path on every worker.
    """

    def cut(batches):
        coder = _tokenizer(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            # About GROUP_BYTES of text at a time, or one longer text.
            group = (np.cumsum(size) - size) // GROUP_BYTES
            edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(texts))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield placed(keys.slice(low, high - low), *coder.encode_all(texts.slice(low, high - low)))

    def placed(keys: pa.Array, ids: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
        n = -(-tokens // capacity)
        owner = np.repeat(np.arange(len(tokens)), n)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(tokens[owner] - start, capacity)
        begin = (np.cumsum(tokens) - tokens)[owner] + start
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist())]
        columns = [
            keys.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
            pa.array(crc, pa.int64()),
        ]
        if with_ids:  # pieces follow each other without gaps
            offsets = np.append(begin, len(ids)).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("_text")).mapInArrow(cut, kind)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset, and fill of each bin, for lengths in descending order.

    Each length goes to the open bin with the least gap that holds it. A bit
    set of occurring gaps makes the search one shift.
    """
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    gaps = 0
    for i, length in enumerate(lengths.tolist()):
        above = gaps >> length
        if above:
            gap = length + (above & -above).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            b, gap = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += length
        if gap := gap - length:
            by_gap[gap].append(b)
            gaps |= 1 << gap
    return bins, offsets, np.array(fill, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins that ``lengths`` can need, by dual feasible functions.

    Two families: sizes below a limit count nothing and those above its
    complement count whole; and sizes rounded to multiples of 1/k. The limit 0
    gives the plain sum.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    number, mass = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * size))
    limit = np.arange(capacity // 2 + 1)
    high = capacity - limit
    middle = mass[high + 1] - mass[limit]
    whole_bins = number[-1] - number[high + 1]
    best = int((whole_bins + -(-middle // capacity)).max())
    for k in range(2, 13):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


#: A sequence_id is the round, then 28 bits for the task, then 20 for the bin.
ROUND_SHIFT, TASK_SHIFT = 48, 20
#: Pieces of a task that still have a bin number each.
MOST_PIECES = 1 << TASK_SHIFT


def _pack_partition(frame: pd.DataFrame, round_no: int, capacity: int) -> pd.DataFrame:
    if len(frame) > MOST_PIECES:
        raise ValueError(f"a task got {len(frame)} pieces; per_partition must stay below {MOST_PIECES // 2}")
    frame = frame.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    bins, offsets, fill = best_fit(frame["length"].to_numpy(), capacity)
    bound = lower_bound(frame["length"].to_numpy(), capacity)
    certified = len(fill) == bound
    release = fill == fill.min() if certified else fill < capacity
    if certified:
        release &= np.arange(len(fill)) == int(np.argmin(fill))
    release &= fill < capacity
    part = int(frame["part"].iloc[0])
    return frame.assign(
        sequence_id=(round_no << ROUND_SHIFT) + (part << TASK_SHIFT) + bins,
        offset=offsets,
        open=release[bins],
        first=offsets == 0,
        certified=certified,
    )


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def _pack_round(rows: DataFrame, round_no: int, parts: int, capacity: int) -> DataFrame:
    dealt = rows.withColumn(
        "part", F.pmod(F.xxhash64(F.lit(round_no), "row"), F.lit(parts)).cast("int")
    )
    return dealt.groupBy("part").applyInPandas(
        lambda frame: _pack_partition(frame, round_no, capacity),
        f"{_PIECE}, part int, sequence_id long, offset long, open boolean, first boolean, certified boolean",
    )


def pack(cut: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    ``cut`` comes from ``pieces``. A task gets about ``per_partition`` pieces,
    whatever the input. A round that saves no sequence is not used, and ends
    the exchange.
    """
    if not 0 < per_partition <= MOST_PIECES // 2:
        raise ValueError(f"per_partition must be 1 to {MOST_PIECES // 2}")
    # Row numbers, kept by writing, deal out repeated rows too.
    cut = cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("row"))
    cut = materialize(cut, "pieces")
    total = cut.count()
    done: list[DataFrame] = []
    rows, used = cut, None
    for round_no in range(1 << 63 - ROUND_SHIFT):
        parts = max(1, -(-total // per_partition))
        packed = materialize(_pack_round(rows, round_no, parts, capacity), "packed")
        now = packed.agg(
            F.sum(F.col("first").cast("long")).alias("bins"),
            F.sum((F.col("first") & F.col("open")).cast("long")).alias("open"),
            F.sum(F.col("open").cast("long")).alias("pieces"),
        ).first()
        if used is not None and (now["bins"] or 0) >= used:
            done.append(held)
            break
        done.append(packed.filter("not open"))
        held = packed.filter("open")
        rows, used, total = held.select(*cut.columns), now["open"] or 0, now["pieces"] or 0
        if parts == 1 or used < 2:
            done.append(held)
            break
    else:
        raise RuntimeError("packing did not settle")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text); see ``pieces`` and ``pack``.

    Null and empty texts are one piece of one id. Null or repeated doc_ids are
    packed like others, a row each. No rows give no rows. Other columns of
    ``docs`` are not read.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity, per_partition)
