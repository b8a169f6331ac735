"""Exact cosine ranking inside a tenant.

The questions of a tenant are cut into blocks, and each block is one group that
meets all chunks of its tenant as a stream: chunks pass in tiles, and the best
``limit`` of each question so far are all that is kept. Questions with the same
vector and principals are one ask. Asks of one principal set meet only the chunks
that the set may see. A vector of few places that are not zero is multiplied at
these alone, in single precision; what may be among the best by the error's bound
is scored again in double precision. Lists are whole when the stream ends, so none
is shuffled, and chunks move once for a block of questions, however many chunks
there are. Vectors travel without their zeros. A group's memory is bounded by the
size of a block and of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from proofweave import constants as K
from proofweave.operators.blocks import principal_sets, shared_sets, tiles
from proofweave.operators.lexical import top_ranked
from proofweave.operators.sizing import broadcast_if_small, in_slices, materialize

# A group holds its asks (up to 4 KB each at 1024 dimensions, and their lists), and the
# questions that ask the same.
ASKS_PER_BLOCK = 32_768
QUESTIONS_PER_BLOCK = 1_000_000
QUESTIONS_PER_OUTPUT = 1024
CHUNKS_PER_BLOCK = 4096
# Rows of a tile's product: 1024 x 4096 scores are 16 or 32 MB.
ASKS_PER_PRODUCT = 1024
# A principal set of fewer asks meets all chunks, and access is decided on the scores.
ASKS_OF_SET = 64
# A vector with more than one in DENSE of its places filled takes part in a matrix product.
DENSE = 12
# Places of candidates that are scored again together.
PLACES_PER_SLICE = 1_000_000
MAX_BROADCAST_TENANTS = 200_000
SCORE_DECIMALS = 8


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row as a bitmap of its places that are not zero, and the values there."""
    filled = rows != 0
    bitmaps = np.packbits(filled, axis=1)
    ends = np.cumsum(filled.sum(axis=1))
    values = rows[filled]
    return [
        bitmap.tobytes() + values[end - count : end].tobytes()
        for bitmap, end, count in zip(bitmaps, ends, filled.sum(axis=1), strict=True)
    ]


def _unpacked(packed: pa.Array, dimension: int, dtype: np.dtype) -> np.ndarray:
    width = -(-dimension // 8)
    texts = packed.to_pylist()
    bitmaps = np.frombuffer(b"".join(t[:width] for t in texts), dtype=np.uint8).reshape(-1, width)
    rows = np.zeros((len(texts), dimension), dtype=dtype)
    filled = np.unpackbits(bitmaps, axis=1, count=dimension).astype(bool)
    rows[filled] = np.frombuffer(b"".join(t[width:] for t in texts), dtype=dtype)
    return rows


def _packer(dimension: int, dtype: np.dtype):
    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(vectors), CHUNKS_PER_BLOCK):
            part = pa.concat_arrays([vectors.slice(at, CHUNKS_PER_BLOCK)])
            rows = part.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dimension)
            parts.append(pa.array(_packed(rows), pa.binary()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return pack


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.full_like(rows, np.nan), where=norm > 0)


def _segments(sets: np.ndarray, dense: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Asks that are multiplied together, and their principal set, or -1 for several."""
    counts = np.bincount(sets, minlength=1)
    common = np.where(counts[sets] >= ASKS_OF_SET, sets, -1)
    order = np.lexsort((dense, common))
    key = common[order] * 2 + dense[order]
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(key)) + 1):
        for at in range(0, len(part), ASKS_PER_PRODUCT):
            out.append((part[at : at + ASKS_PER_PRODUCT], int(common[part[0]])))
    return out


class _Asks:
    """Distinct (vector, principal set) among a block's questions, without vectors of no length."""

    def __init__(self, questions: pa.Table, dimension: int, dtype: np.dtype):
        set_row, self.sets = principal_sets(questions["principals"])
        codes = questions["vector"].combine_chunks().dictionary_encode()
        pair = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(self.sets) + set_row
        distinct, self.of_question = np.unique(pair, return_inverse=True)
        self.set_row = distinct % len(self.sets)
        texts = codes.dictionary.take(pa.array(distinct // len(self.sets)))
        known = np.empty(len(distinct), bool)
        self.size = np.empty(len(distinct), np.int64)
        places, values = [], []
        for at in range(0, len(distinct), CHUNKS_PER_BLOCK):
            rows = _unit_rows(_unpacked(texts.slice(at, CHUNKS_PER_BLOCK), dimension, dtype))
            known[at : at + len(rows)] = ~np.isnan(rows).any(axis=1)
            filled = rows != 0
            self.size[at : at + len(rows)] = filled.sum(axis=1)
            places.append(np.nonzero(filled)[1])
            values.append(rows[filled])
        self.places, self.values = np.concatenate(places), np.concatenate(values)
        self.narrow = self.values.astype(np.float32)
        self.first = np.cumsum(self.size) - self.size
        self.dimension = dimension
        self.is_dense = self.size * DENSE > dimension
        asks = np.flatnonzero(known)
        self.segments = [(asks[part], only) for part, only in _segments(self.set_row[asks], self.is_dense[asks])]

    def at(self, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each filled place of ``asks``: its number among them, and where it is held."""
        row = np.repeat(np.arange(len(asks)), self.size[asks])
        slot = np.arange(len(row)) - np.repeat(np.cumsum(self.size[asks]) - self.size[asks], self.size[asks])
        return row, self.first[asks][row] + slot

    def rows(self, asks: np.ndarray) -> np.ndarray:
        out = np.zeros((len(asks), self.dimension))
        row, at = self.at(asks)
        out[row, self.places[at]] = self.values[at]
        return out

    def products(self, asks: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        """Scores of asks and chunks (a row for each place), in single precision."""
        out = np.empty((len(asks), chunks.shape[1]), np.float32)
        held = np.empty((int(self.size[asks].max()), chunks.shape[1]), np.float32)
        for row, at, size in zip(out, self.first[asks].tolist(), self.size[asks].tolist(), strict=True):
            np.take(chunks, self.places[at : at + size], axis=0, out=held[:size], mode="clip")
            np.dot(self.narrow[at : at + size], held[:size], out=row)
        return out


class _Best:
    """The best ``limit`` chunks of each ask of a segment, as they come.

    Chunks are numbered in the order of their ids, so numbers break ties.
    """

    def __init__(self, asks: int, limit: int):
        self.limit = limit
        self.least = np.full(asks, -np.inf)
        self.row, self.score, self.number = np.empty(0, np.int32), np.empty(0), np.empty(0, np.int32)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def candidates(self, scores: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``scores``, right within ``error``, that may be among the best; -inf is none."""
        cutoff = self.least - error
        filling = np.flatnonzero(np.isneginf(cutoff))
        if len(filling):
            keep = min(self.limit, scores.shape[1])
            part = scores if len(filling) == len(scores) else scores[filling]
            cutoff[filling] = np.partition(part, -keep, axis=1)[:, -keep] - 2 * error
        cutoff = np.maximum(cutoff - 2 * 10.0**-SCORE_DECIMALS, -2.0)  # no cosine is below -1
        return np.divmod(np.flatnonzero(scores >= cutoff[:, None]), scores.shape[1])

    def add(self, row: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        # A later chunk of an equal score loses to those that are held.
        better = score > self.least[row]
        self.waiting.append((row[better].astype(np.int32), score[better], number[better].astype(np.int32)))
        self.count += len(self.waiting[-1][0])
        if self.count >= self.limit * len(self.least):
            self.settle()

    def settle(self) -> None:
        held = [(self.row, self.score, self.number), *self.waiting]
        row, score, number = (np.concatenate(part) for part in zip(*held, strict=True))
        self.waiting, self.count = [], 0
        order = np.lexsort((number, -score, row))
        row, score, number = row[order], score[order], number[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.limit
        self.row, self.score, self.number = row[best], score[best], number[best]
        last = place[best] == self.limit - 1
        self.least[self.row[last]] = self.score[last]


class _Tile:
    """Vectors of a tile of chunks; those of no length take no part."""

    def __init__(self, tile: pa.Table, dimension: int, dtype: np.dtype):
        self.vectors = _unpacked(tile["vector"], dimension, dtype)
        rows = self.vectors.astype(np.float64)
        self.length = np.sqrt((rows * rows).sum(axis=1))
        whole = self.length > 0
        for row in np.flatnonzero(np.isinf(self.length)):
            whole[row] = not np.isinf(rows[row]).any()
        self.known = np.flatnonzero(whole)
        self.set_row, self.sets = principal_sets(tile["principals"])

        self.kept: tuple = (None, None, None)

    def seen(self, only: int, shared: np.ndarray, dense: bool) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that a principal set may see (all for -1), and a row for each place of their vectors.

        Segments of one kind follow each other, so the last ones are kept.
        """
        if self.kept[0] != (only, dense):
            columns = self.known
            if only >= 0:
                columns = columns[shared[only, self.set_row[columns]]]
            if dense:
                rows = _unit_rows(self.vectors[columns]).T
            else:
                narrow = (self.vectors[columns] / self.length[columns, None]).astype(np.float32)
                rows = np.ascontiguousarray(narrow.T)
            self.kept = ((only, dense), columns, rows)
        return self.kept[1:]


def _exact(asks: _Asks, tile: _Tile, ask: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision."""
    out = np.empty(len(ask))
    part = np.cumsum(asks.size[ask]) // PLACES_PER_SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(ask)]
    for a, b in zip(cuts, cuts[1:]):
        pair, at = asks.at(ask[a:b])
        held = tile.vectors[chunk[a:b][pair], asks.places[at]] / tile.length[chunk[a:b]][pair]
        out[a:b] = np.bincount(pair, weights=asks.values[at] * held, minlength=b - a)
    return out


def _meet(asks: _Asks, tile: _Tile, segment: np.ndarray, only: int, shared: np.ndarray, best: _Best, first: int) -> None:
    """Let the asks of a segment see a tile, whose chunks are numbered from ``first`` on."""
    dense = bool(asks.is_dense[segment[0]])
    columns, rows = tile.seen(only, shared, dense)
    if not len(columns):
        return
    if dense:
        scores, error = asks.rows(segment) @ rows, 0.0
    else:
        scores = asks.products(segment, rows)
        # Of n products of numbers rounded to 24 bits, added in any order; both vectors have length 1.
        error = float(asks.size[segment].max() + 4) * 2.0**-23
    if only < 0:
        scores[~shared[np.ix_(asks.set_row[segment], tile.set_row[columns])]] = -np.inf
    row, at = best.candidates(scores, error)
    if error:
        found = _exact(asks, tile, segment[row], columns[at])
    else:
        found = scores[row, at]
    best.add(row, np.round(found, SCORE_DECIMALS), columns[at] + first)


def _block_top(limit: int, dimension: int, dtypes: tuple[np.dtype, np.dtype], tile_size: int):
    schema = pa.schema(
        [("question_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64()), ("vec_rank", pa.int32())]
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = tiles(batches, tile_size)
        questions = next(parts, None)
        if questions is None or questions.num_rows == 0:
            for _ in parts:  # a block without questions
                pass
            return
        asks = _Asks(questions, dimension, dtypes[0])
        best = [_Best(len(segment), limit) for segment, _ in asks.segments]
        names, before = [], 0
        for part in parts:
            tile = _Tile(part, dimension, dtypes[1])
            shared = shared_sets(asks.sets, tile.sets)
            for (segment, only), lists in zip(asks.segments, best, strict=True):
                _meet(asks, tile, segment, only, shared, lists, before)
            names.append(part["row_id"].combine_chunks())
            before += part.num_rows
        if not names:
            return
        names = pa.chunked_array(names)
        segment_of = np.full(len(asks.size), -1)
        first, count = np.zeros(len(asks.size), np.int64), np.zeros(len(asks.size), np.int64)
        for number, ((segment, _), lists) in enumerate(zip(asks.segments, best, strict=True)):
            lists.settle()
            segment_of[segment] = number
            count[segment] = np.bincount(lists.row, minlength=len(segment))
            first[segment] = np.cumsum(count[segment]) - count[segment]
        by_segment = np.argsort(segment_of[asks.of_question], kind="stable")
        for at in range(0, len(by_segment), QUESTIONS_PER_OUTPUT):
            chosen = by_segment[at : at + QUESTIONS_PER_OUTPUT]
            for number in np.unique(segment_of[asks.of_question[chosen]]):
                if number < 0:
                    continue
                lists = best[number]
                asking = chosen[segment_of[asks.of_question[chosen]] == number]
                ask = asks.of_question[asking]
                row = np.repeat(np.arange(len(asking)), count[ask])
                place = np.arange(len(row)) - np.repeat(np.cumsum(count[ask]) - count[ask], count[ask])
                held = first[ask][row] + place
                found = pa.table(
                    {
                        "question_id": questions["row_id"].take(pa.array(asking[row])),
                        "chunk_id": names.take(pa.array(lists.number[held])),
                        "score": pa.array(lists.score[held]),
                        "vec_rank": pa.array(place + 1, pa.int32()),
                    },
                    schema=schema,
                )
                yield from found.combine_chunks().to_batches()

    return rank


def _checked(embedding: Column, dimension: int) -> Column:
    return F.when(F.size(embedding) == dimension, embedding).otherwise(
        F.raise_error(
            F.concat(
                F.lit(f"embedding dimension must be {dimension}, received "),
                F.size(embedding).cast("string"),
            )
        )
    )


def vector_top(
    questions: DataFrame,
    chunks: DataFrame,
    limit: int = K.CANDIDATE_LIMIT,
    dimension: int = K.EMBEDDING_DIMENSION,
) -> DataFrame:
    """Best chunks by cosine: question_id, chunk_id, score, vec_rank.

    ``questions`` needs question_id, enterprise_id, principals, embedding;
    ``chunks`` needs chunk_id, enterprise_id, principals, embedding. A chunk
    without a vector takes no part.
    """
    stored = chunks.filter(F.col("embedding").isNotNull())
    ask = F.xxhash64("embedding", F.array_sort("principals"))
    counted = questions.select("enterprise_id", ask.alias("ask")).groupBy("enterprise_id").agg(
        F.count(F.lit(1)).alias("asked"), F.count_distinct("ask").alias("asks")
    )
    tenants = stored.select("enterprise_id").distinct()
    blocks = broadcast_if_small(
        materialize(
            counted.join(tenants, "enterprise_id").select(
                "enterprise_id",
                F.ceil(F.col("asks") / ASKS_PER_BLOCK).alias("ask_blocks"),
                F.ceil(F.col("asked") / QUESTIONS_PER_BLOCK).alias("parts"),
            ).withColumn("blocks", F.col("ask_blocks") * F.col("parts")),
            "vector-blocks",
        ),
        MAX_BROADCAST_TENANTS,
    )

    asked_type, owned_type = _stored_as(questions), _stored_as(stored)
    keys = ["enterprise_id", "block"]
    columns = ("row_id", "principals", "vector")
    block = F.pmod("ask", F.col("ask_blocks")) + F.col("ask_blocks") * F.pmod(F.xxhash64("row_id"), F.col("parts"))

    def packed(rows: DataFrame, name: str, dtype: np.dtype, *more: Column) -> DataFrame:
        vector = _packer(dimension, dtype)(F.col("embedding")).alias("vector")
        return rows.select("enterprise_id", F.col(name).alias("row_id"), "principals", vector, *more)

    checked = _checked(F.col("embedding"), dimension)
    asked = packed(questions.withColumn("embedding", checked), "question_id", asked_type, ask.alias("ask"))
    asked = asked.join(blocks, "enterprise_id")
    # A filter looks at every chunk, whether its tenant asks or not; it drops none.
    owned = stored.filter(checked.isNotNull()).join(blocks, "enterprise_id")

    def rows_of(numbers: Column) -> tuple[DataFrame, DataFrame]:
        asking = asked.select("enterprise_id", block.alias("block"), F.lit(False).alias("is_chunk"), *columns, "blocks")
        # Packed once, by the tenants that take part, and copied after that.
        met = packed(owned.filter(numbers.isNotNull()), "chunk_id", owned_type, numbers.alias("numbers"))
        return asking.filter(F.array_contains(numbers, F.col("block"))).drop("blocks"), met.select(
            "enterprise_id", F.explode("numbers").alias("block"), F.lit(True).alias("is_chunk"), *columns
        )

    def run(asking: DataFrame, met: DataFrame) -> DataFrame:
        return (
            asking.unionByName(met)
            .repartition(*keys)
            .sortWithinPartitions(*keys, "is_chunk", "row_id")
            .groupBy(*keys)
            .applyInArrow(
                _block_top(limit, dimension, (asked_type, owned_type), CHUNKS_PER_BLOCK),
                "question_id string, chunk_id string, score double, vec_rank int",
            )
        )

    ranked = in_slices(blocks, stored, rows_of, run, "vector-slice")
    repeated = questions.groupBy("question_id").count().filter("count > 1")
    if repeated.limit(1).count():  # the lists of a repeated id are one list
        return top_ranked(ranked.drop("vec_rank"), limit, "vec_rank", ("question_id",))
    return ranked


def _stored_as(rows: DataFrame) -> np.dtype:
    kind = rows.schema["embedding"].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return np.dtype("float32") if narrow else np.dtype("float64")
