"""Deterministic token-hash embeddings.

Tokens are prepared by JVM expressions; one Arrow function turns a batch of
token lists into dense unit vectors. Each distinct token of a batch is hashed
once, and no shuffle is needed because a text's vector depends on that text
alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from proofweave import constants as K
from proofweave.functions import text as tx

Embedder = Callable[[Column], Column]

# Fixed values of the hashing scheme: weight = 1 + (byte mod 31) / 100, and the
# second position receives half of it.
WEIGHT_MODULUS = 31
WEIGHT_DIVISOR = 100.0
SECOND_SHARE = 0.5

_ROWS_PER_BLOCK = 1024


def embedding_tokens(text: Column) -> Column:
    """Tokens of a text, or the whole lower-case text when it has none."""
    def or_whole(tokens: Column) -> Column:
        return F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lower(text)))

    return tx.let(tx.tokenize(text), or_whole)


def _token_table(tokens: list[str], dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, second position and signed weight per distinct token."""
    raw = b"".join(hashlib.sha256(token.encode("utf-8")).digest()[:10] for token in tokens)
    digests = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 10)
    words = np.ascontiguousarray(digests[:, :8]).view(">u4").astype(np.int64) % dimension
    weight = 1.0 + (digests[:, 9] % WEIGHT_MODULUS) / WEIGHT_DIVISOR
    return words[:, 0], words[:, 1], np.where(digests[:, 8] % 2 == 0, weight, -weight)


def _dense_vectors(lists: pa.ListArray, dimension: int) -> pa.Array:
    encoded = lists.flatten().dictionary_encode()
    first, second, weight = _token_table(encoded.dictionary.to_pylist(), dimension)
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    cells = np.concatenate([row_of * dimension + first[codes], row_of * dimension + second[codes]])
    values = np.concatenate([weight[codes], weight[codes] * SECOND_SHARE])
    dense = np.bincount(cells, weights=values, minlength=len(lists) * dimension)
    dense = dense.reshape(len(lists), dimension)
    norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
    unit = np.divide(dense, norm, out=dense, where=norm > 0)
    stored = np.round(unit, K.EMBEDDING_DECIMALS).astype(np.float32)
    offsets = np.arange(0, stored.size + 1, dimension, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(stored.ravel()))


def hash_embedder(dimension: int = K.EMBEDDING_DIMENSION) -> Embedder:
    """Column function: text -> unit ``array<float>`` of the given length."""
    if dimension < 8:
        raise ValueError("embedding dimension must be at least 8")

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(tokens: pa.Array) -> pa.Array:
        blocks = [
            _dense_vectors(pa.concat_arrays([tokens.slice(at, _ROWS_PER_BLOCK)]), dimension)
            for at in range(0, len(tokens), _ROWS_PER_BLOCK)
        ]
        return pa.concat_arrays(blocks) if blocks else pa.array([], pa.list_(pa.float32()))

    return lambda text: embed(embedding_tokens(text))


def with_embedding(
    frame: DataFrame, text_column: str, embedder: Embedder | None = None, name: str = "embedding"
) -> DataFrame:
    """Attach an embedding; a caller may plug in a model-backed embedder."""
    return frame.withColumn(name, (embedder or hash_embedder())(F.col(text_column)))


def embedding_problem(embedding: Column, dimension: int = K.EMBEDDING_DIMENSION) -> Column:
    """Reason text for a missing or wrongly sized vector, else null."""
    return F.when(embedding.isNull(), "embedding is missing").when(
        F.size(embedding) != dimension,
        F.concat(
            F.lit(f"embedding dimension must be {dimension}, received "),
            F.size(embedding).cast("string"),
        ),
    )
