"""Spelling correction of query words against a fixed lexicon."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from proofweave import constants as K
from proofweave.functions import text as tx


def _may_match(word: str, entry: str) -> bool:
    """Whether the letters of ``word`` that ``entry`` has could reach the cutoff at all."""
    needed = K.SPELLING_CUTOFF * (len(word) + len(entry)) / 2
    if min(len(word), len(entry)) < needed:
        return False
    return sum(letter in entry for letter in word) >= needed


def _closest(word: str | None) -> str | None:
    if not word or len(word) < K.MIN_SPELLED_LENGTH:
        return None
    possible = [entry for entry in K.SPELLING_LEXICON if _may_match(word, entry)]
    found = difflib.get_close_matches(word, possible, n=1, cutoff=K.SPELLING_CUTOFF) if possible else None
    return found[0] if found and found[0] != word else None


@F.arrow_udf(ArrayType(StringType()))
def _closest_words(words: pa.Array) -> pa.Array:
    """Nearest lexicon word per list item; every distinct word is matched once."""
    lists = pa.concat_arrays([words])
    encoded = lists.flatten().dictionary_encode()
    nearest = pa.array([_closest(word) for word in encoded.dictionary.to_pylist()], pa.string())
    offsets = lists.offsets
    return pa.ListArray.from_arrays(offsets, nearest.take(encoded.indices))


def corrected_query(text: Column) -> Column:
    """Corrected query text, or null when no word changes."""
    words = tx.split_words(text)
    bare = F.transform(words, lambda word: F.lower(F.regexp_replace(word, "[^a-zA-Z]", "")))
    nearest = _closest_words(bare)
    fixed = F.transform(
        F.arrays_zip(words.alias("word"), bare.alias("bare"), nearest.alias("nearest")),
        lambda item: F.when(item["nearest"].isNull(), item["word"]).otherwise(
            F.replace(F.lower(item["word"]), item["bare"], item["nearest"])
        ),
    )
    return F.when(F.exists(nearest, lambda word: word.isNotNull()), F.array_join(fixed, " "))
