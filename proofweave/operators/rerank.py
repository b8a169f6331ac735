"""Rerank, source and support scores, and the confidence filter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from proofweave import constants as K
from proofweave.functions import text as tx
from proofweave.functions.identity import compact_key, full_key
from proofweave.operators.lexical import ATTEMPT

# Scores are compared for order after rounding, so summation noise never
# decides between two equal candidates.
ORDER_DECIMALS = 9
PROVENANCE = ("content", "locator", "title", "version_label")


def coded(tokens: Column, plain: bool = False) -> Column:
    """Tokens as ``short``, a number each that no other token has, and ``long``, all others.

    Base 36 with a leading 1 keeps leading zeros, and eleven characters fill a long. Sets of
    numbers are met without hashing texts. ``plain`` tokens are known to be of a-z and 0-9.
    """

    def is_short(token: Column) -> Column:
        return F.length(token) <= 11 if plain else token.rlike("\\A[0-9a-z]{1,11}\\z")

    numbers = F.transform(
        F.filter(tokens, is_short), lambda token: F.conv(F.concat(F.lit("1"), token), 36, 10).cast("long")
    )
    return F.struct(numbers.alias("short"), F.filter(tokens, lambda token: ~is_short(token)).alias("long"))


def token_recall(query: Column, content: Column) -> Column:
    """Share of the ``query`` tokens that are among those of ``content``, both ``coded``."""
    size = F.size(query["short"]) + F.size(query["long"])
    found = sum(F.size(F.array_intersect(query[kind], content[kind])) for kind in ("short", "long"))
    return F.when(size > 0, found / size).otherwise(0.0)


def title_boost(query: Column, title: Column) -> Column:
    overlap = F.arrays_overlap(query["short"], title["short"]) | F.arrays_overlap(query["long"], title["long"])
    return F.when(overlap, 0.2).otherwise(0.0)


def freshness(published_at: Column, as_of: dt.datetime) -> Column:
    """Exponential one-year decay, kept in 0.1..1; unknown dates score 0.5."""
    seconds = F.unix_micros(F.lit(as_of)) - F.unix_micros(published_at)
    age_days = F.greatest(seconds / F.lit(86_400_000_000.0), F.lit(0.0))
    decay = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.exp(-age_days / 365.0)))
    return F.when(published_at.isNull(), K.UNKNOWN_FRESHNESS).otherwise(decay)


def source_score(authority: Column, quality: Column, fresh: Column) -> Column:
    quality = F.coalesce(quality, F.lit(K.MISSING_METADATA_QUALITY))
    return F.least(F.lit(1.0), authority * 0.45 + quality * 0.25 + fresh * 0.30)


def with_token_sets(chunks: DataFrame) -> DataFrame:
    """Distinct content and title tokens, kept with the chunk when ingested."""
    if {"content_tokens", "title_tokens"} <= set(chunks.columns):
        return chunks
    return chunks.withColumns(
        {
            "content_tokens": tx.token_set(F.col("content")),
            "title_tokens": tx.token_set(F.col("title")),
        }
    )


def _written(tokens: Column) -> Column:
    """Tokens, which hold no spaces, as one text: fewer bytes in a shuffle."""
    return F.array_join(tokens, " ")


def _read(written: Column) -> Column:
    return F.when(written == "", F.array().cast("array<string>")).otherwise(F.split(written, " "))


def score_candidates(
    fused: DataFrame, attempts: DataFrame, chunks: DataFrame, as_of: dt.datetime = K.AS_OF
) -> DataFrame:
    """Attach the rerank, source and support scores."""
    query = attempts.select(*ATTEMPT, _written(tx.token_set(F.col("query_text"))).alias("query_tokens"))
    payload = with_token_sets(chunks).select(
        compact_key(F.col("chunk_id")).alias("chunk_id"),
        coded(F.col("content_tokens")).alias("content_tokens"),
        coded(F.col("title_tokens")).alias("title_tokens"),
        "source_authority",
        "extraction_quality",
        "published_at",
    )
    # Columns of their own are made once for all that use them. A question travels with
    # each of its candidates, so its tokens are coded after that; a chunk's move once.
    asked = F.col("query_tokens")
    recall = token_recall(asked, F.col("content_tokens"))
    boost = title_boost(asked, F.col("title_tokens"))
    return (
        fused.withColumn("chunk_id", compact_key(F.col("chunk_id")))
        .join(query, list(ATTEMPT))
        .join(payload, "chunk_id")
        .withColumn("query_tokens", _read(asked))
        .withColumn("query_tokens", coded(asked, plain=True))
        .withColumn("chunk_id", full_key(F.col("chunk_id")))
        .withColumn("rerank_score", F.least(F.lit(1.0), F.col("rrf_score") + recall + boost))
        .withColumn(
            "source_score",
            source_score(
                F.coalesce("source_authority", F.lit(0.0)),
                F.col("extraction_quality"),
                freshness(F.col("published_at"), as_of),
            ),
        )
        .withColumn(
            "support_score",
            F.least(
                F.lit(1.0),
                F.col("rerank_score") * 0.45
                + F.col("source_score") * 0.35
                + F.col("rrf_score") * 0.20,
            ),
        )
        .drop(
            "query_tokens",
            "content_tokens",
            "title_tokens",
            "source_authority",
            "extraction_quality",
            "published_at",
        )
    )


def confident(scored: DataFrame, threshold: float = K.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Keep passing candidates, best support first, as ``result_rank``.

    When none passes but a lexical candidate exists, the single best one stays;
    without a lexical candidate nothing does.
    """
    attempt = Window.partitionBy(*ATTEMPT)
    best = attempt.orderBy(F.round("support_score", ORDER_DECIMALS).desc(), "fused_rank")
    passes = F.col("support_score") >= threshold
    ranked = (
        scored.withColumn("result_rank", F.row_number().over(best))
        .withColumn("any_passes", F.max(passes).over(attempt))
        .withColumn("any_lexical", F.max(F.col("lex_rank").isNotNull()).over(attempt))
    )
    fallback = ~F.col("any_passes") & F.col("any_lexical") & (F.col("result_rank") == 1)
    return ranked.filter(passes | fallback).drop("any_passes", "any_lexical")


def with_provenance(kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add content and provenance to the rows that survived the filter."""
    return kept.join(chunks.select("chunk_id", *PROVENANCE), "chunk_id")
