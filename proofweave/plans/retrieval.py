"""Hybrid retrieval as one plan over many questions and tenants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from proofweave import constants as K
from proofweave.functions import text as tx
from proofweave.operators import fusion, lexical, rerank, vector
from proofweave.operators.lexical import FOCUSED, FULL
from proofweave.operators.sizing import materialize

QUESTION_COLUMNS = ("question_id", "enterprise_id", "principals", "query_text", "embedding")


def attempts(questions: DataFrame) -> DataFrame:
    """The full question and, where it differs, its focused retry.

    Both forms run through the plan together; the retry's rows count only when
    the full question returns nothing. That keeps the vector stage, which both
    share, from running twice.
    """
    forms = F.array(
        F.struct(F.lit(FULL).alias("form"), F.col("query_text").alias("text")),
        F.struct(F.lit(FOCUSED).alias("form"), tx.focused_query(F.col("query_text")).alias("text")),
    )
    return (
        questions.withColumn("attempt", F.explode(forms))
        .filter(F.col("attempt.text").isNotNull())
        .select(
            "question_id",
            F.col("attempt.form").alias("form"),
            "enterprise_id",
            "principals",
            F.col("attempt.text").alias("query_text"),
        )
    )


def candidates(
    tried: DataFrame,
    questions: DataFrame,
    chunks: DataFrame,
    index: DataFrame,
    candidate_limit: int = K.CANDIDATE_LIMIT,
    top_k: int = K.RERANK_TOP_K,
    rank_constant: int = K.RANK_CONSTANT,
    dimension: int = K.EMBEDDING_DIMENSION,
    skip_settled: bool = False,
) -> DataFrame:
    """Fused candidates per attempt; the vector list serves both forms.

    Lexical lists and the fusion are written, so that shuffles of one step end before the next.
    """
    fusion.check_limits(top_k, rank_constant, candidate_limit)
    by_vector = vector.vector_top(questions, chunks, candidate_limit, dimension)
    by_terms = materialize(lexical.lexical_top(tried, index, candidate_limit), "lexical")
    by_vector = fusion.placeable(by_vector, by_terms, top_k)
    return materialize(fusion.fuse(by_terms, by_vector, tried, top_k, rank_constant, skip_settled), "fused")


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    index: DataFrame,
    as_of: dt.datetime = K.AS_OF,
    threshold: float = K.CONFIDENCE_THRESHOLD,
    **limits: int,
) -> DataFrame:
    """Authorised evidence per question, best first (``result_rank`` from 1).

    ``questions``: question_id, enterprise_id, principals, query_text, embedding.
    ``chunks``/``index``: active chunks and their search index.
    """
    # Several branches read the questions; embedding them happens once.
    questions = materialize(questions.select(*QUESTION_COLUMNS), "questions")
    tried = attempts(questions)
    fused = candidates(tried, questions, chunks, index, skip_settled=True, **limits)
    scored = rerank.score_candidates(fused, tried, chunks, as_of)
    # One shuffle by question serves the windows per attempt and per question.
    kept = rerank.confident(scored.repartition("question_id"), threshold)
    return rerank.with_provenance(first_answering_form(kept), chunks)


def first_answering_form(kept: DataFrame) -> DataFrame:
    """Rows of the full question, or of its retry when it returned nothing."""
    has_full = F.max(F.col("form") == FULL).over(Window.partitionBy("question_id"))
    return (
        kept.withColumn("has_full", has_full)
        .filter((F.col("form") == FULL) | ~F.col("has_full"))
        .drop("has_full")
    )
