"""Reciprocal-rank fusion of ranked candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from proofweave import constants as K
from proofweave.functions.identity import compact_key, full_key
from proofweave.operators.lexical import ATTEMPT, FULL

# Rows of lexical lists up to which their keys, eight bytes each, are broadcast.
BROADCAST_LISTED = 2_000_000


def check_limits(top_k: int, rank_constant: int, candidate_limit: int = K.CANDIDATE_LIMIT) -> None:
    low, high = K.RERANK_TOP_K_RANGE
    if not low <= top_k <= high:
        raise ValueError(f"rerank top-k must stay within {low}-{high}")
    if rank_constant < 1:
        raise ValueError("rank constant must be positive")
    low, high = K.CANDIDATE_LIMIT_RANGE
    if not low <= candidate_limit <= high:
        raise ValueError(f"candidate limit must stay within {low}-{high}")


def _share(rank: str, rank_constant: int) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(rank_constant) + F.col(rank)), F.lit(0.0))


def placeable(vector: DataFrame, lexical: DataFrame, top_k: int) -> DataFrame:
    """The rows of ``vector`` that ``fuse`` can place, so that no others are shuffled.

    Behind ``top_k`` a row counts only if the question's ``lexical`` list has the chunk. Pairs
    are met by hash: one that agrees by chance stays, and ``fuse`` drops it. Longer lists
    than can be broadcast leave ``vector`` as it is.
    """
    pair = F.xxhash64("question_id", "chunk_id").alias("_pair")
    if lexical.limit(BROADCAST_LISTED + 1).count() > BROADCAST_LISTED:
        return vector
    listed = F.broadcast(lexical.select(pair).distinct().withColumn("_listed", F.lit(True)))
    met = vector.select("*", pair).join(listed, "_pair", "left")
    return met.filter((F.col("vec_rank") <= top_k) | F.col("_listed")).select(*vector.columns)


def fuse(
    lexical: DataFrame,
    vector: DataFrame,
    attempts: DataFrame,
    top_k: int = K.RERANK_TOP_K,
    rank_constant: int = K.RANK_CONSTANT,
    skip_settled: bool = False,
) -> DataFrame:
    """question_id, form, chunk_id, lex_rank, vec_rank, rrf_score, fused_rank.

    ``lexical`` has one list per (question, form), ``vector`` one per question
    that serves every form listed in ``attempts``. Equal scores keep the
    lexical list's order first, then the vector list's.

    Everything here is keyed by question, so one shuffle carries the whole
    fusion; the vector list is copied to the forms only after it. Chunk ids
    travel as ``compact_key``. With
    ``skip_settled`` retries of questions whose full form has a lexical match
    are left out: such a question always returns rows in its full form.
    """
    check_limits(top_k, rank_constant)
    no_rank = F.lit(None).cast("int")
    rows = (
        lexical.select(*ATTEMPT, "chunk_id", "lex_rank", no_rank.alias("vec_rank"))
        .unionByName(
            vector.select(
                "question_id",
                F.lit(None).cast("string").alias("form"),
                "chunk_id",
                no_rank.alias("lex_rank"),
                "vec_rank",
            )
        )
        .unionByName(
            attempts.select(
                *ATTEMPT,
                F.lit(None).cast("string").alias("chunk_id"),
                no_rank.alias("lex_rank"),
                no_rank.alias("vec_rank"),
            )
        )
        .withColumn("chunk_id", compact_key(F.col("chunk_id")))
        .repartition("question_id")
    )
    question = Window.partitionBy("question_id")
    forms = F.collect_set(F.when(F.col("chunk_id").isNull(), F.col("form"))).over(question)
    settled = F.max((F.col("form") == FULL) & F.col("lex_rank").isNotNull()).over(question)
    known = rows.withColumn("forms", forms)
    if skip_settled:
        known = known.withColumn(
            "forms",
            F.when(settled, F.array(F.lit(FULL))).otherwise(F.col("forms")),
        ).filter(F.col("form").isNull() | F.array_contains("forms", F.col("form")))
    copied = known.filter(F.col("chunk_id").isNotNull()).withColumn(
        "form",
        F.explode(
            F.when(F.col("form").isNull(), F.col("forms")).otherwise(F.array("form"))
        ),
    )
    merged = copied.groupBy(*ATTEMPT, "chunk_id").agg(
        F.min("lex_rank").alias("lex_rank"), F.min("vec_rank").alias("vec_rank")
    )
    # A vector-only candidate behind ``top_k`` others of its list cannot place.
    able = F.col("lex_rank").isNotNull() | (F.col("vec_rank") <= top_k)
    score = _share("lex_rank", rank_constant) + _share("vec_rank", rank_constant)
    order = Window.partitionBy(*ATTEMPT).orderBy(
        F.col("rrf_score").desc(),
        F.col("lex_rank").asc_nulls_last(),
        F.col("vec_rank").asc_nulls_last(),
        "chunk_id",
    )
    return (
        merged.filter(able)
        .withColumn("rrf_score", score)
        .withColumn("fused_rank", F.row_number().over(order))
        .filter(F.col("fused_rank") <= top_k)
        .withColumn("chunk_id", full_key(F.col("chunk_id")))
    )
