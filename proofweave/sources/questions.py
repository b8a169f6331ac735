"""Bounds of questions: rejected with a reason, never shortened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofweave import constants as K
from proofweave.functions import text as tx


def question_problems(text: Column) -> Column:
    """Violated rules of a question's text, joined; empty if it is usable."""
    fits = F.coalesce(F.length(text).between(K.MIN_QUERY, K.MAX_QUERY), F.lit(False))
    blank = F.coalesce(tx.is_blank(text), F.lit(True))
    return F.concat_ws(
        "; ", F.when(~fits, F.lit("query length")), F.when(blank, F.lit("blank query"))
    )


def split_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable questions, and the others with ``reason``."""
    reason = question_problems(F.col("query_text"))
    return questions.filter(reason == ""), questions.withColumn("reason", reason).filter(
        F.col("reason") != ""
    )
