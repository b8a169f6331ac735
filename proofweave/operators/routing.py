"""Choose how each question is answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofweave import constants as K
from proofweave.functions import text as tx
from proofweave.functions.spelling import corrected_query

COMPUTE, RETRIEVE_THEN_COMPUTE, RAG = "compute", "retrieve-then-compute", "rag"


def correct(questions: DataFrame) -> DataFrame:
    """Add ``corrected_query`` (null when unchanged) and the text to act on."""
    return questions.withColumn("corrected_query", corrected_query(F.col("query_text"))).withColumn(
        "effective_text", F.coalesce("corrected_query", "query_text")
    )


def _mentions_hint(text: Column) -> Column:
    return F.lower(text).rlike("|".join(K.COMPUTE_HINTS))


FACTS = ("start_date", "end_date", "numbers", "wants_sum", "wants_mean", "has_hint")


def _facts(text: Column) -> Column:
    """What the patterns find in a question, looked up once."""
    start = F.nullif(F.regexp_extract(text, K.DAYS_BETWEEN_PATTERN, 1), F.lit(""))
    end = F.nullif(F.regexp_extract(text, K.DAYS_BETWEEN_PATTERN, 2), F.lit(""))
    numbers = F.transform(tx.extract_numbers(text), lambda n: n.cast("double"))
    wants_sum, wants_mean = text.rlike(K.SUM_PATTERN), text.rlike(K.MEAN_PATTERN)
    found = (start, end, numbers, wants_sum, wants_mean, _mentions_hint(text))
    return F.struct(*[value.alias(name) for name, value in zip(FACTS, found, strict=True)])


def route(questions: DataFrame, text_column: str = "effective_text") -> DataFrame:
    """Add route, function_name, numbers, start_date and end_date."""
    # A generated column: a filter on the route is not moved below it, where it
    # would take every pattern along again.
    facts = F.explode(F.array(tx.let(tx.strip(F.col(text_column)), _facts)))
    found = questions.withColumn("facts", facts).withColumns(
        {name: F.col("facts")[name] for name in FACTS}
    ).drop("facts")
    has_numbers = F.size("numbers") > 0
    # Inline numbers prefer the sum; retrieved numbers prefer the mean.
    rules = (
        (F.col("start_date").isNotNull(), COMPUTE, "dateDifference"),
        (has_numbers & F.col("wants_sum"), COMPUTE, "sum"),
        (has_numbers & F.col("wants_mean"), COMPUTE, "mean"),
        (F.col("has_hint") & F.col("wants_mean"), RETRIEVE_THEN_COMPUTE, "mean"),
        (F.col("has_hint") & F.col("wants_sum"), RETRIEVE_THEN_COMPUTE, "sum"),
    )
    decision = F.struct(F.lit(RAG).alias("route"), F.lit(None).cast("string").alias("fn"))
    for condition, name, function in reversed(rules):
        chosen = F.struct(F.lit(name).alias("route"), F.lit(function).alias("fn"))
        decision = F.when(condition, chosen).otherwise(decision)
    return (
        found.withColumn("decision", decision)
        .withColumn("route", F.col("decision.route"))
        .withColumn("function_name", F.col("decision.fn"))
        .drop("decision", "wants_sum", "wants_mean", "has_hint")
    )
