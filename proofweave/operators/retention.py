"""Expiry of raw content and of whole traces."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofweave import constants as K
from proofweave.operators.sizing import materialize
from proofweave.sources.dated import DatedTable


def raw_content_expired(as_of: dt.datetime) -> Column:
    return (F.col("raw_content_expires_at") <= F.lit(as_of)) & (
        F.col("raw_query") != K.EXPIRED_TEXT
    )


def redact(traces: DataFrame, as_of: dt.datetime, strict: bool = False) -> DataFrame:
    """Blank raw strings of expired traces; a second run changes nothing.

    ``was_redacted`` marks the rows changed by this run. ``strict`` also clears
    claims, citations and the corrected query.
    """
    fields = ["model_inputs", "retrieved_text"]
    if strict:
        fields += ["claims", "citations", "corrected_query"]
    payload_type = traces.schema["payload"].dataType
    cleared = F.col("payload")
    for name in fields:
        if name in payload_type.names:
            cleared = cleared.withField(name, F.lit(None).cast(payload_type[name].dataType))
    expired = F.col("was_redacted")
    return (
        traces.withColumn("was_redacted", raw_content_expired(as_of))
        .withColumn("raw_query", F.when(expired, K.EXPIRED_TEXT).otherwise(F.col("raw_query")))
        .withColumn("raw_response", F.when(~expired, F.col("raw_response")))
        .withColumn("payload", F.when(expired, cleared).otherwise(F.col("payload")))
    )


def purge(traces: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Traces that have not expired."""
    return traces.filter(F.col("expires_at") > F.lit(as_of))


def unlink_audit(audit: DataFrame, surviving: DataFrame) -> DataFrame:
    """Audit rows survive a purge; pointers to purged traces become null."""
    known = surviving.select(
        F.col("trace_id").alias("trace_memory_id"), F.lit(True).alias("trace_survives")
    )
    return (
        audit.join(known, "trace_memory_id", "left")
        .withColumn("trace_memory_id", F.when(F.col("trace_survives"), F.col("trace_memory_id")))
        .drop("trace_survives")
    )


def redact_stored(
    spark: SparkSession, traces: DatedTable, as_of: dt.datetime, number: int, strict: bool = False
) -> int:
    """Redact a stored table in place; the count of rewritten days, 0 if run again."""
    return traces.change(
        spark,
        lambda rows: rows.filter(raw_content_expired(as_of)),
        lambda rows: redact(rows, as_of, strict).drop("was_redacted"),
        number,
    )


def purge_stored(
    spark: SparkSession, traces: DatedTable, audit: DatedTable, as_of: dt.datetime, number: int
) -> int:
    """Purge expired traces in place and clear the pointers of their audit rows.

    Pointers go first, so a run that is cut off between the two tables still
    finds its traces expired and repeats the rest. Returns rewritten days.
    """
    held = traces.read(spark)
    if held is None:
        return 0
    gone = held.filter(F.col("expires_at") <= F.lit(as_of)).select(F.col("trace_id").alias("trace_memory_id"))
    gone = materialize(gone, "purged")

    def unlinked(rows: DataFrame) -> DataFrame:
        marked = rows.join(gone.withColumn("is_gone", F.lit(True)), "trace_memory_id", "left")
        pointer = F.when(F.col("is_gone").isNull(), F.col("trace_memory_id"))
        return marked.withColumn("trace_memory_id", pointer).select(*rows.columns)

    days = audit.change(spark, lambda rows: rows.join(gone, "trace_memory_id", "left_semi"), unlinked, number)
    return days + traces.change(
        spark, lambda rows: rows.filter(F.col("expires_at") <= F.lit(as_of)), lambda rows: purge(rows, as_of), number
    )
