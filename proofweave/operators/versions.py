"""Version lifecycle: staging, completeness, activation and rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest_activation(requests: DataFrame) -> DataFrame:
    """The last activated version per (tenant, document)."""
    return (
        requests.groupBy("enterprise_id", "document_id")
        .agg(F.max(F.struct("activation_seq", "version_id")).alias("latest"))
        .select("enterprise_id", "document_id", F.col("latest.version_id").alias("version_id"))
    )


def reconcile_chunks(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored chunks of re-run versions without the stale ones.

    ``expected`` holds (version_id, chunk_id); versions it does not mention keep
    all their chunks.
    """
    rerun = expected.select("version_id").distinct()
    stale = stored.join(rerun, "version_id", "left_semi").join(
        expected, ["version_id", "chunk_id"], "left_anti"
    )
    return stored.join(stale.select("chunk_id"), "chunk_id", "left_anti")


def completeness(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Per version: stored and expected chunk counts, and whether they agree.

    ``expected``: version_id, expected_chunks.
    """
    have = stored.groupBy("version_id").agg(F.count(F.lit(1)).alias("stored_chunks"))
    stored_chunks = F.coalesce("stored_chunks", F.lit(0)).cast("long")
    return expected.join(have, "version_id", "left").select(
        "version_id",
        stored_chunks.alias("stored_chunks"),
        "expected_chunks",
        ((stored_chunks == F.col("expected_chunks")) & (F.col("expected_chunks") > 0)).alias(
            "is_complete"
        ),
    )


def activate(requests: DataFrame, complete: DataFrame) -> DataFrame:
    """Status of every version after applying activation requests in order.

    ``requests``: enterprise_id, document_id, version_id, activation_seq. A
    version may be requested again later, which brings it back and supersedes
    whatever replaced it. Incomplete versions stay ``processing`` and supersede
    nothing.
    """
    checked = requests.join(complete.select("version_id", "is_complete"), "version_id", "left")
    checked = checked.withColumn("is_complete", F.coalesce("is_complete", F.lit(False)))
    latest = checked.groupBy("enterprise_id", "document_id", "version_id").agg(
        F.max("activation_seq").alias("activation_seq"),
        F.max("is_complete").alias("is_complete"),
    )
    order = Window.partitionBy("enterprise_id", "document_id").orderBy(
        F.col("is_complete").desc(), F.col("activation_seq").desc(), "version_id"
    )
    status = (
        F.when(~F.col("is_complete"), "processing")
        .when(F.row_number().over(order) == 1, "active")
        .otherwise("superseded")
    )
    return latest.withColumn("status", status).drop("is_complete")


def purge_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Cascade: keep only children whose parent survives."""
    return children.join(parents.select(key), key, "left_semi")
