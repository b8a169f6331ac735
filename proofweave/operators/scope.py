"""Access scopes: tenants, principals and the authorised chunk set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofweave import constants as K
from proofweave.functions import text as tx


def normalize_principals(principals: Column) -> Column:
    """Trim and de-duplicate, first occurrence wins."""
    return F.array_distinct(F.transform(principals, tx.strip))


def scope_problem(actor_id: Column, principals: Column) -> Column:
    """Reason a scope is unusable, else null. Expects normalised principals."""
    return (
        F.when(tx.is_blank(actor_id), "actor is blank")
        .when(F.length(actor_id) > K.MAX_ACTOR, f"actor is longer than {K.MAX_ACTOR} characters")
        .when(
            principals.isNull()
            | (F.size(principals) == 0)
            | F.exists(principals, lambda p: p.isNull() | (p == "")),
            "no usable principal",
        )
        .when(F.size(principals) > K.MAX_PRINCIPALS, f"more than {K.MAX_PRINCIPALS} principals")
    )


def validated_scopes(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split questions into usable and rejected (with ``reason``)."""
    checked = questions.withColumn("principals", normalize_principals(F.col("principals")))
    checked = checked.withColumn("reason", scope_problem(F.col("actor_id"), F.col("principals")))
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def acl_rows(chunks: DataFrame) -> DataFrame:
    """Long-form access rows (chunk, tenant, principal) without repeats."""
    return chunks.select(
        "chunk_id",
        "enterprise_id",
        F.explode(normalize_principals(F.col("principals"))).alias("principal_id"),
    )


def replace_acl(current: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exact replacement: rows of re-ingested chunks are superseded as a set."""
    untouched = current.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return untouched.unionByName(acl_rows(chunks))


def active_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks whose version is active, with that version's provenance columns."""
    active = versions.filter(F.col("status") == "active").select(
        "version_id", "title", "version_label", "source_authority", "published_at"
    )
    return chunks.join(active, "version_id")


def authorized_chunks(scopes: DataFrame, chunks: DataFrame, acl: DataFrame) -> DataFrame:
    """All (scope, chunk) rows a scope may see.

    Principals are exploded first, so tenant, principal and chunk are all equi
    keys and no array test runs inside the join. A chunk reached through
    several principals appears once.
    """
    wanted = scopes.select(
        "scope_id", "enterprise_id", F.explode("principals").alias("principal_id")
    ).distinct()
    granted = acl.join(wanted, ["enterprise_id", "principal_id"]).select("scope_id", "chunk_id")
    return granted.distinct().join(chunks, "chunk_id")


def may_see(question_principals: Column, chunk_principals: Column) -> Column:
    """Row-level any-of test once tenant equality has been joined on."""
    return F.arrays_overlap(question_principals, chunk_principals)


def leaked_rows(results: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Returned (question, chunk) rows without a matching tenant and principal."""
    asked = questions.select(
        "question_id",
        F.col("enterprise_id").alias("asked_enterprise"),
        F.col("principals").alias("asked_principals"),
    )
    owned = chunks.select(
        "chunk_id",
        F.col("enterprise_id").alias("owner_enterprise"),
        F.col("principals").alias("owner_principals"),
    )
    allowed = (F.col("asked_enterprise") == F.col("owner_enterprise")) & may_see(
        F.col("asked_principals"), F.col("owner_principals")
    )
    return (
        results.select("question_id", "chunk_id")
        .join(asked, "question_id", "left")
        .join(owned, "chunk_id", "left")
        .filter(~F.coalesce(allowed, F.lit(False)))
        .select("question_id", "chunk_id")
    )
