"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Copies are combined three times: within each task (the map side of the first
grouping), within salted digest groups, and across salts. Every grouping is by
digest and by the whole normalised content, so equal digests alone never merge
texts, and no task holds more than one salt's share of a hot group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from proofweave.llm.common import attach, fresh, whole
from proofweave.operators.sizing import materialize

#: White space that does not count when texts are compared.
SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text: Column) -> Column:
    """``text`` without white space. Plain replaces are faster than a pattern."""
    for char in SPACE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicate_groups(
    docs: DataFrame,
    salts: int = 64,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): one row per row of ``docs``.

    Null texts count as empty, and all empty texts are one group. The longest
    original text of a group stays, then the smallest doc_id; a null doc_id
    loses every tie. Rows that repeat doc_id and text are counted in
    group_size, and all rows of the staying doc_id have kept = true. No rows
    give no rows. Other columns of ``docs`` are not read.
    """
    texts = docs.select("doc_id", whole("text").alias("_text")).select(
        "doc_id",
        squeezed(F.col("_text")).alias("content"),
        F.length("_text").cast("long").alias("points"),
        F.pmod(F.xxhash64("doc_id", "_text"), F.lit(salts)).alias("salt"),
    )
    texts = texts.withColumn("digest", digest(F.col("content")))
    # The greatest (points, -doc_id) stays; nulls sort first, so they lose.
    salted = texts.groupBy("digest", "salt", "content").agg(
        F.max(F.struct("points", (-F.col("doc_id")).alias("rank"))).alias("best"),
        F.count("*").alias("n"),
    )
    merged = salted.groupBy("digest", "content").agg(
        F.max("best").alias("best"), F.sum("n").alias("group_size")
    )
    groups = materialize(
        merged.select("digest", (-F.col("best.rank")).alias("keep_id"), "group_size"), "exact"
    )
    facts = groups.groupBy("digest").agg(
        F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
        F.count("*").alias("contents"),
    )
    found = attach(texts.select("doc_id", "digest"), facts, "digest", "group_size")
    plain = found.filter("contents = 1").drop("contents")
    collided = facts.filter("contents > 1").select("digest")
    if not collided.isEmpty():
        plain = plain.unionByName(_collided(texts, groups, collided))
    return plain.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def _collided(texts: DataFrame, groups: DataFrame, collided: DataFrame) -> DataFrame:
    """Rows whose digest several contents share: matched by content."""
    mine = texts.join(collided, "digest", "left_semi")
    keepers = (
        mine.join(
            groups.withColumnRenamed("keep_id", "_keep"),
            (mine["digest"] == groups["digest"]) & mine["doc_id"].eqNullSafe(F.col("_keep")),
        )
        .select(mine["digest"], "content", F.col("_keep").alias("keep_id"), "group_size")
        .distinct()
    )
    return mine.join(keepers, ["digest", "content"]).select(
        "doc_id", "digest", "keep_id", "group_size"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Rows that repeat the staying doc_id and text are one row afterwards. Rows
    without doc_id stay only if no row of their group has one.
    """
    key = fresh(docs, "_key")
    decided = duplicate_groups(docs).filter("kept")
    kept = decided.select(
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), "digest")).alias(key)
    ).distinct()
    own = F.coalesce(
        F.col("doc_id").cast("string"), F.concat(F.lit("t"), sha256(squeezed(whole("text"))))
    )
    stay = docs.withColumn(key, own).join(kept, key, "left_semi")
    return stay.dropDuplicates([key, "text"]).select(*docs.columns)
