"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key with more than one in HOT_SHARE of all rows is hot, so there are at
#: most HOT_SHARE hot keys: a broadcast of them has a proven bound.
HOT_SHARE = 1000


def table(spark, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read ``columns`` of a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def whole(column: Column | str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, or a variant that no column of ``frame`` has."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join ``facts`` (one row per ``key``) to ``rows`` without a hot task.

    ``weight`` is a column of ``facts``: how many of ``rows`` have the key. Hot
    keys meet a broadcast of at most HOT_SHARE rows; all others are shuffled,
    and none of those has more than one in HOT_SHARE of the rows. ``weight`` is
    among the columns added. Rows with a null key get null facts.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE > F.lit(total)
    names = [c for c in facts.columns if c != key]
    held = F.broadcast(
        facts.filter(hot).select(F.col(key).alias("_hot"), F.struct(*names).alias("_held"))
    )
    met = rows.join(held, rows[key] == held["_hot"], "left").drop("_hot")
    cold = facts.filter(~hot).select(F.col(key).alias("_cold"), F.struct(*names).alias("_more"))
    # A row that is served already takes a key of its own that nothing equals.
    out = met.withColumn(
        "_key",
        F.when(F.col("_held").isNull() & F.col(key).isNotNull(), F.to_json(F.struct(F.col(key).alias("k"))))
        .otherwise(F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string"))),
    ).join(
        cold.withColumn("_key", F.to_json(F.struct(F.col("_cold").alias("k")))), "_key", "left"
    )
    value = F.coalesce("_held", "_more")
    return out.select(*rows.columns, *(value[n].alias(n) for n in names))


def meet(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join on ``key`` (unique in ``facts``); hot keys, at most HOT_SHARE, meet a broadcast."""
    hot = facts.filter(F.col(weight) * HOT_SHARE > total)
    if hot.isEmpty():
        return rows.join(facts, key)
    names = hot.select(key)
    cold = rows.join(F.broadcast(names), key, "left_anti").join(facts, key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))
