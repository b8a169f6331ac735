"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proofweave.operators.sizing import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b.

    Large: every larger neighbour of a node moves to the node's least
    neighbour. Small: a node and its smaller neighbours do.
    """
    if large:
        sides = edges.union(edges.select("b", "a")).toDF("node", "next")
    else:
        sides = edges.toDF("node", "next")
    least = sides.groupBy("node").agg(F.min("next").alias("least"))
    least = least.withColumn("least", F.least("node", "least"))
    joined = sides.join(least, "node")
    if large:
        moved = joined.filter(F.col("next") > F.col("node")).select(F.col("next").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("next").alias("a"), F.col("least").alias("b")).union(
            least.select("node", "least")
        )
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least.

    Each round is a written table, so a lost executor costs one round. The
    edge count never grows, and rounds are logarithmic in practice. Raises if
    ``max_rounds`` do not suffice, instead of returning a partial answer.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_star(_star(now, True), False), "star")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.union(now.select("b", "b").distinct())
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
