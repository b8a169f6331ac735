"""Validation of component graphs over tables of definitions."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from proofweave import constants as K
from proofweave.functions import identity as ids


NODE_FIELDS = ("node_id", "component_type", "component_version", "input_schema", "output_schema")


def has_cycle(sources: Iterable[str], targets: Iterable[str]) -> bool:
    """Whether the edges contain a cycle; linear in their number.

    Nodes that no remaining edge enters are taken away; what cannot be taken
    away lies on or behind a cycle.
    """
    leaving, entering = defaultdict(list), Counter()
    for source, target in zip(sources, targets):
        leaving[source].append(target)
        entering[target] += 1
    free = [node for node in leaving if not entering[node]]
    while free:
        for target in leaving.pop(free.pop(), ()):
            entering[target] -= 1
            if not entering[target]:
                free.append(target)
    return any(entering.values())


def graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per definition: ``nodes`` and ``edges`` as arrays of structs.

    A definition is one document, so its parts fit a row; they meet in one shuffle.
    """
    node = F.struct(*NODE_FIELDS, "capabilities")
    edge = F.struct("source_node_id", "target_node_id")
    told = nodes.select("definition_id", node.alias("node")).unionByName(
        edges.select("definition_id", edge.alias("edge")), allowMissingColumns=True
    )
    return told.groupBy("definition_id").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("edge").alias("edges")
    )


def cyclic(edges: Column) -> Column:
    """True where the array of edges contains a cycle."""

    @F.pandas_udf("boolean")
    def judged(sources: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([has_cycle(*ends) for ends in zip(sources, targets)], dtype=bool)

    return judged(edges["source_node_id"], edges["target_node_id"])


def _out_of_bounds(text: Column, most: int | None) -> Column:
    length = F.coalesce(F.length(text), F.lit(0))
    return length < 1 if most is None else ~length.between(1, most)


def _bounds(most: int | None) -> str:
    return "at least 1 character" if most is None else f"1-{most} characters"


def _name_problem() -> Column:
    low, high = K.RERANK_TOP_K_RANGE
    return F.when(
        _out_of_bounds(F.col("name"), K.NAME_LENGTH), f"name must have {_bounds(K.NAME_LENGTH)}"
    ).when(
        ~F.coalesce(F.col("rerank_top_k").between(low, high), F.lit(False)),
        f"rerankTopK must stay within {low}-{high}",
    )


def _part_problem() -> Column:
    """The first broken bound of the nodes' fields, then of the edges' ends."""
    problem = F.lit(None).cast("string")
    for field in reversed(("source_node_id", "target_node_id")):
        broken = F.exists("edges", lambda e: _out_of_bounds(e[field], None))
        problem = F.when(broken, f"an edge's {field} must have {_bounds(None)}").otherwise(problem)
    known = F.array(*[F.lit(name) for name in K.CAPABILITIES])
    unknown = F.exists(
        "nodes", lambda n: F.size(F.array_except(F.coalesce(n["capabilities"], F.array()), known)) > 0
    )
    problem = F.when(unknown, "a node has an unknown capability").otherwise(problem)
    for field in reversed(NODE_FIELDS):
        most = K.NODE_FIELD_LENGTHS[field]
        broken = F.exists("nodes", lambda n: _out_of_bounds(n[field], most))
        problem = F.when(broken, f"a node's {field} must have {_bounds(most)}").otherwise(problem)
    return problem


def validate_definitions(
    definitions: DataFrame, nodes: DataFrame, edges: DataFrame
) -> DataFrame:
    """definition_id, problem (null when valid), missing capabilities (null without nodes).

    All rules of a definition are judged inside its row, so the work is one
    shuffle of nodes and edges, whatever the length of a path.
    """
    held = F.flatten(F.transform("nodes", lambda n: F.coalesce(n["capabilities"], F.array())))
    mandatory = F.array(*[F.lit(name) for name in K.MANDATORY_CAPABILITIES])
    ends = F.concat(F.col("edges")["source_node_id"], F.col("edges")["target_node_id"])
    names = F.col("nodes")["node_id"]
    judged = graphs(nodes, edges).select(
        "definition_id",
        (F.size("nodes") > 0).alias("has_nodes"),
        _part_problem().alias("part_problem"),
        (F.size(F.array_distinct(names)) < F.size("nodes")).alias("has_duplicates"),
        (F.size(F.array_except(ends, names)) > 0).alias("has_dangling"),
        F.when(F.size("nodes") > 0, F.array_sort(F.array_except(mandatory, held))).alias("missing"),
        cyclic(F.col("edges")).alias("has_cycle"),
    )
    lacking = F.concat(
        F.lit("capabilities not covered: "), F.array_join("missing", ", ")
    )
    name_problem = _name_problem()
    problem = (
        F.when(name_problem.isNotNull(), name_problem)
        .when(~F.coalesce("has_nodes", F.lit(False)), "no nodes")
        .when(F.col("part_problem").isNotNull(), F.col("part_problem"))
        .when(F.col("has_duplicates"), "a node id repeats")
        .when(F.col("has_dangling"), "an edge leads to no node")
        .when(F.size("missing") > 0, lacking)
        .when(F.col("has_cycle"), "the edges form a cycle")
    )
    return definitions.join(judged, "definition_id", "left").select(
        "definition_id", problem.alias("problem"), "missing"
    )


def definition_hashes(
    definitions: DataFrame, nodes: DataFrame, edges: DataFrame
) -> DataFrame:
    """Canonical digest per definition; capabilities are hashed in sorted order.

    A node's optional ``config`` (map of strings) is hashed with sorted keys.

    ``position`` orders nodes and edges. A definition is one hashed document, so
    its parts are brought together per definition.
    """
    text = ids.json_string
    node_json = ids.json_object(
        id=text(F.col("node_id")),
        componentType=text(F.col("component_type")),
        componentVersion=text(F.col("component_version")),
        capabilities=ids.json_array(F.array_sort("capabilities")),
        config=ids.json_map(F.col("config")) if "config" in nodes.columns else F.lit("{}"),
        inputSchema=text(F.col("input_schema")),
        outputSchema=text(F.col("output_schema")),
    )
    edge_json = ids.json_object(
        sourceNodeId=text(F.col("source_node_id")), targetNodeId=text(F.col("target_node_id"))
    )

    def listed(frame: DataFrame, body: Column, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("position", body.alias("body"))))
        joined = F.array_join(F.transform(ordered, lambda item: item["body"]), ",")
        return frame.groupBy("definition_id").agg(
            F.concat(F.lit("["), joined, F.lit("]")).alias(name)
        )

    whole = (
        definitions.join(listed(nodes, node_json, "nodes"), "definition_id", "left")
        .join(listed(edges, edge_json, "edges"), "definition_id", "left")
    )
    document = ids.json_object(
        name=text(F.col("name")),
        nodes=F.coalesce("nodes", F.lit("[]")),
        edges=F.coalesce("edges", F.lit("[]")),
        rerankTopK=F.col("rerank_top_k").cast("string"),
    )
    return whole.select("definition_id", ids.digest(document).alias("definition_hash"))
