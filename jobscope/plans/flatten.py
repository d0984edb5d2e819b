"""Physical-plan trees as arrays of nodes in pre-order.

Spark has no recursive type, so a plan becomes one row with an array of nodes.
A plan arrives as one field of one event, so that array is no larger than the
event itself, and everything that concerns a single plan stays inside its row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_TYPE = ("struct<ord:int,depth:int,parent_ord:int,subtree_size:int,subtree_depth:int,node_name:string,"
             "simple_string:string,metrics:array<struct<name:string,accumulator_id:bigint,metric_type:string>>>")

_ARROW_METRIC = pa.struct([("name", pa.string()), ("accumulator_id", pa.int64()), ("metric_type", pa.string())])
_ARROW_NODE = pa.struct([
    ("ord", pa.int32()), ("depth", pa.int32()), ("parent_ord", pa.int32()), ("subtree_size", pa.int32()),
    ("subtree_depth", pa.int32()), ("node_name", pa.string()), ("simple_string", pa.string()),
    ("metrics", pa.list_(_ARROW_METRIC))])


def _text(value: object) -> str | None:
    if value is None:
        return None
    if not isinstance(value, str):
        return "" if isinstance(value, (dict, list)) else json.dumps(value)
    # JSON can name half a surrogate pair, which is no text
    return value.encode("utf-8", "replace").decode("utf-8")


def _long(value: object) -> int | None:
    """A whole number of 64 bits; what is none, or is out of range, counts as 0."""
    if value is None:
        return None
    try:
        number = int(float(value)) if isinstance(value, (float, str)) and "." in str(value) else int(value)
    except (TypeError, ValueError, OverflowError):
        return 0
    return number if -(1 << 63) <= number < 1 << 63 else 0


def flatten_tree(tree: object) -> list[dict]:
    """Nodes of one parsed plan in pre-order, with the size and depth of each subtree.

    A plan that is no object is one node without a name.
    """
    if not isinstance(tree, dict):
        tree = {}
    nodes: list[dict] = []
    stack = [(tree, 1, None)]
    while stack:
        node, depth, parent = stack.pop()
        at = len(nodes)
        metrics = node.get("metrics")
        children = node.get("children")
        nodes.append({
            "ord": at, "depth": depth, "parent_ord": parent, "subtree_size": 1, "subtree_depth": 1,
            "node_name": _text(node.get("nodeName")), "simple_string": _text(node.get("simpleString")),
            "metrics": [{"name": _text(m.get("name")), "accumulator_id": _long(m.get("accumulatorId")),
                         "metric_type": _text(m.get("metricType"))}
                        for m in (metrics if isinstance(metrics, list) else []) if isinstance(m, dict)]})
        kept = [c for c in (children if isinstance(children, list) else []) if isinstance(c, dict)]
        stack.extend((child, depth + 1, at) for child in reversed(kept))
    for node in reversed(nodes):
        if node["parent_ord"] is not None:
            parent = nodes[node["parent_ord"]]
            parent["subtree_size"] += node["subtree_size"]
            parent["subtree_depth"] = max(parent["subtree_depth"], node["subtree_depth"] + 1)
    return nodes


def parse_plan(text: str) -> list[dict] | None:
    """Nodes of a plan's text; a bare word is no object, and a tree too deep to be read gives no plan."""
    try:
        return flatten_tree(json.loads(text))
    except RecursionError:
        return None
    except ValueError:
        return flatten_tree(None)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [parse_plan(text) for text in batch.column("plan_json").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("log_id"), batch.column("execution_id"), pa.array(trees, pa.list_(_ARROW_NODE))],
            ["log_id", "execution_id", "nodes"])


def flatten_plans(plans: DataFrame) -> DataFrame:
    """``(log_id, execution_id, plan_json)`` to ``(log_id, execution_id, nodes)``; no shuffle."""
    return (
        plans.where(F.col("plan_json").isNotNull()).select("log_id", "execution_id", "plan_json")
        .mapInArrow(_flatten, f"log_id string, execution_id bigint, nodes array<{NODE_TYPE}>")
        .where(F.col("nodes").isNotNull())
    )


def plan_nodes(plans: DataFrame) -> DataFrame:
    return plans.select("log_id", "execution_id", F.inline("nodes"))


def plan_metrics(plans: DataFrame) -> DataFrame:
    """One row per metric of each node, in node order."""
    return (
        plan_nodes(plans).select("log_id", "execution_id", "ord", F.posexplode("metrics").alias("pos", "m"))
        .select("log_id", "execution_id", "ord", "pos", F.col("m.name").alias("metric_name"),
                "m.accumulator_id", "m.metric_type")
    )
