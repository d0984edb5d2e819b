"""Plan graphs: labelled nodes and parent-child edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.display import has_text, metric_value, text_or_unknown
from jobscope.operators.sqlexec import EXECUTION
from jobscope.plans.flatten import plan_nodes

# Fixed value: labels per node before the remainder is only counted.
MAX_LABELS = 5


def _node_id(ord_: Column) -> Column:
    return F.concat(F.lit("n"), ord_.cast("string"))


def plan_graph_edges(plans: DataFrame) -> DataFrame:
    return plan_nodes(plans).where(F.col("parent_ord").isNotNull()).select(
        *EXECUTION, _node_id(F.col("parent_ord")).alias("parent"), _node_id(F.col("ord")).alias("child"))


def metric_labels(metrics: Column, values: Column) -> Column:
    """The first named metrics of a node with their values, then how many more the node has.

    ``values`` maps accumulators to values.  The remainder counts all metrics beyond the limit, unnamed ones included.
    """
    def label(m: Column) -> Column:
        value = F.try_element_at(values, m["accumulator_id"])
        return F.when(value.isNull(), m["name"]).otherwise(
            F.concat(m["name"], F.lit(": "), metric_value(value, m["metric_type"])))

    shown = F.transform(F.slice(F.filter(metrics, lambda m: has_text(m["name"])), 1, MAX_LABELS), label)
    more = F.when(F.size(metrics) > MAX_LABELS, F.array(
        F.concat(F.lit("+"), (F.size(metrics) - MAX_LABELS).cast("string"), F.lit(" more metrics"))))
    return F.concat(shown, F.coalesce(more, F.array().cast("array<string>")))


def plan_graph_nodes(plans: DataFrame, values: DataFrame) -> DataFrame:
    """Nodes with their labels.  The values of an execution, which are those of its plans' metrics, meet its plan as one
    map, and the rest happens in the plan's row."""
    entry = F.struct("accumulator_id", "value")
    known = values.where(F.col("accumulator_id").isNotNull()).groupBy(*EXECUTION).agg(
        F.map_from_entries(F.collect_list(entry)).alias("values"))
    named = plans.join(known, [*EXECUTION], "left").select(*EXECUTION, F.transform("nodes", lambda n: F.struct(
        n["ord"].alias("ord"), n["node_name"].alias("node_name"), n["simple_string"].alias("simple_string"),
        F.coalesce(metric_labels(n["metrics"], F.col("values")), F.array().cast("array<string>")).alias("labels"))).alias("nodes"))
    return named.select(*EXECUTION, F.inline("nodes")).select(
        *EXECUTION, _node_id(F.col("ord")).alias("node"), text_or_unknown(F.col("node_name")).alias("name"),
        F.when(~F.col("simple_string").eqNullSafe(F.col("node_name")), F.col("simple_string")).alias("detail"), "labels")
