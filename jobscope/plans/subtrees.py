"""Repeated subtrees inside one plan.

In pre-order a subtree is the slice of nodes starting at its root and as long
as the subtree.  Fingerprints, member lists and shapes are therefore functions
of one plan row; nothing is joined and no pairs of nodes leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.plan_text import normalize_plan_text
from jobscope.operators.sqlexec import EXECUTION

# What makes an operator worth pointing at.
INTERESTING = ("Exchange", "Join", "Aggregate", "Sort", "Scan")


def prepare(plans: DataFrame) -> DataFrame:
    """Per plan, arrays aligned with its nodes, computed once per node.

    ``tokens`` holds the normalised text that opens each node, ``opened`` the
    same behind the brackets that close since the node before it.
    """
    token = lambda n: F.concat(
        normalize_plan_text(n["node_name"]), F.lit("|"), normalize_plan_text(n["simple_string"]), F.lit("|["))
    named = lambda n: F.when(n.rlike(r"\S"), n)

    def lead(depth: Column, i: Column) -> Column:
        drop = F.get("depths", i - 1) - depth
        return F.when((i == 0) | (drop < 0), F.lit("")).otherwise(
            F.concat(F.repeat(F.lit("]"), F.greatest(drop + 1, F.lit(0))), F.lit(",")))

    staged = plans.select(
        *EXECUTION, F.transform("nodes", token).alias("tokens"),
        F.transform(F.col("nodes.node_name"), named).alias("names"), F.col("nodes.node_name").alias("raw_names"),
        F.col("nodes.depth").alias("depths"), F.col("nodes.subtree_size").alias("sizes"),
        F.col("nodes.subtree_depth").alias("heights"))
    return staged.withColumn("opened", F.zip_with(F.transform("depths", lead), "tokens", lambda a, b: F.concat(a, b)))


def _per_node(plans: DataFrame, *fields: Column) -> DataFrame:
    """One row per node; ``fields`` may use the aligned arrays, ``ord`` and ``subtree_size``."""
    placed = F.posexplode("sizes").alias("ord", "subtree_size")
    return prepare(plans).select("*", placed).select(*EXECUTION, "ord", *fields)


def subtree_text(ord_: Column, size: Column) -> Column:
    """``name|text|[child,child]`` of the subtree under a node; the order of children matters.

    A slice of the plan's own text: the first token without its lead, then all
    that follows inside the subtree, then the brackets still open.
    """
    return F.concat(
        F.get("tokens", ord_),
        F.array_join(F.slice("opened", ord_ + 2, size - 1), ""),
        F.repeat(F.lit("]"), F.get("depths", ord_ + size - 1) - F.get("depths", ord_) + 1))


def subtree_operators(ord_: Column, size: Column) -> Column:
    """Distinct operator names of the subtree under a node, in text order."""
    return F.sort_array(F.array_distinct(F.array_compact(F.slice("names", ord_ + 1, size))))


def subtree_fingerprints(plans: DataFrame) -> DataFrame:
    """The exact text fingerprint of every subtree."""
    return _per_node(plans, subtree_text(F.col("ord"), F.col("subtree_size")).alias("fingerprint"))


def subtree_members(plans: DataFrame) -> DataFrame:
    """For every node: size and depth of its subtree and the operators in it."""
    return _per_node(plans, F.col("subtree_size"), F.get("heights", F.col("ord")).alias("subtree_depth"),
                     subtree_operators(F.col("ord"), F.col("subtree_size")).alias("operators"))


def is_interesting(name: Column) -> Column:
    match = name.contains(INTERESTING[0])
    for marker in INTERESTING[1:]:
        match = match | name.contains(marker)
    return match


def subtree_digests() -> Column:
    """A digest of each node's subtree, in node order: that of its token and its children's digests.

    Nodes are folded from the last to the first.  Subtrees whose parent is still to come lie on a stack, the first child
    on top, so a node's children are those on it that are one deeper.  Each node is hashed once, however deep it lies.
    """
    last = F.size("tokens") - 1
    state = F.struct(F.array().cast("array<struct<ord:int,depth:int>>").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, i: Column) -> Column:
        depth = F.get("depths", i)
        children = F.filter(s["open"], lambda e: e["depth"] == depth + 1)
        inner = F.array_join(F.transform(children, lambda e: F.get(s["done"], last - e["ord"])), ",")
        rest = F.slice(s["open"], F.size(children) + 1, F.size(s["open"]))
        return F.struct(
            F.concat(F.array(F.struct(i.alias("ord"), depth.alias("depth"))), rest).alias("open"),
            F.concat(s["done"], F.array(F.sha2(F.concat(F.get("tokens", i), inner), 256))).alias("done"))

    order = F.sequence(last, F.lit(0), F.lit(-1))
    return F.reverse(F.aggregate(order, state, step, lambda s: s["done"]))


def duplicate_subtrees(plans: DataFrame) -> DataFrame:
    """Subtrees that occur at least twice in one plan, found without leaving the plan's row.

    Digests of all subtrees are sorted inside the row; equal neighbours form a
    group, whose first entry is its first subtree in pre-order.  ``fingerprint``
    is the digest; the text form is that of :func:`subtree_fingerprints`.
    """
    marked = F.transform("digests", lambda digest, ord_: F.struct(digest.alias("fingerprint"), ord_.alias("ord")))
    digests = prepare(plans.where(F.size("nodes") > 0)).withColumn("digests", subtree_digests()).withColumn(
        "marks", F.sort_array(marked))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("marks") - 1),
        lambda i: (i == 0) | (F.get("marks", i)["fingerprint"] != F.get("marks", i - 1)["fingerprint"]))
    group = F.transform("starts", lambda at, i: F.struct(
        F.get("marks", at)["fingerprint"].alias("fingerprint"), F.get("marks", at)["ord"].alias("first_ord"),
        (F.coalesce(F.get("starts", i + 1), F.size("marks")) - at).cast("bigint").alias("count")))
    repeated = (
        digests.withColumn("starts", starts)
        .select("*", F.explode(F.filter(group, lambda g: g["count"] >= 2)).alias("g")))
    first = F.col("g.first_ord")
    size = F.get("sizes", first)
    return repeated.select(
        *EXECUTION, "g.fingerprint", "g.count", F.coalesce(F.get("raw_names", first), F.lit("")).alias("root"),
        size.alias("subtree_size"), F.get("heights", first).alias("subtree_depth"),
        subtree_operators(first, size).alias("operators"), first.alias("first_ord"),
    ).withColumn("interesting", F.filter("operators", is_interesting))


def duplicate_rank() -> Column:
    """Largest first, then most frequent, deepest, by name, by position."""
    return F.struct(
        (-F.col("subtree_size")).alias("a"), (-F.col("count")).alias("b"), (-F.col("subtree_depth")).alias("c"),
        F.col("root").alias("d"), F.col("first_ord").alias("e"))
