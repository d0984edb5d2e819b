"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import SPACES, store, whole
from jobscope.ordering import number_rows

SHARE, MOST_EPOCHS, SEED = 1.5, 2.0, "mix"
WEIGHTS = (3.0, 1.0, 2.0)
#: Hash prefixes (hex digits) by which documents of a source are summed before any are ordered.
PREFIX = 3


def word_count(text: str = "text") -> Column:
    """Runs of non-space characters; null has none."""
    trimmed = F.regexp_replace(F.regexp_replace(whole(text), rf"^{SPACES}", ""), rf"{SPACES}$", "")
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("bigint")


def draw(key: str = "doc_id") -> Column:
    """The seeded order of documents within a source; those without a key come as one more value."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """``target`` for each row of ``sources`` (size, weight): shares of ``total`` by weight, none above its cap.

    Sources over ``MOST_EPOCHS`` times their size are clamped and their excess is dealt among the others by weight,
    until none is above.  The level of the last round is the only one at which clamping what exceeds it spends the
    total; each round is one aggregate over the sources that are left.
    """
    capped = sources.withColumn("cap", F.col("size") * MOST_EPOCHS)
    level, filled = 0.0, -1
    while True:
        over = F.col("cap") <= level * F.col("weight")
        row = capped.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("spent"),
                         F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if row["n"] == filled or not row["weights"]:
            break
        filled, level = row["n"], (total - (row["spent"] or 0.0)) / row["weights"]
    return capped.withColumn("target", F.least("cap", F.col("weight") * level)).drop("cap")


def weigh_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source, size, weight, target``: weights are dealt in the order of the sources' code points, null last."""
    sizes = store(docs.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    numbered = number_rows(sizes, [], [F.col("source").isNull().alias("no"), F.substring("source", 1, 2).alias("head")],
                           [F.col("source").isNull(), F.col("source")], "nth")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = store(numbered.select("source", "size", cycle.alias("weight")), "weights")
    total = weighed.agg(F.sum("size")).first()[0] or 0
    return water_fill(weighed, float(total) * share)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``.

    ``taken`` counts the words that the mix takes of a document: whole repetitions of every document, and one more of
    documents drawn in a seeded order until the rest of the target is reached.  The last one drawn is that which would
    lie nearer the target with than without.  The order comes from hashes, so reruns agree.  A source is summed by hash prefix
    first and only the prefix on the border is ordered, so that a source of any size spreads over all tasks.

    A null text has no words; a null source is a source of its own, ordered last; rows with equal keys and null keys
    are drawn in the order of their size.  An empty table gives an empty result; further columns are ignored.
    """
    own = store(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"),
                            draw().alias("draw")), "sizes")
    sources = store(weigh_sources(own, weights, share)
                    .withColumnRenamed("size", "source_size")
                    .withColumn("whole", F.when(F.col("source_size") > 0,
                                                F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
                    .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["_source"])
    prefix = F.substring("draw", 1, PREFIX).alias("prefix")
    earlier = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = (own.groupBy("source", prefix).agg(F.sum("size").alias("own"))
              .select(F.col("source").alias("_source"), F.col("prefix").alias("_prefix"),
                      F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("source", "prefix").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("prefix", prefix)
    placed = (placed.join(before, same(placed, before) & (F.col("prefix") == F.col("_prefix"))).drop("_source", "_prefix")
              .withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))))
    sources = sources.withColumnRenamed("source", "_source")
    once_more = (F.col("before") + F.col("size") / 2 <= F.col("rest")).cast("bigint")
    return placed.join(sources, same(placed, sources)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + once_more)).alias("taken"))
