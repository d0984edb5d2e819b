"""Exact order statistics per stage attempt without gathering a stage's samples.

Equal samples are counted together first, so the shuffle carries one row per
distinct value and a stage of any size spreads over all tasks.  Then two passes
select: a histogram of fixed layout (log-linear, 256 buckets for each power of
two) finds the bucket of every wanted rank, and only the values of these buckets
are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.operators.attempts import ATTEMPT, SAMPLES

DIGIT_BITS = 21
BUCKET_BITS = 8
KEY = (*ATTEMPT, "metric")
STATISTICS = ("median", "p95", "p99")


def value_counts(tasks: DataFrame, samples: tuple[str, ...] = SAMPLES) -> DataFrame:
    """``(stage attempt, metric, value, n)`` over the first successes; absent samples do not count."""
    entries = F.array(*[F.struct(F.lit(s).alias("metric"), F.col(f"first.{s}").alias("value")) for s in samples])
    return (
        tasks.where(F.col("first").isNotNull())
        .select(*ATTEMPT, F.explode(entries).alias("sample"))
        .select(*ATTEMPT, "sample.metric", "sample.value").where(F.col("value").isNotNull())
        .groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("n"))
    )


def _nearest_rank(share: float, total: Column) -> Column:
    return F.least(total, F.greatest(F.lit(1), F.ceil(F.lit(share) * total))).cast("bigint")


def wanted_ranks(total: Column) -> Column:
    def entry(name: str, rank: Column) -> Column:
        return F.struct(F.lit(name).alias("stat"), rank.cast("bigint").alias("rank"))

    return F.array(
        entry("lower", F.shiftright(total + 1, 1)),
        entry("upper", F.shiftright(total, 1) + 1),
        entry("p95", _nearest_rank(0.95, total)),
        entry("p99", _nearest_rank(0.99, total)))


def histogram_bucket(value: Column) -> Column:
    """A number that rises with the value: each value below 512 has its own, above that 256 share a power of two."""
    size = F.greatest(value, value.bitwiseXOR(F.lit(-1)))
    power = F.floor(F.log2(F.greatest(size, F.lit(1 << BUCKET_BITS)))).cast("int")
    # where the logarithm of a number just below a power of two is rounded up, the quotient is one less, and the sum right
    place = F.call_function("shiftright", size, power - BUCKET_BITS) + F.shiftleft(power - BUCKET_BITS, BUCKET_BITS)
    return F.when(value < 0, -1 - place).otherwise(place)


def _hits(wanted: Column) -> Column:
    """The wanted ranks that fall on a row, counted from its start; ``_through`` counts up to its end."""
    start = F.col("_through") - F.col("n")
    met = F.filter(wanted, lambda w: (w["rank"] > start) & (w["rank"] <= F.col("_through")))
    return F.transform(met, lambda w: F.struct(w["stat"].alias("stat"), (w["rank"] - start).alias("rank")))


def order_statistics(counts: DataFrame) -> DataFrame:
    """One row per stage attempt and metric: sample count, median, p95, p99."""
    placed = counts.withColumn("bucket", histogram_bucket(F.col("value")))
    histogram = placed.groupBy(*KEY, "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*KEY)
    so_far = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = (
        histogram.withColumn("_total", F.sum("n").over(whole)).withColumn("_through", F.sum("n").over(so_far))
        .select(*KEY, "bucket", _hits(wanted_ranks(F.col("_total"))).alias("_wanted")).where(F.size("_wanted") > 0))
    inside = Window.partitionBy(*KEY, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        placed.join(wanted, [*KEY, "bucket"]).withColumn("_through", F.sum("n").over(inside))
        .select(*KEY, "value", F.explode(_hits(F.col("_wanted"))["stat"]).alias("stat")))

    def pick(stat: str) -> Column:
        return F.max(F.when(F.col("stat") == stat, F.col("value")))

    return (
        found.groupBy(*KEY)
        .agg(pick("lower").alias("lower"), pick("upper").alias("upper"),
             pick("p95").alias("p95"), pick("p99").alias("p99"))
        .select(*KEY, F.expr("lower + (upper - lower) div 2").alias("median"), "p95", "p99")
    )


def statistics_by_attempt(stats: DataFrame) -> DataFrame:
    """The same, one row per stage attempt, a column per metric and statistic."""
    columns = [
        F.max(F.when(F.col("metric") == sample, F.col(stat))).alias(f"{stat}_{sample}")
        for sample in SAMPLES for stat in STATISTICS
    ]
    return stats.groupBy(*ATTEMPT).agg(*columns)


def sorted_samples(counts: DataFrame) -> DataFrame:
    """All samples in ascending order, run-length encoded: value, its first rank, how often it occurs.

    The offset of every value prefix is found first, so no task orders more
    than one prefix of one metric.
    """
    split = counts.withColumn("middle", F.shiftright("value", DIGIT_BITS)).withColumn(
        "top", F.shiftright("value", 2 * DIGIT_BITS))
    middle = split.groupBy(*KEY, "top", "middle").agg(F.sum("n").alias("n"))
    top = middle.groupBy(*KEY, "top").agg(F.sum("n").alias("n"))

    def before(keys: tuple[str, ...], digit: str) -> Column:
        earlier = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(earlier), F.lit(0))

    top = top.select(*KEY, "top", before(KEY, "top").alias("_top"))
    middle = middle.join(top, [*KEY, "top"]).select(
        *KEY, "middle", (F.col("_top") + before((*KEY, "top"), "middle")).alias("_middle"))
    return split.drop("top").join(middle, [*KEY, "middle"]).select(
        *KEY, "value", (F.col("_middle") + before((*KEY, "middle"), "value") + 1).alias("first_rank"), "n")
