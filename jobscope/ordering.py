"""Event order.

``seq`` orders the events of one log.  It is one number of fixed width, taken on the scan before any shuffle: the place of
a file among those of its log, then the place of the line in the file.  A line's place is the byte at which its block
starts plus its number in the block, or the byte at which the line starts: lines take at least a byte each, so either
keeps their order and is dense.  Aggregates over it keep it in place, without sorting.

Events that come from tables are ordered by several of their columns, for which 64 bits are too few.  Their ``seq`` is a
whole decimal of fixed width, which aggregates keep in place as well: a major number and, below it, a minor one.

``seq_bucket`` maps it to a coarser, order-preserving bucket with a bounded number of events, which lets running
computations over one log or one stage be split: first over the few buckets, then inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

SEQ_TYPE = "bigint"
#: Bits of a line's place in its file, and of a file's place in its log.
LINE_BITS = 40
FILE_BITS = 23
BUCKET_BITS = 20
#: Bits of the minor number of a wide key.
MINOR_BITS = 62


def make_seq(file_place: Column, line_place: Column) -> Column:
    """Places beyond the range are taken as the last one."""
    file_place = F.least(file_place.cast("bigint"), F.lit((1 << FILE_BITS) - 1))
    line_place = F.least(line_place.cast("bigint"), F.lit((1 << LINE_BITS) - 1))
    return F.shiftleft(file_place, LINE_BITS).bitwiseOR(line_place)


def make_wide_seq(major: Column, minor: Column) -> Column:
    return major.cast("decimal(20,0)") * F.lit(1 << MINOR_BITS) + minor.cast("decimal(20,0)")


def seq_bucket(seq: Column, rows: DataFrame | None = None) -> Column:
    """A megabyte of a plain file, or 2**20 lines of a compressed one; the major number if ``rows`` have a wide key."""
    if rows is not None and isinstance(rows.select(seq).schema[0].dataType, DecimalType):
        return F.call_function("div", seq, F.lit(1 << MINOR_BITS))
    return F.shiftright(seq, BUCKET_BITS)


def number_rows(df: DataFrame, group: Sequence[str], bucket: Sequence[Column],
                order: Sequence[Column], name: str) -> DataFrame:
    """Exact 1-based row number per ``group`` without sorting a whole group in one task.

    ``bucket`` must be a non-decreasing function of ``order``.  Bucket sizes are
    counted with a pre-aggregated group-by, turned into offsets over the short
    bucket list, and added to the row number inside each bucket.
    """
    names = [f"_bucket_{i}" for i in range(len(bucket))]
    keyed = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)])
    keys = [*group, *names]
    earlier = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_offset")
    )
    condition = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    inside = Window.partitionBy(*keys).orderBy(*order)
    return keyed.join(offsets, condition).select(
        *df.columns, (F.col("_offset") + F.row_number().over(inside)).alias(name))


def count_places(df: DataFrame, group: Sequence[str], seq: str = "seq") -> DataFrame:
    """Per ``group`` its ``lines`` and at how many different ``places`` they are.

    The places of 64 neighbours are the bits of one number, so lines are combined before they are shuffled.
    """
    place = F.col(seq)
    words = df.groupBy(*group, F.shiftright(place, 6).alias("_word")).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))).alias("_bits"))
    return words.groupBy(*group).agg(
        F.sum("_lines").alias("lines"), F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).cast("bigint").alias("places"))


def carry_forward(df: DataFrame, group: Sequence[str], seq: str, value: str, name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row's ``seq`` within ``group``.

    The value each bucket hands to its successors is found by a pre-aggregated
    ``max_by``; only the short list of buckets and the rows of one bucket are
    ever ordered together.
    """
    keyed = df.withColumn("_bucket", seq_bucket(F.col(seq), df))
    earlier = (Window.partitionBy(*group).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    handed = (
        keyed.groupBy(*group, "_bucket")
        .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(seq))).alias("_last"))
        .select(*group, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
    )
    inside = (Window.partitionBy(*group, "_bucket").orderBy(seq)
              .rowsBetween(Window.unboundedPreceding, 0))
    return (
        keyed.join(handed, [*group, "_bucket"], "left")
        .select(*df.columns,
                F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_handed")).alias(name))
    )
