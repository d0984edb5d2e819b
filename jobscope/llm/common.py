"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.session import materialize

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
#: A group that holds over one in so many rows is hot; fewer groups than that can be.
HOT_SHARE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The whole text; a missing one is empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def document_key() -> Column:
    """Tells documents apart and orders them: by doc_id, null last, then by text.  Repeated rows are one document."""
    no_id = F.lit((1 << 63) - 1)
    return F.struct(F.coalesce(F.col("doc_id").cast("bigint"), no_id).alias("id"), F.xxhash64("text").alias("told"))


def store(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts lineage and survives lost executors."""
    return materialize(df, f"llm-{label}")


def packed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as one column ``row``, so that no name of its columns meets those an operator works with, and ``more``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of ``row`` again, some of them replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in columns]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group, where one group may hold a third of all rows.

    ``groups`` is stored, holds each row's group once and its number of rows in ``size``.  Those with more than one in
    ``HOT_SHARE`` rows are fewer than ``HOT_SHARE``, so they are broadcast; the rows of all others are shuffled, and no
    key of these is large.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = total // HOT_SHARE + 1
    hot = groups.filter(F.col(size) > least).withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), keys, "left")
    columns = [*rows.columns, *[c for c in groups.columns if c not in rows.columns]]
    rest = met.filter("_hot is null").select(*rows.columns).join(groups.filter(F.col(size) <= least), keys)
    return met.filter("_hot").select(*columns).unionByName(rest.select(*columns))


def spans_text(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def rows_of(batch: pa.RecordBatch, size: int) -> Iterator[dict[str, list[Any]]]:
    """Columns of a batch as Python lists, a few rows at a time, so that only few texts are decoded at once."""
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
