"""Exact duplicates: grouped by a 128-bit content hash, told apart by their bytes, the fullest row of each group kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import join_groups, store, whole

SPACE_CHARACTERS = "\x20\x09\x0a\x0b\x0c\x0d"
LAST_ID = (1 << 63) - 1

Digest = Callable[[Column], Column]


def content_hash(text: Column) -> Column:
    """128 bits, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def without_spaces(text: Column) -> Column:
    for character in SPACE_CHARACTERS:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def _classes(rows: DataFrame) -> DataFrame:
    """``rows`` without their texts, with a ``class`` that tells apart different texts of one digest.

    Copies are folded before the shuffle, so a group of any size reaches it as one row a task; then bytes are compared,
    as the texts themselves are keys of the grouping.  Where all texts of a digest are the same its class is -1.
    """
    texts = rows.groupBy("digest", "normal").agg(F.min("row").alias("class"))
    several = store(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"),
                    "several")
    same = F.lit(-1).cast("bigint").alias("class")
    narrow = rows.drop("normal")
    if several.isEmpty():
        return narrow.select("*", same)
    named = texts.join(several, "digest", "left_semi")
    return (narrow.join(several, "digest", "left_anti").select("*", same)
            .unionByName(rows.join(named, ["digest", "normal"]).drop("normal")))


def _decide(docs: DataFrame, key: str, text: str, digest: Digest, *more: Column) -> tuple[DataFrame, DataFrame]:
    """The stored rows, and ``row, doc_id, keep_id, group_size, kept, text_sha256`` for each of them."""
    normal = without_spaces(whole(text))
    rows = store(docs.select(
        F.col(key).alias("doc_id"), F.char_length(whole(text)).cast("bigint").alias("n_chars"), normal.alias("normal"),
        F.monotonically_increasing_id().alias("row"), *more)
        .withColumn("digest", digest(F.col("normal"))).withColumn("text_sha256", F.sha2(F.col("normal").cast("binary"), 256)),
        "copies")
    classes = _classes(rows.select("doc_id", "n_chars", "normal", "row", "digest", "text_sha256"))
    order = F.struct((-F.col("n_chars")).alias("fewer"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"),
                     "row", "doc_id")
    groups = store(classes.groupBy("digest", "class").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")),
                   "groups")
    return rows, join_groups(classes, groups, ["digest", "class"], "group_size").select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def group_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Digest = content_hash) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Texts are equal when identical without white space (space, U+0009 to U+000D).  Of equal texts the row with the most
    code points stays, then that with the smallest id, null last; of rows alike in both exactly one stays.  A null text
    counts as empty.  Empty tables give no rows; further columns are ignored.  ``digest`` only says which texts are
    compared: results don't depend on it.
    """
    decided = _decide(docs, key, text, digest)[1]
    return decided.select(F.col("doc_id").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def keep_one_copy(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged; choices as in ``group_copies``."""
    rows, decided = _decide(docs, key, text, content_hash, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("packed"))
    return rows.select("row", "packed").join(decided.filter("kept"), "row", "left_semi").select("packed.*")
