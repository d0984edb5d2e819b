"""Null-tolerant typed reads of listener JSON fields.

Fields are read as STRING, because a value may be a number, a numeric string or
something else; missing and JSON null both arrive here as NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_long(text: Column) -> Column:
    """``7``, ``"7"`` -> 7; ``7.9`` -> 7; ``true`` -> 1; anything else present -> 0; absent -> NULL."""
    whole = text.try_cast("bigint")
    fraction = text.try_cast("double").try_cast("bigint")
    return F.when(text.isNotNull(),
                  F.coalesce(whole, fraction, F.when(text == "true", F.lit(1)).otherwise(F.lit(0))).cast("bigint"))


def lenient_int(text: Column) -> Column:
    return F.coalesce(lenient_long(text).try_cast("int"), F.when(text.isNotNull(), F.lit(0)))


def lenient_bool(text: Column) -> Column:
    """``true`` or a non-zero number; everything else, absence included, is false."""
    return F.coalesce((F.trim(text) == "true") | (text.try_cast("double") != 0), F.lit(False))


def lenient_longs(texts: Sequence[Column]) -> Column:
    """Several fields at once, as an array.

    One small loop instead of the same expression once per field: the generated
    method of a wide projection would otherwise grow past the size up to which
    the JVM compiles methods.
    """
    return F.transform(F.array(*texts), lenient_long)
