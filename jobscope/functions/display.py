"""Human-readable rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit boundaries and number formats of the rendered text.
KIB = 1024
MIB = 1024 * KIB
GIB = 1024 * MIB
TIB = 1024 * GIB
SECOND = 1000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
SHORT_DECIMAL = "#,##0.#"
ONE_DECIMAL = "#,##0.0"
WHOLE = "#,##0"


def _pattern(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def _scaled(value: Column, unit: int, label: str) -> Column:
    return F.concat(_pattern(value.cast("double") / F.lit(float(unit)), SHORT_DECIMAL), F.lit(f" {label}"))


def human_bytes(value: Column) -> Column:
    return (
        F.when(value < KIB, F.concat(value.cast("string"), F.lit(" B")))
        .when(value < MIB, _scaled(value, KIB, "KiB"))
        .when(value < GIB, _scaled(value, MIB, "MiB"))
        .when(value < TIB, _scaled(value, GIB, "GiB"))
        .when(value >= TIB, _scaled(value, TIB, "TiB"))
    )


def human_millis(value: Column) -> Column:
    return (
        F.when(value < SECOND, F.concat(value.cast("string"), F.lit(" ms")))
        .when(value < MINUTE, _scaled(value, SECOND, "s"))
        .when(value < HOUR, _scaled(value, MINUTE, "min"))
        .when(value >= HOUR, _scaled(value, HOUR, "hr"))
    )


def metric_value(value: Column, metric_type: Column) -> Column:
    """A SQL metric value; text that is not a whole number is passed through."""
    number = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))

    def sized(unit: int, label: str) -> Column:
        scaled = number.cast("double") / F.lit(float(unit))
        digits = F.when(scaled == F.floor(scaled), _pattern(F.floor(scaled), WHOLE)).otherwise(
            _pattern(scaled, ONE_DECIMAL))
        return F.concat(digits, F.lit(f" {label}"))

    whole = _pattern(number, WHOLE)
    size = (
        F.when(number >= GIB, sized(GIB, "GiB")).when(number >= MIB, sized(MIB, "MiB"))
        .when(number >= KIB, sized(KIB, "KiB")).otherwise(F.concat(whole, F.lit(" B")))
    )
    return (
        F.when(number.isNull(), value)
        .when(metric_type == "size", size)
        .when(metric_type == "timing", F.concat(whole, F.lit(" ms")))
        .when(metric_type == "nsTiming", F.concat(whole, F.lit(" ns")))
        .otherwise(whole)
    )


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def text_or_unknown(text: Column) -> Column:
    return F.when(has_text(text), text).otherwise(F.lit("unknown"))


def half_up(value: Column, digits: int) -> Column:
    return F.round(value, digits)


def plural(count: Column) -> Column:
    return F.when(count == 1, F.lit("")).otherwise(F.lit("s"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def scope_text(stage_id: Column, execution_id: Column) -> Column:
    return (
        F.when(stage_id >= 0, F.concat(F.lit("stage "), stage_id.cast("string")))
        .when(execution_id.isNotNull(), F.concat(F.lit("SQL execution "), execution_id.cast("string")))
        .otherwise(F.lit("application"))
    )


def sql_status(error_message: Column, end_time: Column) -> Column:
    return (F.when(has_text(error_message), F.lit("failed"))
            .when(end_time.isNull(), F.lit("unknown")).otherwise(F.lit("success")))


def evidence_display(key: Column, value: Column, kind: Column) -> Column:
    """Evidence value as text: lists joined, byte and millisecond figures also in readable units.

    ``kind`` is the value's variant type; a text stays as it is, whatever it looks like.
    """
    items = F.from_json(F.when(kind.startswith("ARRAY"), value), "array<string>")
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), value).try_cast("double").try_cast("bigint")
    return (
        F.when(value.isNull(), F.lit("null"))
        .when(items.isNotNull(), F.array_join(items, ", "))
        .when(number.isNotNull() & key.contains("Bytes"), F.concat(value, F.lit(" ("), human_bytes(number), F.lit(")")))
        .when(number.isNotNull() & key.contains("Millis"), F.concat(value, F.lit(" ("), human_millis(number), F.lit(")")))
        .otherwise(value)
    )
