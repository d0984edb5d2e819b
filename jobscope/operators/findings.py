"""Findings of all rules in one table, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions.display import evidence_display, severity_rank
from jobscope.operators.rules import Rule, apply_rules
from jobscope.ordering import number_rows, seq_bucket

# Report sizes.
TOP_FINDINGS = 3
TOP_HOTSPOTS = 5


def all_findings(rules: list[Rule], **tables: DataFrame) -> DataFrame:
    """Concatenation of all rules over the given tables (``stages``, ``executions``, ``failed_jobs``)."""
    parts = [apply_rules(rules, source, table) for source, table in tables.items()
             if any(r.source == source for r in rules)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def emission_order() -> list[Column]:
    """Rule, then first mention of the subject (replayed executions last), then part of the rule."""
    return [F.col("rule_order"), F.col("first_seq").isNull(), F.col("first_seq"), F.col("replay_seq"),
            F.col("rule_part"), F.col("stage_id"), F.col("execution_id")]


def number_findings(findings: DataFrame) -> DataFrame:
    """``bottleneck-N`` ids in emission order within each log."""
    anchor = F.coalesce(F.col("first_seq"), F.col("replay_seq"))
    bucket = [F.col("rule_order"), F.col("first_seq").isNull(), seq_bucket(anchor, findings)]
    numbered = number_rows(findings, ["log_id"], bucket, emission_order(), "position")
    return numbered.withColumn("instance_id", F.concat(F.lit("bottleneck-"), F.col("position").cast("string")))


def complete_instance_ids(findings: DataFrame, given: str = "given_id") -> DataFrame:
    """Keep ids that are given; number the rest with the smallest free ``bottleneck-N`` in order.

    ``findings`` carries ``log_id``, ``position`` and the column ``given``.  The
    k-th unnamed finding takes the k-th free number: numbers claimed by given
    ids are skipped by shifting past every claimed number at or below it.
    """
    named = F.col(given).rlike(r"\S")
    claimed = F.when(named, F.regexp_extract(given, r"^bottleneck-([1-9][0-9]*)$", 1).try_cast("bigint"))
    keyed = findings.withColumn("_claimed", claimed)
    blank = number_rows(keyed.where(~F.coalesce(named, F.lit(False))), ["log_id"],
                        [F.shiftright("position", 12)], [F.col("position")], "_k")
    taken = keyed.where(F.col("_claimed").isNotNull()).select("log_id", F.col("_claimed").alias("_number")).distinct()
    # The j-th smallest claimed number shifts every k with k > number - j.
    order = number_rows(taken, ["log_id"], [F.shiftright("_number", 12)], [F.col("_number")], "_j")
    shifts = order.groupBy("log_id", (F.col("_number") - F.col("_j")).alias("_at")).agg(F.count(F.lit(1)).alias("_shift"))
    marks = (
        blank.select("log_id", F.col("_k").alias("_at"), F.lit(0).cast("bigint").alias("_shift"), "position")
        .unionByName(shifts.withColumn("position", F.lit(None).cast("bigint"))))
    chunk = marks.withColumn("_chunk", F.shiftright("_at", 12))
    earlier = Window.partitionBy("log_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (chunk.groupBy("log_id", "_chunk").agg(F.sum("_shift").alias("_sum"))
            .select("log_id", "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")))
    # A shift at n - j applies to every k strictly above it.
    inside = Window.partitionBy("log_id", "_chunk").orderBy("_at", F.col("_shift")).rowsBetween(
        Window.unboundedPreceding, 0)
    numbers = (
        chunk.join(base, ["log_id", "_chunk"])
        .withColumn("_n", F.col("_at") + F.col("_base") + F.sum("_shift").over(inside))
        .where(F.col("position").isNotNull()).select("log_id", "position", "_n"))
    return (
        keyed.join(numbers, ["log_id", "position"], "left")
        .withColumn("instance_id", F.when(named, F.col(given)).otherwise(
            F.concat(F.lit("bottleneck-"), F.col("_n").cast("string"))))
        .drop("_claimed", "_n"))


def duplicate_instance_ids(findings: DataFrame) -> DataFrame:
    """Ids given more than once within a log; a report with any is invalid."""
    return findings.groupBy("log_id", "instance_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def suppress_duplicates(findings: DataFrame, weaker: str = "duplicate_sql_subtree",
                        stronger: str = "possible_missed_exchange_reuse") -> DataFrame:
    """Drop the weaker finding of an execution that also has the stronger one."""
    strong = findings.where(F.col("type") == stronger).select("log_id", "execution_id", F.lit(weaker).alias("type"))
    return findings.join(strong, ["log_id", "execution_id", "type"], "left_anti")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Counts per severity and the one-line text; severities without findings are left out."""
    levels = ("high", "medium", "low")
    counted = findings.groupBy("log_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in levels])
    parts = [F.when(F.col(s) > 0, F.concat(F.lit(f"{s}="), F.col(s).cast("string"))) for s in levels]
    text = F.concat_ws(", ", *parts)
    return counted.withColumn("summary", F.when(text == "", "none").otherwise(text))


def issue_count_by_stage(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("stage_id") >= 0).groupBy("log_id", "stage_id").agg(F.count(F.lit(1)).alias("issues"))


def top_findings(findings: DataFrame, limit: int = TOP_FINDINGS) -> DataFrame:
    """The most severe findings of each log; ties keep emission order.

    The limit on the row number is applied before the shuffle as well, so each
    map task sends at most ``limit`` rows per log.
    """
    order = Window.partitionBy("log_id").orderBy(severity_rank(F.col("severity")), *emission_order())
    return findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def hotspot_inputs(stages: DataFrame, findings: DataFrame) -> DataFrame:
    """What ranks a stage: failure, findings, longest task, shuffle and spill."""
    issues = issue_count_by_stage(findings)
    return stages.join(issues, ["log_id", "stage_id"], "left").select(
        "log_id", "stage_id", "stage_name", (F.col("outcome") == "failed").alias("failed"),
        F.coalesce("issues", F.lit(0)).alias("issues"), "completed_tasks", "duration_avg_ms", "duration_max_ms",
        "shuffle_total_bytes", "memory_total_bytes", "disk_total_bytes")


def stage_hotspots(inputs: DataFrame, limit: int = TOP_HOTSPOTS) -> DataFrame:
    longest = F.coalesce("duration_max_ms", F.lit(0))
    spilled = F.col("memory_total_bytes") + F.col("disk_total_bytes")
    shown = (F.col("failed") | (F.col("issues") > 0) | (longest > 0)
             | (F.col("shuffle_total_bytes") > 0) | (spilled > 0))
    order = Window.partitionBy("log_id").orderBy(
        F.desc("failed"), F.desc("issues"), longest.desc(), F.desc("shuffle_total_bytes"), spilled.desc(), "stage_id")
    return inputs.where(shown).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def evidence_rows(findings: DataFrame, *keys: str) -> DataFrame:
    """One row per evidence entry with its display text; what an entry is (list, number, text) is kept from the JSON."""
    entries = findings.sparkSession.tvf.variant_explode(F.parse_json(F.col("evidence").outer())).select(
        "key", F.schema_of_variant("value").alias("kind"))
    text = F.element_at(F.from_json("evidence", "map<string,string>"), F.col("key"))
    return (findings.lateralJoin(entries).select(*keys, "key", text.alias("value"), "kind")
            .withColumn("display", evidence_display(F.col("key"), F.col("value"), F.col("kind"))).drop("kind"))
