"""SQL executions and their metric values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.operators.attempts import ATTEMPT, STAGE
from jobscope.ordering import SEQ_TYPE, carry_forward

EXECUTION = ("log_id", "execution_id")

# Operator categories of the SQL report.
CATEGORIES = ("Exchanges", "Sorts", "HashAggregates", "Joins", "Scans", "AQE nodes")


def stage_execution_asof(job_stage_map: DataFrame, stage_events: DataFrame) -> DataFrame:
    """For each stage completion, the execution recorded by the latest earlier job start naming the stage."""
    named = job_stage_map.select(
        *STAGE, "seq", "execution_id", F.lit(None).cast("int").alias("stage_attempt_id"), F.lit(False).alias("_done"))
    done = stage_events.where(F.col("kind") == "completed").select(
        *STAGE, "seq", F.lit(None).cast("bigint").alias("execution_id"), "stage_attempt_id", F.lit(True).alias("_done"))
    carried = carry_forward(named.unionByName(done), STAGE, "seq", "execution_id", "_execution")
    return carried.where("_done").select(*ATTEMPT, "seq", F.col("_execution").alias("execution_id"))


def replayed_completions(job_stage_map: DataFrame, stage_events: DataFrame, attempts: DataFrame) -> DataFrame:
    """Stage completions whose SQL values count, with their execution: ``stage attempt, seq, execution_id``.

    Only the last completion of a stage's highest attempt, when it succeeded
    and an execution was known for the stage at that moment.  That is one
    completion a stage at most, found by folding numbers alone; job starts are
    then compared with it and folded in turn, so no running order is needed.
    """
    done = F.when(F.col("kind") == "completed", F.col("seq"))
    marks = stage_events.select(*ATTEMPT, done.alias("seq"), F.col("failure_reason").isNull().alias("ok")).unionByName(
        attempts.where(F.col("stage_id").isNotNull()).select(
            *ATTEMPT, F.lit(None).cast(SEQ_TYPE).alias("seq"), F.lit(None).cast("boolean").alias("ok")))
    by_attempt = marks.groupBy(*ATTEMPT).agg(F.max("seq").alias("seq"), F.max_by("ok", "seq").alias("ok"))
    by_stage = by_attempt.groupBy(*STAGE).agg(
        F.max("stage_attempt_id").alias("stage_attempt_id"), F.max_by("seq", "stage_attempt_id").alias("seq"),
        F.max_by("ok", "stage_attempt_id").alias("ok"))
    last = by_stage.where("ok").drop("ok")
    known = job_stage_map.select(*STAGE, "execution_id", F.col("seq").alias("_named")).join(last, [*STAGE])
    return known.where(F.col("_named") <= F.col("seq")).groupBy(*ATTEMPT, "seq").agg(
        F.max_by("execution_id", "_named").alias("execution_id"))


def accumulator_union(driver: DataFrame, stage_values: DataFrame) -> DataFrame:
    """Driver and stage updates in one table, before deciding which of them count."""
    from_stage = stage_values.select(
        "log_id", F.lit(None).cast("bigint").alias("execution_id"), "seq", "pos", "stage_id", "stage_attempt_id",
        "accumulator_id", "value", F.lit("stage").alias("source"))
    from_driver = driver.select(
        "log_id", "execution_id", "seq", "pos", F.lit(None).cast("int").alias("stage_id"),
        F.lit(None).cast("int").alias("stage_attempt_id"), "accumulator_id", "value", F.lit("driver").alias("source"))
    return from_driver.unionByName(from_stage)


def accumulator_replay(driver: DataFrame, stage_values: DataFrame, replayed: DataFrame) -> DataFrame:
    """Updates that count: every driver update, and those of the replayed completions."""
    from_stage = stage_values.join(replayed, [*ATTEMPT, "seq"]).select(
        *EXECUTION, "seq", "pos", "accumulator_id", "value", F.lit("stage").alias("source"))
    from_driver = driver.select(
        *EXECUTION, "seq", "pos", "accumulator_id", "value", F.lit("driver").alias("source"))
    return from_driver.unionByName(from_stage)


def sql_metric_values(updates: DataFrame) -> DataFrame:
    """Last value of each accumulator."""
    return updates.groupBy(*EXECUTION, "accumulator_id").agg(
        F.max_by("value", F.struct("seq", "pos")).alias("value"))


def sql_executions(events: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """Merged executions.

    A start replaces everything it sets; an adaptive update replaces only what
    it brings, and counts only if it is newer than the last start; an end sets
    time and error.
    """
    kind = F.col("kind")
    started = F.when(kind == "start", F.col("seq"))
    # A start carries its own plan fields even when they are absent; an update only what is present.
    described = F.when((kind == "start") | ((kind == "update") & F.col("plan_description").isNotNull()), F.col("seq"))
    planned = F.when((kind == "start") | ((kind == "update") & F.col("plan_json").isNotNull()), F.col("seq"))
    ended = F.when(kind == "end", F.col("seq"))
    merged = events.groupBy(*EXECUTION).agg(
        F.min("seq").alias("first_seq"),
        F.max_by(F.struct("root_execution_id", "description", "details", F.col("time_ms").alias("start_ms"),
                          "plan_description", "plan_json"), started).alias("s"),
        F.max_by(F.struct("plan_description"), described).alias("d"),
        F.max_by(F.struct("plan_json"), planned).alias("p"),
        F.max_by(F.struct(F.col("time_ms").alias("end_ms"), "error_message"), ended).alias("e"))
    out = merged.select(
        *EXECUTION, "s.root_execution_id", "s.description", "s.details", "s.start_ms", "e.end_ms",
        (F.col("e.end_ms") - F.col("s.start_ms")).alias("duration_ms"),
        "s.plan_description", F.col("d.plan_description").alias("latest_plan_description"),
        "e.error_message", "s.plan_json", F.col("p.plan_json").alias("latest_plan_json"), "first_seq")
    if replayed is None:
        return out.withColumn("replay_seq", F.lit(None).cast(SEQ_TYPE))
    # Executions known only through replayed completions come after all others, in replay order.
    only = replayed.groupBy(*EXECUTION).agg(F.min("seq").alias("replay_seq"))
    return out.join(only, [*EXECUTION], "full")


def category_match(name: Column) -> dict[str, Column]:
    """Overlapping predicates: one operator may count in several categories."""
    return {
        "Exchanges": name.contains("Exchange"),
        "Sorts": name == "Sort",
        "HashAggregates": name.contains("HashAggregate"),
        "Joins": name.contains("Join"),
        "Scans": name.contains("Scan"),
        "AQE nodes": (name == "AdaptiveSparkPlan") | name.startswith("AQE") | name.endswith("QueryStage"),
    }


def operator_counts(nodes: DataFrame) -> DataFrame:
    named = nodes.where(F.col("node_name").rlike(r"\S"))
    return named.groupBy(*EXECUTION, "node_name").agg(F.count(F.lit(1)).alias("count"))


def operator_categories(counts: DataFrame) -> DataFrame:
    match = category_match(F.col("node_name"))
    return counts.groupBy(*EXECUTION).agg(
        *[F.sum(F.when(match[c], F.col("count")).otherwise(0)).alias(c.lower().replace(" ", "_")) for c in CATEGORIES])


def count_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.groupBy(*EXECUTION).agg(F.count_if(F.col("node_name") == name).alias("count"))


def metric_lookup(plan_metrics: DataFrame, values: DataFrame) -> DataFrame:
    """Plan metrics with the value of their accumulator, if any."""
    return plan_metrics.join(values, [*EXECUTION, "accumulator_id"], "left")
