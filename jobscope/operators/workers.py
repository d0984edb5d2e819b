"""How the work of a stage spread over executors and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.functions.display import half_up, has_text
from jobscope.operators.attempts import ATTEMPT

KINDS = ("executor", "host")


def worker_totals(tasks: DataFrame, names: DataFrame) -> DataFrame:
    """Task count and duration per worker, over tasks with a duration and a worker name.

    Tasks are summed by the number of their worker first; ``names`` (:func:`worker_names`) meets only the sums.
    """
    first = F.col("first")
    roles = F.array(
        F.struct(F.lit("executor").alias("kind"), F.col("executor_id").alias("worker_id")),
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("worker_id")))
    sums = (
        tasks.where(first["duration_ms"].isNotNull())
        .select(*ATTEMPT, first["worker"].alias("worker"), first["duration_ms"].alias("duration_ms"), first["seq"].alias("seq"))
        .groupBy(*ATTEMPT, "worker")
        .agg(F.count(F.lit(1)).alias("task_count"), F.sum("duration_ms").alias("duration_ms"),
             F.min("seq").alias("first_seq"))
    )
    return (
        sums.join(names, ["log_id", "worker"]).select("*", F.explode(roles).alias("role"))
        .select(*ATTEMPT, "role.*", "task_count", "duration_ms", "first_seq").where(has_text(F.col("worker_id")))
        .groupBy(*ATTEMPT, "kind", "worker_id")
        .agg(F.sum("task_count").alias("task_count"), F.sum("duration_ms").alias("duration_ms"),
             F.min("first_seq").alias("first_seq"))
    )


def worker_summary(totals: DataFrame, metrics: DataFrame) -> DataFrame:
    """Shares of each worker.  Stages whose total duration is zero have no summary."""
    stage = metrics.where(F.col("duration_total_ms") != 0).select(*ATTEMPT, "completed_tasks", "duration_total_ms")
    return totals.join(stage, [*ATTEMPT]).select(
        *ATTEMPT, "kind", "worker_id", "task_count", "duration_ms",
        half_up(F.col("task_count") / F.col("completed_tasks"), 4).alias("task_share"),
        half_up(F.col("duration_ms") / F.col("duration_total_ms"), 4).alias("duration_share"),
        "first_seq")


def heaviest_worker(summary: DataFrame) -> DataFrame:
    """Per stage attempt and kind: number of workers and the one with most work (first seen wins ties)."""
    rank = F.struct((-F.col("duration_ms")).alias("d"), "first_seq")
    return (
        summary.groupBy(*ATTEMPT, "kind")
        .agg(F.count(F.lit(1)).alias("workers"),
             F.min_by(F.struct("worker_id", "task_count", "duration_ms", "task_share", "duration_share"), rank)
             .alias("top"))
    )


def heaviest_by_attempt(heaviest: DataFrame) -> DataFrame:
    """One row per stage attempt with a struct for executors and one for hosts."""
    entry = F.struct("workers", "top.*")
    return heaviest.groupBy(*ATTEMPT).agg(
        *[F.max_by(entry, F.when(F.col("kind") == kind, F.lit(1))).alias(f"{kind}s") for kind in KINDS])
