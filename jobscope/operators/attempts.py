"""Task attempts folded to logical tasks, stage attempts and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGE = ("log_id", "stage_id")
ATTEMPT = ("log_id", "stage_id", "stage_attempt_id")
SAMPLES = ("duration_ms", "shuffle_read_bytes", "memory_bytes_spilled", "disk_bytes_spilled")


def logical_success() -> Column:
    return F.col("success") & F.col("stage_id").isNotNull() & F.col("task_index").isNotNull()


def logical_tasks(attempts: DataFrame) -> DataFrame:
    """One row per (stage attempt, task index): the first success and what else happened.

    The fold is partial on the map side, so a task index repeated any number of
    times reaches the shuffle as one row per map task.  All it keeps are numbers
    of fixed width, so neither side of the shuffle is sorted; ``first.worker``
    stands for executor and host, which ``worker_names`` gives back.
    """
    ok = logical_success()
    failed = ~F.col("success")
    won = F.when(ok, F.col("seq"))
    numbered = attempts.where(F.col("stage_id").isNotNull()).withColumn("worker", worker_key())
    kept = (*SAMPLES, "worker")
    return (
        numbered
        .groupBy(*ATTEMPT, "task_index")
        .agg(
            F.min(won).alias("seq"), *[F.min_by(c, won).alias(c) for c in kept],
            F.count_if(ok).alias("successes"),
            F.count_if(ok & F.col("speculative")).alias("speculative_attempts"),
            F.sum(F.when(ok & F.col("speculative"), F.col("duration_ms"))).alias("speculative_ms"),
            F.count_if(failed).alias("failed_attempts"),
            F.sum(F.when(failed, F.col("duration_ms"))).alias("failed_ms"),
            F.min("seq").alias("first_seq"))
        .withColumn("first", F.when(F.col("seq").isNotNull(), F.struct(*kept, "seq")))
        .drop("seq", *kept)
    )


def worker_key() -> Column:
    """Executor and host as one number; within a log these are too few for two of them to meet."""
    return F.xxhash64("executor_id", "host")


def worker_names(attempts: DataFrame) -> DataFrame:
    """``(log_id, worker, executor_id, host)``: as many rows as a log has executors."""
    return attempts.select("log_id", worker_key().alias("worker"), "executor_id", "host").distinct()


def successful_logical_tasks(attempts: DataFrame) -> DataFrame:
    """The first success of every logical task."""
    tasks = logical_tasks(attempts).where(F.col("first").isNotNull()).select(*ATTEMPT, "task_index", "first.*")
    return tasks.join(worker_names(attempts), ["log_id", "worker"]).select(
        *ATTEMPT, "task_index", *SAMPLES, "executor_id", "host", "seq")


def stage_attempt_metrics(tasks: DataFrame, first_seen: bool = False) -> DataFrame:
    """Counters and sums per stage attempt, optionally with its first mention by a task."""
    first = F.col("first")
    columns = [
        F.count_if(first.isNotNull()).alias("completed_tasks"),
        F.count(first["duration_ms"]).alias("duration_samples"),
        F.sum(first["duration_ms"]).alias("duration_total_ms"),
        F.min(first["duration_ms"]).alias("duration_min_ms"),
        F.max(first["duration_ms"]).alias("duration_max_ms"),
        F.expr("sum(first.duration_ms) div count(first.duration_ms)").alias("duration_avg_ms"),
        F.count(first["shuffle_read_bytes"]).alias("shuffle_samples"),
        F.coalesce(F.sum(first["shuffle_read_bytes"]), F.lit(0)).alias("shuffle_total_bytes"),
        F.max(first["shuffle_read_bytes"]).alias("shuffle_max_bytes"),
        F.count(first["memory_bytes_spilled"]).alias("spill_samples"),
        F.coalesce(F.sum(first["memory_bytes_spilled"]), F.lit(0)).alias("memory_total_bytes"),
        F.coalesce(F.sum(first["disk_bytes_spilled"]), F.lit(0)).alias("disk_total_bytes"),
        F.max(first["memory_bytes_spilled"]).alias("memory_max_bytes"),
        F.max(first["disk_bytes_spilled"]).alias("disk_max_bytes"),
        F.sum("speculative_attempts").alias("speculative_attempts"),
        F.coalesce(F.sum("speculative_ms"), F.lit(0)).alias("speculative_ms"),
        F.sum(F.greatest(F.col("successes") - 1, F.lit(0))).alias("duplicate_successes"),
        F.sum("failed_attempts").alias("failed_attempts"),
        F.coalesce(F.sum("failed_ms"), F.lit(0)).alias("failed_ms"),
    ]
    if first_seen:
        columns.append(F.min("first_seq").alias("first_seq"))
    return tasks.groupBy(*ATTEMPT).agg(*columns)


def failure_reasons(attempts: DataFrame) -> DataFrame:
    """Distinct failure reasons per stage attempt with the event that first gave each."""
    return (
        attempts.where(~F.col("success") & F.col("stage_id").isNotNull() & F.col("reason").rlike(r"\S"))
        .groupBy(*ATTEMPT, "reason").agg(F.min("seq").alias("first_seq"))
    )


def reason_list(reasons: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Reasons in first-seen order.  They are end-reason class names, a handful per listener protocol."""
    first = reasons.groupBy(*keys, "reason").agg(F.min("first_seq").alias("first_seq"))
    return first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("first_seq", "reason")))["reason"].alias(name))


def fold_stage_events(stage_events: DataFrame) -> DataFrame:
    """One row per stage attempt: last details, last completion, first mention; one pass over the events.

    Details come from the last submission or completion, absent values included.
    The completion that counts is the last one.
    """
    done = F.struct("seq", "stage_name", "num_tasks", "failure_reason")
    return stage_events.groupBy(*ATTEMPT).agg(
        F.max_by(F.struct("stage_name", "num_tasks"), "seq").alias("details"),
        F.max_by(done, F.when(F.col("kind") == "completed", F.col("seq"))).alias("completion"),
        F.min("seq").alias("first_seq"))


def last_completion(stage_events: DataFrame) -> DataFrame:
    return fold_stage_events(stage_events).where(F.col("completion").isNotNull()).select(*ATTEMPT, "completion.*")


def stage_details(stage_events: DataFrame) -> DataFrame:
    return fold_stage_events(stage_events).select(*ATTEMPT, "details.*")


def seen_attempts(stage_events: DataFrame | None, attempts: DataFrame) -> DataFrame:
    """Every stage attempt mentioned by any event, with the first mention."""
    columns = [*ATTEMPT, "seq"]
    mentioned = attempts.where(F.col("stage_id").isNotNull()).select(*columns)
    if stage_events is not None:
        mentioned = mentioned.unionByName(stage_events.select(*columns))
    return mentioned.groupBy(*ATTEMPT).agg(F.min("seq").alias("first_seq"))


def latest_stage_attempt(seen: DataFrame) -> DataFrame:
    """Highest attempt of each stage, whatever the order of arrival, and when the stage was first seen."""
    return seen.groupBy(*STAGE).agg(F.max("stage_attempt_id").alias("stage_attempt_id"),
                                    F.min("first_seq").alias("first_seq"))


def stage_outcome(latest: DataFrame, completions: DataFrame) -> DataFrame:
    """completed / failed / unknown per stage; an empty failure reason is still a failure."""
    done = completions.select(*ATTEMPT, "stage_name", "failure_reason", F.lit(True).alias("_done"))
    return latest.join(done, [*ATTEMPT], "left").select(
        *ATTEMPT, "stage_name", "failure_reason",
        F.when(F.col("_done").isNull(), "unknown").when(F.col("failure_reason").isNull(), "completed")
        .otherwise("failed").alias("outcome"))


def tasks_without_stage(attempts: DataFrame) -> DataFrame:
    """Distinct ids of successful tasks that cannot be assigned to a stage."""
    return (
        attempts.where(F.col("success") & (F.col("stage_id").isNull() | F.col("task_index").isNull())
                       & F.col("task_id").isNotNull())
        .groupBy("log_id").agg(F.count_distinct("task_id").alias("loose_tasks"))
    )
