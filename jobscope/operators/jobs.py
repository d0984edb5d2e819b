"""Applications and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def applications(application_events: DataFrame) -> DataFrame:
    """Identity from the start event, end time from the last end event, duration when both are known."""
    start, end = F.col("is_start"), ~F.col("is_start")
    begun = F.max_by(F.struct("app_id", "app_name", "time_ms"), F.when(start, F.col("seq")))
    return (
        application_events.groupBy("log_id")
        .agg(begun.alias("b"), F.max_by("time_ms", F.when(end, F.col("seq"))).alias("end_ms"))
        .select("log_id", "b.app_id", "b.app_name", F.col("b.time_ms").alias("start_ms"), "end_ms",
                (F.col("end_ms") - F.col("b.time_ms")).alias("duration_ms"))
    )


def job_state(job_events: DataFrame) -> DataFrame:
    """State of each job from its last end event.

    ``failed_seq`` orders failed jobs: the first failure after the last success.
    """
    ended, ok = F.col("kind") == "end", F.col("result") == "JobSucceeded"
    state = job_events.groupBy("log_id", "job_id").agg(
        F.max_by(F.struct("result"), F.when(ended, F.col("seq"))).alias("last"),
        F.max(F.when(ended & ok, F.col("seq"))).alias("last_success"))
    failures = job_events.where(ended & ~F.coalesce(ok, F.lit(False))).select("log_id", "job_id", "seq")
    broke = (
        failures.join(state.select("log_id", "job_id", "last_success"), ["log_id", "job_id"])
        .where(F.col("last_success").isNull() | (F.col("seq") > F.col("last_success")))
        .groupBy("log_id", "job_id").agg(F.min("seq").alias("failed_seq"))
    )
    return state.join(broke, ["log_id", "job_id"], "left").select(
        "log_id", "job_id", F.col("last.result").alias("result"),
        F.when(F.col("last").isNull(), "running")
        .when(F.col("last.result") == "JobSucceeded", "completed").otherwise("failed").alias("state"),
        "failed_seq")


def failed_jobs(state: DataFrame) -> DataFrame:
    return state.where(F.col("state") == "failed").select(
        "log_id", "job_id", "result", F.col("failed_seq").alias("first_seq"))


def known_ids(job_events: DataFrame, stage_events: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every job and stage id mentioned by any event."""
    jobs = job_events.select("log_id", F.lit("job").alias("kind"), F.col("job_id").cast("bigint").alias("id"))
    submitted = stage_events.select("log_id", F.lit("stage").alias("kind"), F.col("stage_id").cast("bigint").alias("id"))
    ran = attempts.where(F.col("stage_id").isNotNull()).select(
        "log_id", F.lit("stage").alias("kind"), F.col("stage_id").cast("bigint").alias("id"))
    return jobs.unionByName(submitted).unionByName(ran).distinct()


def summary_counts(log_ids: DataFrame, jobs: DataFrame, stages: DataFrame, loose_tasks: DataFrame | None,
                   findings: DataFrame) -> DataFrame:
    """Eight counters per log, from tables that already hold one row per job, stage and finding."""
    by_job = jobs.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("state") == "completed").alias("jobs_completed"),
        F.count_if(F.col("state") == "failed").alias("jobs_failed"))
    by_stage = stages.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("stages"), F.count_if(F.col("outcome") == "completed").alias("stages_completed"),
        F.count_if(F.col("outcome") == "failed").alias("stages_failed"),
        F.sum("completed_tasks").alias("stage_tasks"))
    issues = findings.groupBy("log_id").agg(F.count(F.lit(1)).alias("issues"))
    out = (log_ids.select("log_id").distinct().join(by_job, "log_id", "left")
           .join(by_stage, "log_id", "left").join(issues, "log_id", "left"))
    loose = F.lit(0)
    if loose_tasks is not None:
        out = out.join(loose_tasks, "log_id", "left")
        loose = F.coalesce(F.col("loose_tasks"), F.lit(0))
    counters = ["jobs", "jobs_completed", "jobs_failed", "stages", "stages_completed", "stages_failed"]
    return out.select(
        "log_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counters],
        (F.coalesce("stage_tasks", F.lit(0)) + loose).alias("tasks"),
        F.coalesce("issues", F.lit(0)).alias("issues"))
