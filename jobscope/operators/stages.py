"""The stage table: one row per stage, measured on its highest attempt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.operators import attempts as at
from jobscope.operators import order_stats, workers
from jobscope.operators.attempts import ATTEMPT, STAGE


def stages(attempts: DataFrame, stage_events: DataFrame | None = None, *,
           tasks: DataFrame | None = None, statistics: Sequence[str] = order_stats.SAMPLES, spread: bool = True,
           reasons: bool = True, counts: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Everything the stage rules and reports read.

    Every input is first reduced to one row per stage attempt, so the joins are
    between tables of that size and share one partitioning.  ``tasks`` may hand
    in an already stored ``logical_tasks`` table, ``counts`` its ``value_counts``
    and ``totals`` its ``worker_totals``; ``statistics`` names the samples whose
    median and percentiles are wanted.
    """
    tasks = at.logical_tasks(attempts) if tasks is None else tasks
    metrics = at.stage_attempt_metrics(tasks, first_seen=True)
    if stage_events is None:
        wide = metrics.withColumns({
            "details": F.lit(None).cast("struct<stage_name:string,num_tasks:int>"),
            "completion": F.lit(None).cast("struct<stage_name:string,failure_reason:string>")})
    else:
        folded = at.fold_stage_events(stage_events).withColumnRenamed("first_seq", "_event_seq")
        wide = folded.join(metrics, [*ATTEMPT], "full").withColumn(
            "first_seq", F.least("first_seq", "_event_seq")).drop("_event_seq")
    if statistics:
        counts = order_stats.value_counts(tasks, statistics) if counts is None else counts
        stats = order_stats.order_statistics(counts)
        wide = wide.join(order_stats.statistics_by_attempt(stats), [*ATTEMPT], "left")
    if spread:
        totals = workers.worker_totals(tasks, at.worker_names(attempts)) if totals is None else totals
        summary = workers.worker_summary(totals, at.stage_attempt_metrics(tasks))
        wide = wide.join(workers.heaviest_by_attempt(workers.heaviest_worker(summary)), [*ATTEMPT], "left")
    if reasons:
        why = at.failure_reasons(attempts)
        wide = wide.join(at.reason_list(why, ATTEMPT, "attempt_reasons"), [*ATTEMPT], "left")
    else:
        wide = wide.withColumn("attempt_reasons", F.lit(None).cast("array<string>"))

    # Highest attempt wins; failed work and the first mention are taken over all attempts.
    body = [c for c in wide.columns if c not in {*STAGE, "first_seq"}]
    folded = (
        wide.groupBy(*STAGE)
        .agg(F.max_by(F.struct(*body), "stage_attempt_id").alias("s"),
             F.min("first_seq").alias("first_seq"),
             F.coalesce(F.sum("failed_attempts"), F.lit(0)).alias("all_failed_attempts"),
             F.coalesce(F.sum("failed_ms"), F.lit(0)).alias("all_failed_ms"))
        .select(*STAGE, "s.*", "first_seq", "all_failed_attempts", "all_failed_ms")
    )
    if reasons:
        folded = folded.join(at.reason_list(why, STAGE, "all_reasons"), [*STAGE], "left")
    else:
        folded = folded.withColumn("all_reasons", F.lit(None).cast("array<string>"))
    zero = ["completed_tasks", "duration_samples", "shuffle_samples", "spill_samples", "shuffle_total_bytes",
            "memory_total_bytes", "disk_total_bytes", "speculative_attempts", "speculative_ms",
            "duplicate_successes", "failed_attempts", "failed_ms"]
    return folded.withColumns({
        "stage_name": F.col("details.stage_name"),
        "num_tasks": F.col("details.num_tasks"),
        **{c: F.coalesce(c, F.lit(0)) for c in zero},
        "attempt_reasons": F.coalesce("attempt_reasons", F.array().cast("array<string>")),
        "all_reasons": F.coalesce("all_reasons", F.array().cast("array<string>")),
        "outcome": F.when(F.col("completion").isNull(), "unknown")
        .when(F.col("completion.failure_reason").isNull(), "completed").otherwise("failed"),
    })
