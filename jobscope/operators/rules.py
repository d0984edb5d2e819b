"""Bottleneck rules.

A rule is a condition, a severity and named evidence over one row of the table
it watches, so all rules of a table are evaluated in one pass over it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.display import half_up, text_or_unknown
from jobscope.limits import DEFAULT_LIMITS, Limits
from jobscope.operators.sqlexec import EXECUTION
from jobscope.ordering import SEQ_TYPE
from jobscope.plans.subtrees import duplicate_rank

NO_STAGE = -1


@dataclass(frozen=True)
class Rule:
    """``order`` and ``part`` give the emission order: by order, then by row, then by part."""

    name: str
    source: str
    order: int
    message: str
    when: Column
    severity: Column
    evidence: Mapping[str, Column] = field(default_factory=dict)
    part: int = 0


def _int(value: int) -> Column:
    return F.lit(value).cast("int")


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _zero(column: Column) -> Column:
    return F.coalesce(column, _long(0))


def _between(high: Column) -> Column:
    return F.when(high, "high").otherwise("medium")


def built_in_rules(limits: Limits = DEFAULT_LIMITS) -> list[Rule]:
    c, lit = F.col, F.lit
    tasks = c("completed_tasks").cast("int")
    reading = c("shuffle_samples").cast("int")
    medium, high = lit("medium"), lit("high")
    all_timed = c("duration_samples") == c("completed_tasks")
    shuffle_avg = F.when(c("shuffle_samples") > 0, F.expr("shuffle_total_bytes div shuffle_samples")).otherwise(_long(0))

    shuffle_median, shuffle_max = c("median_shuffle_read_bytes"), c("shuffle_max_bytes")
    shuffle_p95 = c("p95_shuffle_read_bytes")
    shuffle_skewed = (
        (c("shuffle_samples") >= limits.shuffle_skew_min_tasks) & (shuffle_median > 0)
        & (shuffle_max > limits.shuffle_skew_bytes) & (shuffle_max > shuffle_median * lit(limits.shuffle_skew_ratio)))
    starved = ((c("shuffle_total_bytes") >= limits.low_parallelism_high_bytes)
               & (c("shuffle_samples") <= limits.low_parallelism_high_tasks))
    speculative_share = half_up(c("speculative_attempts") / c("completed_tasks"), 4)

    rules = [
        Rule("task_duration_skew", "stages", 1, "Stage %d has task duration skew.",
             all_timed & (c("completed_tasks") >= limits.duration_skew_min_tasks) & (c("duration_avg_ms") > 0)
             & (c("duration_max_ms") >= c("duration_avg_ms") * lit(limits.duration_skew_ratio)),
             medium,
             {"completedTasks": tasks, "avgTaskDurationMillis": c("duration_avg_ms"),
              "maxTaskDurationMillis": c("duration_max_ms"),
              "skewRatio": half_up(c("duration_max_ms") / c("duration_avg_ms"), 2)}),
        Rule("shuffle_partition_skew", "stages", 2, "Stage %d has shuffle partition skew.", shuffle_skewed, high,
             {"shuffleReadingTasks": reading, "medianTaskShuffleReadBytes": shuffle_median,
              "maxTaskShuffleReadBytes": shuffle_max, "skewRatio": half_up(shuffle_max / shuffle_median, 2),
              "thresholdBytes": _long(limits.shuffle_skew_bytes)}),
        Rule("oversized_shuffle_partitions", "stages", 3, "Stage %d has oversized shuffle partitions.",
             (c("shuffle_samples") >= limits.oversized_min_tasks) & ~F.coalesce(shuffle_skewed, lit(False))
             & ((shuffle_p95 >= limits.oversized_p95_medium_bytes) | (shuffle_max >= limits.oversized_max_high_bytes)),
             _between((shuffle_p95 >= limits.oversized_p95_high_bytes)
                      | (shuffle_max >= limits.oversized_max_high_bytes)),
             {"shuffleReadingTasks": reading, "medianTaskShuffleReadBytes": _zero(shuffle_median),
              "p95TaskShuffleReadBytes": _zero(shuffle_p95), "maxTaskShuffleReadBytes": _zero(shuffle_max),
              "mediumP95ShuffleReadThresholdBytes": _long(limits.oversized_p95_medium_bytes),
              "highP95ShuffleReadThresholdBytes": _long(limits.oversized_p95_high_bytes),
              "highMaxShuffleReadThresholdBytes": _long(limits.oversized_max_high_bytes)}),
        Rule("low_shuffle_parallelism", "stages", 4, "Stage %d has low shuffle parallelism.",
             (c("shuffle_samples") > 0) & (c("shuffle_total_bytes") >= limits.low_parallelism_medium_bytes)
             & (starved | ((shuffle_avg < limits.low_parallelism_oversized_avg_bytes)
                           & (c("shuffle_samples") <= limits.low_parallelism_medium_tasks))),
             _between(starved),
             {"shuffleReadingTasks": reading, "shuffleReadBytes": c("shuffle_total_bytes"),
              "avgTaskShuffleReadBytes": shuffle_avg,
              "mediumTotalShuffleReadThresholdBytes": _long(limits.low_parallelism_medium_bytes),
              "highTotalShuffleReadThresholdBytes": _long(limits.low_parallelism_high_bytes),
              "mediumMaxShuffleReadingTasks": _int(limits.low_parallelism_medium_tasks),
              "highMaxShuffleReadingTasks": _int(limits.low_parallelism_high_tasks)}),
        Rule("spill_pressure", "stages", 5, "Stage %d has spill pressure.",
             ((c("completed_tasks") == 1)
              & ((c("disk_total_bytes") >= limits.spill_disk_high_bytes)
                 | (c("memory_total_bytes") >= limits.spill_single_task_memory_bytes)))
             | ((c("completed_tasks") >= 2)
                & ((c("disk_total_bytes") >= limits.spill_disk_medium_bytes)
                   | (c("memory_total_bytes") >= limits.spill_memory_medium_bytes))),
             _between((c("disk_total_bytes") >= limits.spill_disk_high_bytes)
                      | (_zero(c("disk_max_bytes")) >= limits.spill_max_task_disk_high_bytes)),
             {"completedTasks": tasks, "memoryBytesSpilled": c("memory_total_bytes"),
              "diskBytesSpilled": c("disk_total_bytes"), "maxTaskMemoryBytesSpilled": _zero(c("memory_max_bytes")),
              "maxTaskDiskBytesSpilled": _zero(c("disk_max_bytes")),
              "mediumMemorySpillThresholdBytes": _long(limits.spill_memory_medium_bytes),
              "mediumDiskSpillThresholdBytes": _long(limits.spill_disk_medium_bytes),
              "highDiskSpillThresholdBytes": _long(limits.spill_disk_high_bytes),
              "highMaxTaskDiskSpillThresholdBytes": _long(limits.spill_max_task_disk_high_bytes)}),
    ]
    for part, (kind, label, threshold, severity) in enumerate([
            ("memory", "Memory", limits.memory_spill_skew_bytes, medium),
            ("disk", "Disk", limits.disk_spill_skew_bytes, high)]):
        middle, p95 = c(f"median_{kind}_bytes_spilled"), c(f"p95_{kind}_bytes_spilled")
        top = c(f"{kind}_max_bytes")
        rules.append(Rule(
            f"{kind}_spill_skew", "stages", 6, f"Stage %d has {kind} spill skew.",
            (c("completed_tasks") >= limits.spill_skew_min_tasks) & (middle > 0) & (top > threshold)
            & (top > middle * lit(limits.spill_skew_ratio)),
            severity,
            {"completedTasks": tasks, f"medianTask{label}BytesSpilled": middle,
             f"p95Task{label}BytesSpilled": _zero(p95), f"maxTask{label}BytesSpilled": top,
             "skewRatio": half_up(top / middle, 2), "thresholdBytes": _long(threshold)},
            part))
    rules += [
        Rule("too_many_tiny_tasks", "stages", 7, "Stage %d has too many tiny tasks.",
             all_timed & (c("completed_tasks") >= limits.tiny_min_tasks)
             & (c("duration_avg_ms") <= limits.tiny_max_avg_millis)
             & (c("p95_duration_ms") <= limits.tiny_max_p95_millis)
             & ((c("shuffle_samples") == 0) | (shuffle_avg <= limits.tiny_max_avg_shuffle_bytes)),
             medium,
             {"completedTasks": tasks, "avgTaskDurationMillis": _zero(c("duration_avg_ms")),
              "p95TaskDurationMillis": _zero(c("p95_duration_ms")), "avgTaskShuffleReadBytes": shuffle_avg,
              "minCompletedTasks": _int(limits.tiny_min_tasks),
              "maxAvgTaskDurationMillis": _long(limits.tiny_max_avg_millis),
              "maxP95TaskDurationMillis": _long(limits.tiny_max_p95_millis),
              "maxAvgShuffleReadBytes": _long(limits.tiny_max_avg_shuffle_bytes)}),
        Rule("retry_waste", "stages", 8, "Stage %d has retry waste from failed task attempts.",
             (c("all_failed_attempts") >= limits.retry_min_attempts)
             & (c("all_failed_ms") >= limits.retry_medium_millis),
             _between(c("all_failed_ms") >= limits.retry_high_millis),
             {"failedTaskAttempts": c("all_failed_attempts").cast("int"),
              "failedTaskAttemptDurationMillis": c("all_failed_ms"), "failedTaskAttemptReasons": c("all_reasons"),
              "minFailedTaskAttempts": _int(limits.retry_min_attempts),
              "mediumFailedAttemptDurationMillis": _long(limits.retry_medium_millis),
              "highFailedAttemptDurationMillis": _long(limits.retry_high_millis)}),
        Rule("speculation_heavy", "stages", 9, "Stage %d has heavy speculative execution.",
             (c("completed_tasks") >= limits.speculation_min_tasks)
             & (c("speculative_attempts") >= limits.speculation_min_attempts)
             & (speculative_share >= limits.speculation_medium_share),
             _between(speculative_share >= limits.speculation_high_share),
             {"completedTasks": tasks, "speculativeTaskAttempts": c("speculative_attempts").cast("int"),
              "duplicateSuccessfulTaskAttempts": c("duplicate_successes").cast("int"),
              "speculativeTaskAttemptDurationMillis": c("speculative_ms"),
              "speculativeAttemptShare": speculative_share,
              "minCompletedTasks": _int(limits.speculation_min_tasks),
              "minSpeculativeTaskAttempts": _int(limits.speculation_min_attempts),
              "mediumSpeculativeAttemptShare": lit(limits.speculation_medium_share),
              "highSpeculativeAttemptShare": lit(limits.speculation_high_share)}),
    ]
    for part, (kind, id_key) in enumerate([("executor", "executorId"), ("host", "host")]):
        group = c(f"{kind}s")
        rules.append(Rule(
            f"{kind}_imbalance", "stages", 10, f"Stage %d has {kind} imbalance.",
            (c("completed_tasks") >= limits.imbalance_min_tasks)
            & (group["workers"] >= limits.imbalance_min_workers)
            & (group["duration_share"] >= limits.imbalance_duration_share)
            & (group["task_share"] >= limits.imbalance_task_share),
            medium,
            {"completedTasks": tasks, f"{kind}Count": group["workers"].cast("int"), id_key: group["worker_id"],
             "workerTaskCount": group["task_count"].cast("int"),
             "workerTaskDurationMillis": group["duration_ms"],
             "workerTaskShare": group["task_share"], "workerDurationShare": group["duration_share"],
             "minDurationShare": lit(limits.imbalance_duration_share),
             "minTaskShare": lit(limits.imbalance_task_share)},
            part))

    description = text_or_unknown(c("description"))
    execution = c("execution_id")

    def top_duplicate(prefix: str) -> dict[str, Column]:
        top = c(f"{prefix}_top")
        return {"topDuplicateRoot": top["root"], "topDuplicateCount": top["count"].cast("int"),
                "topDuplicateSubtreeSize": top["subtree_size"].cast("int"),
                "topDuplicateMaxDepth": top["subtree_depth"].cast("int"),
                "topDuplicateInterestingOperators": top["interesting"]}

    rules += [
        Rule("sql_many_exchanges", "executions", 11, "SQL execution %d has many exchange operators.",
             c("exchange_count") >= limits.many_exchanges, medium,
             {"sqlExecutionId": execution, "exchangeCount": c("exchange_count").cast("int"),
              "minExchangeOperators": _int(limits.many_exchanges), "description": description}),
        # A possible missed reuse explains the repetition, so it replaces the general finding.
        Rule("duplicate_sql_subtree", "executions", 12, "SQL execution %d has repeated physical plan subtrees.",
             (c("repeated_groups") > 0) & (F.coalesce(c("exchange_groups"), lit(0)) == 0), medium,
             {"sqlExecutionId": execution, "description": description,
              "duplicateGroups": c("repeated_groups").cast("int"), **top_duplicate("repeated")}),
        Rule("possible_missed_exchange_reuse", "executions", 13,
             "SQL execution %d has repeated exchange-like physical plan subtrees.",
             c("exchange_groups") > 0, medium,
             {"sqlExecutionId": execution, "description": description,
              "duplicateExchangeGroups": c("exchange_groups").cast("int"), **top_duplicate("exchange"),
              "confidence": lit("low"), "confidenceReason": lit("physical-plan-only signal"),
              "validationRequired":
                  lit("Validate in Spark UI and query code before making optimizer conclusions.")}),
        Rule("failed_job", "failed_jobs", 14, "Job %d failed.", lit(True), high,
             {"jobId": c("job_id"), "result": text_or_unknown(c("result"))}),
        Rule("failed_stage", "stages", 15, "Stage %d failed.", c("outcome") == "failed", high,
             {"stageId": c("stage_id"), "stageName": text_or_unknown(c("completion.stage_name")),
              "failureReason": text_or_unknown(c("completion.failure_reason")),
              "failedTaskAttempts": c("failed_attempts").cast("int"),
              "failedTaskAttemptDurationMillis": c("failed_ms"),
              "failedTaskAttemptReasons": c("attempt_reasons")}),
    ]
    return rules


def register_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    """The rule list with one more rule; names must stay unique."""
    if any(r.name == rule.name for r in rules):
        raise ValueError(f"rule {rule.name} exists already")
    return sorted([*rules, rule], key=lambda r: (r.order, r.part))


# Per watched table: the column naming the row, and the stage and execution of a finding.
SUBJECT = {
    "stages": ("stage_id", F.col, lambda _: F.lit(None).cast("bigint")),
    "executions": ("execution_id", lambda _: F.lit(NO_STAGE), F.col),
    "failed_jobs": ("job_id", lambda _: F.lit(NO_STAGE), lambda _: F.lit(None).cast("bigint")),
}


def apply_rule(rule: Rule, table: DataFrame) -> DataFrame:
    """Rows on which one rule fires, evidence as typed columns."""
    subject = SUBJECT[rule.source][0]
    named = {"stage_id": "stageId", "execution_id": "sqlExecutionId", "job_id": "jobId"}[subject] in rule.evidence
    keys = ["log_id"] if named else ["log_id", subject]
    return table.where(rule.when).select(
        *keys, rule.severity.alias("severity"), *[v.alias(k) for k, v in rule.evidence.items()])


def apply_rules(rules: list[Rule], source: str, table: DataFrame) -> DataFrame:
    """All rules of one table in a single pass over it."""
    subject, stage, execution = SUBJECT[source]
    hits = [
        F.when(r.when, F.struct(
            F.lit(r.name).alias("type"), r.severity.alias("severity"),
            F.format_string(r.message, F.col(subject)).alias("message"),
            F.to_json(F.struct(*[v.alias(k) for k, v in r.evidence.items()]), {"ignoreNullFields": "false"})
            .alias("evidence"),
            F.lit(r.order).alias("rule_order"), F.lit(r.part).alias("rule_part")))
        for r in rules if r.source == source
    ]
    replay = F.col("replay_seq") if "replay_seq" in table.columns else F.lit(None).cast(SEQ_TYPE)
    return (
        table.select("log_id", stage(subject).cast("int").alias("stage_id"), execution(subject).alias("execution_id"),
                     "first_seq", replay.alias("replay_seq"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        .select("log_id", "hit.type", "hit.severity", "stage_id", "execution_id", "hit.message", "hit.evidence",
                "hit.rule_order", "hit.rule_part", "first_seq", "replay_seq")
    )


def execution_signals(executions: DataFrame, plans: DataFrame, duplicates: DataFrame,
                      limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Per SQL execution what the plan rules look at: exchange count and the top repeated subtrees."""
    exchanges = plans.select(*EXECUTION, F.size(F.filter(
        F.col("nodes.node_name"), lambda n: n == "Exchange")).cast("bigint").alias("exchange_count"))
    large = (F.col("count") >= limits.duplicate_min_count) & (F.col("subtree_size") >= limits.duplicate_min_size)
    telling = large & (F.size("interesting") > 0)
    exchange = large & (F.col("root") == "Exchange")
    body = F.struct("root", "count", "subtree_size", "subtree_depth", "interesting")
    repeated = duplicates.groupBy(*EXECUTION).agg(
        F.count_if(telling).alias("repeated_groups"),
        F.min_by(body, F.when(telling, duplicate_rank())).alias("repeated_top"),
        F.count_if(exchange).alias("exchange_groups"),
        F.min_by(body, F.when(exchange, duplicate_rank())).alias("exchange_top"))
    return executions.join(exchanges, [*EXECUTION], "left").join(repeated, [*EXECUTION], "left")
