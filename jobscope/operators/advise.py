"""Recommendations: one per finding, chosen by its type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.display import human_bytes, human_millis, plural
from jobscope.ordering import number_rows

# Recommendation ids by finding type.  Titles and advice are our own words.
ADVICE = (
    ("task_duration_skew", "investigate-task-duration-skew", "Look into uneven task durations",
     "Compare the longest tasks with the rest: uneven partitions, hot keys and slow nodes are the usual causes."),
    ("shuffle_partition_skew", "mitigate-shuffle-partition-skew", "Even out shuffle partitions",
     "Let adaptive execution split skewed joins, find the hot keys, and salt or pre-aggregate them."),
    ("oversized_shuffle_partitions", "reduce-oversized-shuffle-partitions", "Make shuffle partitions smaller",
     "Raise the number of shuffle partitions and drop rows and columns before the shuffle; "
     "give executors more memory only when partition sizes are already right."),
    ("low_shuffle_parallelism", "increase-shuffle-parallelism", "Use more tasks for the shuffle",
     "Raise spark.sql.shuffle.partitions or repartition earlier, and look for a coalesce that narrows the shuffle."),
    ("spill_pressure", "reduce-spill-pressure", "Lower spilling",
     "Tasks hold more than their memory during a shuffle, sort, join or aggregation: check for skew, "
     "use more partitions, and reduce the data each task sees before adding memory."),
    ("memory_spill_skew", "investigate-memory-spill-skew", "Look into uneven memory spill",
     "A few tasks spill far more memory than the typical one: inspect the keys and partitions they handle."),
    ("disk_spill_skew", "investigate-disk-spill-skew", "Look into uneven disk spill",
     "A few tasks spill far more to disk than the typical one: inspect the keys and partitions they handle."),
    ("too_many_tiny_tasks", "reduce-tiny-task-overhead", "Use fewer, larger tasks",
     "Scheduling outweighs work: coalesce partitions, compact small files, or lower the partition count."),
    ("retry_waste", "investigate-retry-waste", "Look into failed task attempts",
     "Read the failure reasons and executor logs, and check memory, fetch failures and bad input records."),
    ("speculation_heavy", "investigate-speculation-heavy-stage", "Look into heavy speculation",
     "Many speculative copies point to slow nodes or skew: find the cause before tuning speculation."),
    ("executor_imbalance", "investigate-executor-imbalance", "Look into uneven executor load",
     "One executor did most of the work: check data locality, partition counts and executor availability."),
    ("host_imbalance", "investigate-host-imbalance", "Look into uneven host load",
     "One host did most of the work: check data placement, locality waits and host capacity."),
    ("sql_many_exchanges", "investigate-sql-many-exchanges", "Review the exchanges of the plan",
     "Each exchange is usually a shuffle: review joins, aggregations, sorts and repartitions, "
     "and whether filters can run before them."),
    ("duplicate_sql_subtree", "investigate-duplicate-sql-subtrees", "Review repeated plan parts",
     "Work may be done twice: consider caching or storing the shared result after checking the query."),
    ("possible_missed_exchange_reuse", "investigate-possible-missed-exchange-reuse", "Review possibly missed reuse",
     "The same exchange may run more than once. The physical plan alone cannot prove it: "
     "confirm in the Spark UI and the query first."),
    ("failed_job", "investigate-failed-job", "Look into the failed job",
     "Check driver logs and the failed stages for lost executors, fetch failures, exceptions or missing resources."),
    ("failed_stage", "investigate-failed-stage", "Look into the failed stage",
     "Begin with the failure reason and the logs of failed tasks, then check for lost executors, "
     "fetch failures, memory and bad input."),
)
CATALOG_SCHEMA = "type string, recommendation_id string, title string, advice string"


def evidence_sentence(kind: Column, stage_id: Column, execution_id: Column, evidence: Column) -> Column:
    """The figures of a finding as a sentence; without them a general one."""
    ev = F.from_json(evidence, "map<string,string>")

    def text(key: str) -> Column:
        return F.try_element_at(ev, F.lit(key))

    def number(key: str) -> Column:
        return text(key).try_cast("double").try_cast("bigint")

    def counted(key: str, noun: str) -> Column:
        return F.concat(text(key), F.lit(f" {noun}"), plural(number(key)))

    def stage(*parts: Column | str) -> Column:
        return F.concat(F.lit("Stage "), stage_id.cast("string"),
                        *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def crossed(value: str, threshold: str, what: str) -> Column:
        return F.when(number(value) >= number(threshold),
                      F.concat(F.lit(f" {what} reached the medium threshold of "), human_bytes(number(threshold)),
                               F.lit("."))).otherwise(F.lit(""))

    why = F.from_json(text("failedTaskAttemptReasons"), "array<string>")
    spent = F.when(number("failedTaskAttemptDurationMillis") > 0,
                   F.concat(F.lit(" taking "), human_millis(number("failedTaskAttemptDurationMillis")))
                   ).otherwise(F.lit(""))
    failed_stage = F.concat(
        stage(" failed."),
        F.when(text("failureReason") != "unknown",
               F.concat(F.lit(" Failure reason: "), text("failureReason"), F.lit("."))).otherwise(F.lit("")),
        F.when(number("failedTaskAttempts") > 0,
               F.concat(F.lit(" It had "), counted("failedTaskAttempts", "failed task attempt"), spent, F.lit("."))
               ).otherwise(F.lit("")),
        F.when(F.size(why) > 0,
               F.concat(F.lit(" Task failure reasons: "), F.array_join(why, ", "), F.lit("."))).otherwise(F.lit("")))
    sql = F.concat(F.lit("SQL execution "), execution_id.cast("string"))
    sentences = {
        "shuffle_partition_skew": (
            stage(" has a task that read ", human_bytes(number("maxTaskShuffleReadBytes")),
                  " of shuffle data against a median of ", human_bytes(number("medianTaskShuffleReadBytes")),
                  ", ", text("skewRatio"), " times as much."),
            stage(" has shuffle partitions far above the median.")),
        "oversized_shuffle_partitions": (
            stage(" has ", counted("shuffleReadingTasks", "shuffle-reading task"), " with a p95 of ",
                  human_bytes(number("p95TaskShuffleReadBytes")), " and a maximum of ",
                  human_bytes(number("maxTaskShuffleReadBytes")), ".",
                  crossed("p95TaskShuffleReadBytes", "mediumP95ShuffleReadThresholdBytes", "The p95")),
            stage(" has tasks that read large shuffle partitions.")),
        "low_shuffle_parallelism": (
            stage(" read ", human_bytes(number("shuffleReadBytes")), " of shuffle data in only ",
                  counted("shuffleReadingTasks", "task"), ", about ",
                  human_bytes(number("avgTaskShuffleReadBytes")), " each."),
            stage(" read much shuffle data in few tasks.")),
        "spill_pressure": (
            stage(" spilled ", human_bytes(number("diskBytesSpilled")), " to disk and ",
                  human_bytes(number("memoryBytesSpilled")), " from memory over ",
                  counted("completedTasks", "completed task"), ".",
                  crossed("diskBytesSpilled", "mediumDiskSpillThresholdBytes", "Disk spill")),
            stage(" spilled much data.")),
        "retry_waste": (
            stage(" lost ", human_millis(number("failedTaskAttemptDurationMillis")), " in ",
                  counted("failedTaskAttempts", "failed task attempt"), "."),
            stage(" lost time in failed task attempts.")),
    }
    general = {
        "task_duration_skew": stage(" has tasks that ran far longer than the average."),
        "memory_spill_skew": stage(" has tasks that spilled far more memory than the median."),
        "disk_spill_skew": stage(" has tasks that spilled far more to disk than the median."),
        "too_many_tiny_tasks": stage(" ran many very short tasks."),
        "speculation_heavy": stage(" ran many speculative task attempts."),
        "executor_imbalance": stage(" ran mostly on one executor."),
        "host_imbalance": stage(" ran mostly on one host."),
        "sql_many_exchanges": F.concat(sql, F.lit(" has many exchanges in its physical plan.")),
        "duplicate_sql_subtree": F.concat(sql, F.lit(" repeats parts of its physical plan.")),
        "possible_missed_exchange_reuse": F.concat(sql, F.lit(" repeats an exchange in its physical plan.")),
        "failed_job": F.lit("A job failed before the application ended."),
        "failed_stage": failed_stage,
    }
    chosen = F.lit(None).cast("string")
    for name, sentence in general.items():
        chosen = F.when(kind == name, sentence).otherwise(chosen)
    for name, (exact, fallback) in sentences.items():
        chosen = F.when(kind == name, F.coalesce(exact, fallback)).otherwise(chosen)
    return chosen


def catalog(findings: DataFrame) -> DataFrame:
    """The fixed advice table; its size never changes with the data."""
    return findings.sparkSession.createDataFrame(list(ADVICE), CATALOG_SCHEMA)


def recommend(findings: DataFrame) -> DataFrame:
    """One recommendation per finding of a known type, with the finding's severity and id."""
    return findings.join(F.broadcast(catalog(findings)), "type").select(
        "log_id", "position", "recommendation_id", "severity", "title",
        F.concat(evidence_sentence(F.col("type"), F.col("stage_id"), F.col("execution_id"), F.col("evidence")),
                 F.lit(" "), F.col("advice")).alias("description"),
        "type", "stage_id", F.col("instance_id").alias("related_id"))


def link_recommendations(recommendations: DataFrame, findings: DataFrame) -> DataFrame:
    """Every recommendation with its finding, or with what is wrong.

    Linked by id where one is given; otherwise the n-th unlinked recommendation
    of a (type, stage) takes the n-th finding of that type and stage that no id
    has taken.  ``recommendations`` carries ``log_id, position, type, stage_id,
    related_id``; ``findings`` carries ``log_id, position, type, stage_id, instance_id``.
    """
    scope = ["log_id", "type", "stage_id"]
    slot = [F.shiftright("position", 12)]
    targets = findings.select(
        "log_id", F.col("instance_id").alias("related_id"), F.col("type").alias("_type"),
        F.col("stage_id").alias("_stage"))
    by_id = recommendations.where(F.col("related_id").isNotNull()).join(targets, ["log_id", "related_id"], "left")
    linked = by_id.select(
        "log_id", "position", "type", "stage_id", "related_id",
        F.when(F.col("_type").isNull(), "unknown finding")
        .when((F.col("_type") != F.col("type")) | (F.col("_stage") != F.col("stage_id")), "mismatch")
        .otherwise("linked").alias("status"))
    free = findings.join(
        linked.where(F.col("status") == "linked").select("log_id", F.col("related_id").alias("instance_id")).distinct(),
        ["log_id", "instance_id"], "left_anti")
    waiting = number_rows(recommendations.where(F.col("related_id").isNull()), scope, slot, [F.col("position")], "_n")
    offered = number_rows(free.select(*scope, "position", "instance_id"), scope, slot, [F.col("position")], "_n")
    by_turn = (
        waiting.drop("related_id")
        .join(offered.select(*scope, "_n", F.col("instance_id").alias("related_id")), [*scope, "_n"], "left")
        .select("log_id", "position", "type", "stage_id", "related_id",
                F.when(F.col("related_id").isNull(), "unknown finding").otherwise("linked").alias("status")))
    return linked.unionByName(by_turn)
